"""Fact tables derived from the given tables by SQL that Spark and DuckDB both accept.

The same text feeds the Spark jobs and, as CTEs, the checking SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from factloom.session import scratch_path

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

SQL: dict[str, str] = {}

SQL["fx_step_run"] = """
SELECT o_orderkey AS run_id, o_orderdate AS at, concat('nb_', o_custkey % 40) AS name,
 CASE o_orderstatus WHEN 'O' THEN 'stub' WHEN 'F' THEN 'spark' ELSE 'definition' END AS engine,
 o_orderpriority <> '5-LOW' AS ok, concat('ws', o_custkey % 2) AS workspace FROM orders
"""

SQL["fx_flow_raw"] = """
SELECT l_orderkey AS run_id,
 concat('ws', l_suppkey % 2, '/lh_', CASE l_partkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END, '/t', l_partkey % 12) AS to_table,
 concat('c', l_linenumber) AS to_column,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('ws', l_suppkey % 2, '/lh_', CASE l_partkey % 3 WHEN 0 THEN 'landing' WHEN 1 THEN 'bronze' ELSE 'silver' END, '/t', l_suppkey % 12) END AS from_table,
 concat('c', l_suppkey % 7) AS from_column,
 CASE WHEN l_returnflag = 'R' THEN 'upper(x)' END AS transform FROM lineitem
"""

SQL["fx_column_flow"] = """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY to_table, to_column, coalesce(from_table,''), from_column) AS BIGINT) AS seq,
 to_table, to_column, from_table, from_column, transform FROM
 (SELECT run_id, to_table, to_column, from_table, from_column, min(transform) AS transform FROM fx_flow_raw GROUP BY run_id, to_table, to_column, from_table, from_column) g
"""

SQL["fx_access"] = """
SELECT run_id, to_table AS ref, 'write' AS mode FROM fx_column_flow
 UNION SELECT run_id, from_table, 'read' FROM fx_column_flow WHERE from_table IS NOT NULL
 UNION SELECT l_orderkey, concat('ws0/lh_gold/bare', l_suppkey % 5), 'write' FROM lineitem WHERE l_linenumber = 6 AND l_linestatus = 'F'
"""

# The order of touch is another one than that of names.
SQL["fx_touch"] = """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY md5(concat(ref, mode, run_id)), ref, mode) AS BIGINT) AS seq, ref, mode FROM fx_access
"""

SQL["fx_table_schema"] = """
SELECT run_id, ref, name, CASE WHEN name IN ('c1','c2') THEN 'bigint' ELSE 'string' END AS type FROM
 (SELECT run_id, to_table AS ref, to_column AS name FROM fx_column_flow UNION SELECT run_id, from_table, from_column FROM fx_column_flow WHERE from_table IS NOT NULL) s
"""

SQL["fx_cell"] = """
SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) - 1 AS cell_index,
 CASE l_linenumber
  WHEN 1 THEN concat('from pyspark.sql import functions as F\ndf = spark.table("lh_bronze.t', l_partkey % 9, '")')
  WHEN 2 THEN concat('df.createOrReplaceTempView("stage_', l_suppkey % 4, '")')
  WHEN 3 THEN concat('spark.sql("INSERT INTO lh_gold.t', l_partkey % 9, ' SELECT * FROM stage_', l_suppkey % 4, ' s JOIN lh_silver.t', l_suppkey % 9, ' USING (id)")')
  WHEN 4 THEN concat('df.write.mode("overwrite").saveAsTable("lh_silver.t', l_partkey % 9, '")')
  WHEN 5 THEN concat('%%sql\nMERGE INTO lh_gold.m', l_partkey % 5, ' USING lh_silver.t', l_suppkey % 9, ' ON 1=1')
  WHEN 6 THEN concat('df = spark.read.parquet("Files/landing/f', l_partkey % 6, '/*.parquet")')
  ELSE CASE l_partkey % 5 WHEN 0 THEN 'spark.sql(query)' WHEN 1 THEN concat('df.write.mode("append").parquet("Files/out/p', l_suppkey % 6, '")')
   WHEN 2 THEN 'def broken(:' WHEN 3 THEN concat('%%configure\nretries = ', l_suppkey % 3) ELSE 'print(1)' END END AS source FROM lineitem
"""

SQL["fx_activity"] = """
SELECT pipeline_id, idx, concat('a', idx) AS name, CASE idx % 4 WHEN 0 THEN 'Copy' WHEN 1 THEN 'TridentNotebook' WHEN 2 THEN 'ExecutePipeline' ELSE 'Wait' END AS type FROM
 (SELECT o_custkey AS pipeline_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS idx FROM orders) a
"""

SQL["fx_activity_dep"] = """
SELECT pipeline_id, name, concat('a', CAST(floor(idx / 2.0) AS INT)) AS depends_on FROM fx_activity WHERE idx > 1
 UNION SELECT pipeline_id, name, concat('a', idx - 3) FROM fx_activity WHERE idx > 3 AND (idx + pipeline_id) % 2 = 0
"""

SQL["fx_observed"] = """
SELECT event_id AS execution_id, user_id AS run_key, ts AS submitted, CASE WHEN event_type IN ('view','click') THEN 'read' ELSE 'write' END AS mode,
 CASE WHEN event_type = 'error' THEN 'Error' ELSE 'Success' END AS state, concat('ws', user_id % 2, '/lh_bronze/t', CAST(floor(value) AS INT) % 12) AS ref FROM events
"""

SQL["fx_gap_note"] = """
SELECT concat('ws0/lh_gold/bare', user_id % 5) AS ref, CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS note, ts AS updated_at FROM events
"""

SQL["fx_view_col"] = """
SELECT notebook, concat('v', k) AS view_name, concat('c', j) AS col_name,
 CASE WHEN k = 1 OR k % 7 = 0 THEN 'table' ELSE 'view' END AS src_kind,
 CASE WHEN k = 1 OR k % 7 = 0 THEN concat('ws0/lh_bronze/t', (notebook + k) % 12) ELSE concat('v', k - 1) END AS src_name,
 concat('c', (j + k) % 3) AS src_column, CASE WHEN (k + j) % 3 = 0 THEN concat('f', k, '(x)') END AS transform FROM
 (SELECT o_custkey AS notebook, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS k FROM orders) p
 CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2) j
"""

SQL["fx_frame_op"] = """
SELECT notebook, k AS seq, concat('f', k) AS out_frame,
 CASE WHEN k % 5 = 1 THEN 'table' ELSE CASE (k + notebook) % 11 WHEN 0 THEN 'drop' WHEN 1 THEN 'groupBy' WHEN 2 THEN 'select' WHEN 3 THEN 'withColumn'
  WHEN 4 THEN 'withColumnRenamed' WHEN 5 THEN 'mystery' WHEN 6 THEN 'join' WHEN 7 THEN 'union' WHEN 8 THEN 'unionByName' WHEN 9 THEN 'filter' ELSE 'toDF' END END AS verb,
 CASE WHEN k % 5 <> 1 THEN concat('f', k - 1) END AS left_frame,
 CASE WHEN k % 5 <> 1 AND (k + notebook) % 11 IN (6, 7, 8) THEN concat('f', k - 2) END AS right_frame,
 CASE WHEN k % 5 = 1 THEN concat('ws0/lh_bronze/t', (notebook + k) % 12) END AS ref FROM
 (SELECT o_custkey AS notebook, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS k FROM orders) p
"""

SQL["fx_cell_flags"] = """
SELECT run_id, cell_index, CASE WHEN source LIKE '%spark.sql(%' OR substr(source, 1, 5) = '%%sql' THEN 1 ELSE 0 END AS sql_statements,
 source LIKE '%saveAsTable%' AS df_write, (run_id + cell_index) % 11 = 5 AS dynamic_sql, (run_id + cell_index) % 97 = 0 AS unparsable FROM fx_cell
"""

SQL["fx_schema_request"] = """
SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY md5(concat(run_id, ref)), ref) AS BIGINT) AS seq, ref, CASE WHEN run_id % 5 = 0 THEN 'unresolved' WHEN run_id % 5 = 1 THEN 'carried' ELSE 'resolved' END AS state,
 CASE WHEN run_id % 10 = 0 THEN concat('403 reading ', ref) END AS failure FROM fx_access WHERE mode = 'read'
"""

SQL["fx_lakehouse_table"] = """
SELECT concat('ws', w) AS workspace, concat('lh_', CASE l WHEN 0 THEN 'landing' WHEN 1 THEN 'bronze' WHEN 2 THEN 'silver' WHEN 3 THEN 'gold' ELSE 'archive' END) AS lakehouse, concat('t', t) AS name,
 (w + l + t) % 9 <> 0 AS readable FROM (SELECT DISTINCT s_suppkey % 2 AS w FROM supplier) a CROSS JOIN (SELECT DISTINCT n_nationkey % 5 AS l FROM nation) b CROSS JOIN (SELECT DISTINCT n_nationkey % 15 AS t FROM nation) c
"""

SQL["fx_downstream"] = """
SELECT run_id, run_id % 3 <> 0 AS available, CASE WHEN run_id % 3 = 1 THEN concat('report_', run_id % 20) END AS consumer_name,
 CASE WHEN run_id % 3 = 1 THEN CASE WHEN run_id % 2 = 0 THEN 'report' ELSE 'semantic model' END END AS consumer_kind FROM fx_step_run
"""

SQL["fx_run"] = """
SELECT o_orderkey AS run_id, o_orderdate AS at, CAST(200 + (o_orderkey * 7919) % 450000 AS BIGINT) AS size_bytes,
 concat('ws', o_custkey % 2) AS workspace FROM orders
"""

SQL["fx_guid_name"] = """
SELECT concat(lpad(CAST(s_suppkey AS STRING), 8, '0'), '-00aa-0000-0000-', lpad(CAST(s_suppkey AS STRING), 12, '0')) AS guid,
 concat(CASE WHEN s_suppkey % 2 = 0 THEN 'Finance ' ELSE 'Sales/' END, s_suppkey) AS name FROM supplier
"""

SQL["fx_raw_ref"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 16
  WHEN 0 THEN concat('orders_', k) WHEN 1 THEN concat('lh_bronze.t', k) WHEN 2 THEN concat('Finance.Gold.Lakehouse.t', k)
  WHEN 3 THEN concat('a.b.c.t', k) WHEN 4 THEN concat('`t', k, '`') WHEN 5 THEN concat('Files/landing/f', k, '/*.csv')
  WHEN 6 THEN concat('Tables/t', k, '/_delta_log/00000000000000000000.json') WHEN 7 THEN concat('abfss://', g, '@one.example/', h, '.Lakehouse/Tables/dbo/t', k)
  WHEN 8 THEN concat('abfss://onelake@one.example/', g, '/', h, '/Files/in/t', k, '.csv') WHEN 9 THEN concat('orders', k, '.csv')
  WHEN 10 THEN concat('  "lh_silver.Warehouse"."t', k, '"  ') WHEN 11 THEN concat('ws%1/lh', k, '/na%2Fme') WHEN 12 THEN concat('`lh_gold`.`t', k, '`')
  WHEN 13 THEN concat('global_temp.Stage_', k) WHEN 14 THEN concat('Tables/t', k, '/part-000', k, '.snappy.parquet') ELSE '   ' END AS raw,
 g AS guid, concat('name/', k, '%') AS odd_name FROM
 (SELECT o_orderkey, o_custkey % 37 AS k,
  concat(lpad(CAST(o_custkey % 100 AS STRING), 8, '0'), '-00AA-0000-0000-', lpad(CAST(o_custkey % 100 AS STRING), 12, '0')) AS g,
  concat(lpad(CAST(o_orderkey % 100 AS STRING), 8, '0'), '-00aa-0000-0000-', lpad(CAST(o_orderkey % 100 AS STRING), 12, '0')) AS h FROM orders) o
"""

SQL["fx_frame_op_arg"] = """
SELECT notebook, seq, pos, out_name, input_cols, transform FROM (
 SELECT notebook, seq, 1 AS pos, 'c0' AS out_name, 'c0' AS input_cols, CAST(NULL AS STRING) AS transform FROM fx_frame_op WHERE verb IN ('select', 'groupBy')
 UNION ALL SELECT notebook, seq, 2, 'x', 'c1', 'upper(c1)' FROM fx_frame_op WHERE verb = 'select'
 UNION ALL SELECT notebook, seq, 2, 'sum(c2)', 'c2', 'sum(c2)' FROM fx_frame_op WHERE verb = 'groupBy'
 UNION ALL SELECT notebook, seq, 1, 'y', 'c0,c1', 'c0 + c1' FROM fx_frame_op WHERE verb = 'withColumn'
 UNION ALL SELECT notebook, seq, 1, 'z', 'c0', CAST(NULL AS STRING) FROM fx_frame_op WHERE verb = 'withColumnRenamed'
 UNION ALL SELECT notebook, seq, 1, 'c1', 'c1', CAST(NULL AS STRING) FROM fx_frame_op WHERE verb = 'drop'
 UNION ALL SELECT notebook, seq, 1, 'a', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM fx_frame_op WHERE verb = 'toDF'
 UNION ALL SELECT notebook, seq, 2, 'b', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM fx_frame_op WHERE verb = 'toDF'
 UNION ALL SELECT notebook, seq, 3, 'c', CAST(NULL AS STRING), CAST(NULL AS STRING) FROM fx_frame_op WHERE verb = 'toDF') a
"""

SQL["fx_ref_schema"] = """
SELECT ref, pos, name FROM (SELECT DISTINCT ref FROM fx_frame_op WHERE ref IS NOT NULL) r
 CROSS JOIN (SELECT 1 AS pos, 'c0' AS name UNION ALL SELECT 2, 'c1' UNION ALL SELECT 3, 'c2') c
"""

SQL["fx_view_write"] = """
SELECT o_orderkey AS seq, o_custkey AS notebook, concat('v', 1 + o_orderkey % 12) AS frame,
 CASE WHEN o_orderkey % 9 = 0 THEN concat('v', o_orderkey % 4) ELSE concat('ws0/lh_silver/w', o_orderkey % 15) END AS target,
 CASE WHEN o_orderkey % 2 = 0 THEN 'sql' ELSE 'dataframe' END AS origin FROM orders
"""

SQL["fx_gap"] = """
SELECT DISTINCT ref FROM fx_access WHERE mode = 'write' AND ref LIKE 'ws0/lh_gold/%'
"""

SQL["fx_entry"] = """
SELECT run_id, seq, workspace, name, reads_ref, writes_ref, ok FROM
 (SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS BIGINT) AS seq,
  concat('ws', l_orderkey % 2) AS workspace, concat('invoke p', l_suppkey % 7, ' / run nb_', l_partkey % 40) AS name,
  concat('ws', l_suppkey % 2, '/lh_', CASE l_partkey % 3 WHEN 0 THEN 'landing' WHEN 1 THEN 'bronze' ELSE 'silver' END, '/t', l_suppkey % 12) AS reads_ref,
  CASE WHEN l_returnflag <> 'N' THEN concat('ws', l_partkey % 2, '/lh_', CASE l_partkey % 3 WHEN 0 THEN 'bronze' WHEN 1 THEN 'silver' ELSE 'gold' END, '/t', l_partkey % 12) END AS writes_ref,
  l_shipdate IS NOT NULL AND l_linenumber <> 7 AS ok FROM lineitem) e
"""

SQL["fx_observed_run"] = """
SELECT event_id AS entry_id, user_id AS run_id, event_type <> 'error' AS available, CASE WHEN event_id % 7 = 0 THEN 'Error' ELSE 'Success' END AS state,
 ts AS submitted_at, CASE event_id % 5 WHEN 0 THEN ts + INTERVAL 1 HOUR WHEN 1 THEN ts - INTERVAL 1 HOUR END AS code_changed_at,
 concat('user', event_id % 9) AS submitter, CASE WHEN event_type = 'error' THEN concat('no history ', event_id % 3) END AS note FROM events
"""

SQL["fx_statement"] = """
SELECT execution_id, run_key AS run_id, mode, CASE WHEN state <> 'Error' THEN ref END AS ref FROM fx_observed
"""

SQL["fx_question"] = """
SELECT DISTINCT concat(CASE WHEN n_nationkey % 2 = 0 THEN 't' ELSE 'T' END, n_nationkey) AS table_name,
 CASE n_nationkey % 4 WHEN 1 THEN 'LH_Silver' WHEN 2 THEN 'lh_gold' END AS lakehouse FROM nation
"""

SQL["fx_cell_result"] = """
SELECT run_id, cell_index, CASE WHEN (run_id + cell_index) % 13 = 0 THEN 'error' WHEN (run_id + cell_index) % 13 = 1 THEN 'skipped' ELSE 'ok' END AS status,
 CASE WHEN (run_id + cell_index) % 13 = 0 THEN concat('cell raised ', cell_index) END AS error FROM fx_cell
"""

SQL["fx_step_error"] = """
SELECT run_id, name, CASE WHEN NOT ok THEN concat('step failed ', run_id % 5) END AS error FROM fx_step_run
"""

SQL["fx_coverage"] = """
SELECT run_id, count(*) AS cells,
 CAST(sum(CASE WHEN df_write AND sql_statements = 0 AND NOT unparsable THEN 1 ELSE 0 END) AS BIGINT) AS dataframe_write_cells,
 CAST(sum(CASE WHEN dynamic_sql AND NOT unparsable THEN 1 ELSE 0 END) AS BIGINT) AS dynamic_sql_cells,
 CAST(sum(CASE WHEN unparsable THEN 1 ELSE 0 END) AS BIGINT) AS unparsable_cells
 FROM fx_cell_flags WHERE run_id % 11 <> 0 GROUP BY run_id
"""

SQL["fx_statement_text"] = """
SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS pos,
 CASE l_partkey % 8 WHEN 0 THEN concat('INSERT INTO lh_gold.t', a, ' SELECT * FROM lh_silver.t', b) WHEN 1 THEN concat('CREATE OR REPLACE TABLE lh_gold.t', a, ' USING delta AS SELECT * FROM lh_silver.t', b)
  WHEN 2 THEN concat('MERGE INTO lh_gold.t', a, ' t USING lh_silver.t', b, ' s ON t.id = s.id') WHEN 3 THEN concat('UPDATE lh_gold.t', a, ' SET c = (SELECT max(c) FROM lh_silver.t', b, ')')
  WHEN 4 THEN concat('DELETE FROM lh_gold.t', a, ' WHERE id IN (SELECT id FROM stage_', b, ')') WHEN 5 THEN concat('CREATE OR REPLACE TEMP VIEW stage_', a, ' AS SELECT * FROM lh_silver.t', b)
  WHEN 6 THEN concat('insert overwrite table lh_gold.t', a, ' select * from lh_silver.t', b) ELSE concat('SELECT * FROM lh_silver.t', b) END AS statement FROM
 (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_partkey % 9 AS a, l_suppkey % 9 AS b FROM lineitem) l
"""

SQL["fx_base_frame"] = """
SELECT DISTINCT notebook, frame, pos, concat(CASE WHEN frame = 'R' AND k = 2 THEN 'd' ELSE 'c' END, k) AS col_name, src_ref, src_column,
 CASE WHEN (notebook + k) % 4 = 0 THEN 'f(x)' END AS transform FROM
 (SELECT o_custkey AS notebook, CASE WHEN o_orderkey % 2 = 0 THEN 'L' ELSE 'R' END AS frame, o_orderkey % 3 AS k,
  CAST(dense_rank() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey % 3) AS BIGINT) AS pos,
  concat('ws0/lh_bronze/t', o_orderkey % 5) AS src_ref, concat('s', o_orderkey % 4) AS src_column FROM orders) b
"""

SQL["fx_notebook"] = """
SELECT DISTINCT o_custkey AS notebook FROM orders
"""

# Facts that many questions read: they are saved, not derived again for every use.
STORED = {
    "fx_step_run", "fx_column_flow", "fx_access", "fx_touch", "fx_table_schema", "fx_cell", "fx_entry", "fx_statement_text",
    "fx_frame_op", "fx_view_col", "fx_base_frame", "fx_activity", "fx_activity_dep",
}
# Facts whose groups all lie within one key: their rows are placed by it before any text is made of them, and once for all groupings.
PLACED = {name: ("lineitem", "l_orderkey") for name in ("fx_flow_raw", "fx_access", "fx_cell", "fx_entry")} | {"fx_step_run": ("orders", "o_orderkey")}
# Facts of runs are saved in buckets of the run, which they are placed by anyway: what a question groups or joins by run stays in its task.
BY_RUN = {"fx_step_run", "fx_column_flow", "fx_access", "fx_touch", "fx_table_schema", "fx_cell", "fx_entry"}
#: lines of a task that groups them: bytes of a shuffle say little about the room that its rows take
ROWS = 100_000
_WRITTEN: dict[tuple[str, str, str], tuple[str, object]] = {}
_TASKS: dict[tuple[str, str, int], int] = {}

_NAME = re.compile(r"\b(FROM|JOIN)\s+(fx_\w+|" + "|".join(BASE_TABLES) + r")\b", re.I)


def expand(text: str) -> str:
    r"""Fixture text with ``\n`` inside a literal standing for a newline."""
    return text.replace("\\n", "\n").strip()


def dependencies(text: str) -> list[str]:
    """Fixture names used by ``text``, each after the ones it needs itself."""
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for _, name in _NAME.findall(sql):
            if name.startswith("fx_") and name not in ordered:
                visit(SQL[name])
                ordered.append(name)

    visit(text)
    return ordered


class Facts:
    """The given tables of one folder and the fact tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in STORED:
                self._frames[name] = self._stored(name)
            elif name in SQL:
                self._frames[name] = self._derived(name)
            else:
                self._frames[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def _stored(self, name: str) -> DataFrame:
        """A fact table written once per application, as finished runs are, then read."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            frame, path = self._derived(name), scratch_path(self.spark, name)
            if name in BY_RUN:
                table = path.rsplit("/", 1)[1].replace("-", "_")
                kept = frame.withColumnRenamed("run_id", "run").write.bucketBy(self._tasks(), "run")
                kept.option("path", path).saveAsTable(table, format="parquet")
                _WRITTEN[key] = (table, None)
            else:
                frame.write.parquet(path)
                _WRITTEN[key] = (path, frame.schema)
        place, schema = _WRITTEN[key]
        if schema:
            return self.spark.read.schema(schema).parquet(place)
        # A name of its own: Spark takes unions of buckets for placed by a column only where it has no table's name before it.
        return self.spark.table(place).withColumnRenamed("run", "run_id")

    def _derived(self, name: str) -> DataFrame:
        if name not in PLACED:
            return self.sql(SQL[name])
        source, key = PLACED[name]
        return self.sql(SQL[name], **{source: self(source).repartition(self._tasks(), key)})

    def _tasks(self) -> int:
        """Tasks, and buckets, of all facts of runs: as many as the largest source of them needs."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, ROWS)
        if key not in _TASKS:
            _TASKS[key] = -(-self("lineitem").count() // ROWS) or 1
        return _TASKS[key]

    def sql(self, text: str, **given: DataFrame) -> DataFrame:
        text = expand(text)
        frames = {name: given.get(name) or self(name) for _, name in _NAME.findall(text)}
        # Braces name the frames; none of the fixture texts holds a brace of its own.
        return self.spark.sql(_NAME.sub(r"\1 {\2}", text), **frames)
