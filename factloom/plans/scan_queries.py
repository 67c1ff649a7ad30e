"""Registered queries for table identity and corpus scans, each with its check."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import refs
from factloom.operators import reports, scan
from factloom.plans.registry import query
from factloom.sources import text as text_sources

_RAW = "r AS (SELECT *, id % 16 AS form, regexp_extract(raw, 't(\\d+)', 1) AS t FROM fx_raw_ref)"


@query("b01_make_ref", "SELECT id, concat(guid, '/lh/', replace(replace(odd_name, '%', '%25'), '/', '%2F')) AS ref FROM fx_raw_ref")
def _(f):
    return f("fx_raw_ref").select("id", refs.make_ref(F.col("odd_name"), "lh", F.col("guid")).alias("ref"))


_PARSED = """p AS (SELECT id, raw AS ref, string_split(raw, '/') AS s FROM fx_raw_ref),
q AS (SELECT id, ref, CASE WHEN len(s) >= 3 THEN s[1] ELSE '' END AS w, CASE WHEN len(s) >= 3 THEN s[2] WHEN len(s) = 2 THEN s[1] ELSE '' END AS l,
 CASE WHEN len(s) >= 3 THEN array_to_string(s[3:], '/') WHEN len(s) = 2 THEN s[2] ELSE s[1] END AS t FROM p),
u AS (SELECT id, ref, replace(replace(replace(w, '%2F', '/'), '%2f', '/'), '%25', '%') AS workspace, replace(replace(replace(l, '%2F', '/'), '%2f', '/'), '%25', '%') AS lakehouse,
 replace(replace(replace(t, '%2F', '/'), '%2f', '/'), '%25', '%') AS "table" FROM q)"""


@query("b02_parse_ref", f'WITH {_PARSED} SELECT id, workspace, lakehouse, "table" FROM u')
def _(f):
    return f("fx_raw_ref").select("id", refs.parse_ref(F.col("raw")).alias("p")).select("id", "p.*")


@query("b02_round_trip", "SELECT id, guid AS workspace, 'lh' AS lakehouse, odd_name AS \"table\" FROM fx_raw_ref")
def _(f):
    made = refs.make_ref(F.col("odd_name"), "lh", F.col("guid"))
    return f("fx_raw_ref").select("id", refs.parse_ref(made).alias("p")).select("id", "p.*")


@query("b03_ref_kind", f"""WITH {_PARSED} SELECT id, CASE WHEN "table" = 'Files' OR lower("table") LIKE 'files/%' THEN 'file' ELSE 'table' END AS kind FROM u""")
def _(f):
    return f("fx_raw_ref").select("id", refs.ref_kind(F.col("raw")).alias("kind"))


@query("b04_table_ref_parts", f"""
WITH {_PARSED} SELECT id, workspace, lakehouse, "table", workspace <> '' AND "table" <> '' AS resolved,
 CASE WHEN "table" = 'Files' OR lower("table") LIKE 'files/%' THEN 'file' ELSE 'table' END AS kind FROM u""")
def _(f):
    return f("fx_raw_ref").select("id", refs.table_ref_parts(F.col("raw")).alias("p")).select("id", "p.*")


@query("b05_is_qualified", f"""WITH {_PARSED} SELECT id, workspace <> '' AND lakehouse <> '' AND "table" <> '' AS qualified FROM u""")
def _(f):
    return f("fx_raw_ref").select("id", refs.is_qualified(F.col("raw")).alias("qualified"))


# What each of the sixteen raw forms must become; k, g and h are the parts it was built from.
_EXPECT = """o AS (SELECT o_orderkey AS id, o_orderkey % 16 AS form, CAST(o_custkey % 37 AS VARCHAR) AS k,
 concat(lpad(CAST(o_custkey % 100 AS VARCHAR), 8, '0'), '-00AA-0000-0000-', lpad(CAST(o_custkey % 100 AS VARCHAR), 12, '0')) AS g,
 concat(lpad(CAST(o_orderkey % 100 AS VARCHAR), 8, '0'), '-00aa-0000-0000-', lpad(CAST(o_orderkey % 100 AS VARCHAR), 12, '0')) AS h FROM orders),
e AS (SELECT id, form, g, h, CASE form WHEN 0 THEN concat('ws0/lh_def/orders_', k) WHEN 1 THEN concat('ws0/lh_bronze/t', k) WHEN 2 THEN concat('Gold/Lakehouse/t', k)
 WHEN 3 THEN concat('b/c/t', k) WHEN 4 THEN concat('ws0/lh_def/t', k) WHEN 5 THEN concat('ws0/lh_def/Files%2Flanding%2Ff', k, '%2F*.csv') WHEN 6 THEN concat('ws0/lh_def/t', k)
 WHEN 7 THEN concat('<g>/<h>/t', k) WHEN 8 THEN concat('<g>/<h>/Files%2Fin%2Ft', k, '.csv') WHEN 9 THEN concat('ws0/orders', k, '/csv') WHEN 10 THEN concat('lh_silver/Warehouse"/"t', k)
 WHEN 11 THEN 'ws0/lh_def/na%252Fme' WHEN 12 THEN concat('ws0/lh_gold/t', k) WHEN 13 THEN concat('ws0/global_temp/Stage_', k) WHEN 14 THEN concat('ws0/lh_def/t', k) ELSE '//' END AS ref FROM o)"""
# Absolute paths keep their GUIDs where nothing resolves them.
_KEPT = "replace(replace(ref, '<g>', g), '<h>', h)"


@query("b06_qualify_dotted", f"WITH {_EXPECT} SELECT id, {_KEPT} AS ref FROM e")
def _(f):
    return f("fx_raw_ref").select("id", refs.qualify(F.col("raw"), "ws0", "lh_def").alias("ref"))


@query("b07_qualify_path", f"WITH {_EXPECT} SELECT id, {_KEPT} AS ref FROM e")
def _(f):
    """A ref that is qualified already stays what it is."""
    once = f("fx_raw_ref").select("id", refs.qualify(F.col("raw"), "ws0", "lh_def").alias("ref"))
    return once.select("id", refs.as_ref(F.col("ref"), "other", "other").alias("ref"))


@query("b08_qualify_absolute", f"""
WITH {_EXPECT}
SELECT id, replace(replace(ref, '<g>', coalesce(replace(a.name, '/', '%2F'), g)), '<h>', coalesce(replace(b.name, '/', '%2F'), h)) AS ref
FROM e LEFT JOIN fx_guid_name a ON a.guid = lower(e.g) LEFT JOIN fx_guid_name b ON b.guid = lower(e.h)""")
def _(f):
    return refs.qualify_refs(f("fx_raw_ref"), "raw", f("fx_guid_name"), "ws0", "lh_def").select("id", "ref")


@query("b09_resolve_names", "SELECT id, coalesce(n.name, r.guid) AS guid FROM fx_raw_ref r LEFT JOIN fx_guid_name n ON lower(r.guid) = n.guid")
def _(f):
    return refs.resolve_names(f("fx_raw_ref").select("id", "guid"), "guid", f("fx_guid_name"))


@query("b10_as_ref", f"""
WITH {_EXPECT}
SELECT e.id, CASE WHEN lower(trim(raw)) NOT LIKE 'abfss://%' AND length(raw) - length(replace(raw, '/', '')) >= 2 THEN raw
 ELSE replace(replace(ref, '<g>', g), '<h>', h) END AS ref FROM e JOIN fx_raw_ref r ON r.id = e.id""")
def _(f):
    return f("fx_raw_ref").select("id", refs.as_ref(F.col("raw"), "ws0", "lh_def").alias("ref"))


@query("b11_referenced_workspace_ids", """
WITH m AS (SELECT id % 97 AS nb, id, unnest(regexp_extract_all(raw, 'abfss://([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})@', 1)) AS guid FROM fx_raw_ref)
SELECT nb, arg_min(guid, id) AS guid FROM m GROUP BY nb, lower(guid)""")
def _(f):
    cells = f("fx_raw_ref").select((F.col("id") % 97).alias("nb"), "id", F.col("raw").alias("source"))
    return refs.referenced_workspace_ids(cells, ["nb"], ["id"])


@query("b13_ref_labels", f"""
WITH {_PARSED} SELECT id, CASE WHEN "table" <> '' THEN "table" ELSE ref END AS label, CASE WHEN "table" <> '' THEN workspace ELSE '' END AS workspace, lakehouse FROM u""")
def _(f):
    raw = F.col("raw")
    return f("fx_raw_ref").select(
        "id", refs.ref_label(raw).alias("label"), refs.ref_workspace(raw).alias("workspace"), refs.ref_lakehouse(raw).alias("lakehouse"))


@query("b14_normalise_view_name", """
WITH v AS (SELECT id, regexp_replace(trim(trim(trim(trim(raw), '`'), '''"')), '(?i)^global_temp\\.', '') AS v FROM fx_raw_ref)
SELECT id, CASE WHEN regexp_matches(v, '^[A-Za-z_][A-Za-z_0-9]*$') THEN lower(v) END AS view FROM v""")
def _(f):
    return f("fx_raw_ref").select("id", refs.normalise_view_name(F.col("raw")).alias("view"))


_SIDES = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat(' ', event_type, ' ') END AS name,
 CASE event_id % 4 WHEN 1 THEN concat('$[''', event_type, '''][''id''].x', user_id) WHEN 2 THEN concat('$[''customer''][''', event_type, ''']') END AS path FROM events"""


@query("b15_copy_column_name", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN concat('x', user_id) WHEN 2 THEN event_type ELSE '' END AS "column" FROM events""")
def _(f):
    return f.sql(_SIDES).select("event_id", refs.copy_column_name(F.col("name"), F.col("path")).alias("column"))


@query("b16_activity_label", """
SELECT run_id, seq, CASE WHEN regexp_matches(leaf, '(?i)^(run|invoke|execute|call)\\s+\\S') THEN regexp_replace(leaf, '(?i)^(run|invoke|execute|call)\\s+', '') ELSE leaf END AS label
FROM (SELECT run_id, seq, string_split(name, ' / ')[-1] AS leaf FROM fx_entry) e""")
def _(f):
    return f("fx_entry").select("run_id", "seq", refs.activity_label(F.col("name")).alias("label"))


@query("b17_activity_depth", "SELECT run_id, seq, len(string_split(name, ' / ')) - 1 AS depth FROM fx_entry")
def _(f):
    return f("fx_entry").select("run_id", "seq", refs.activity_depth(F.col("name")).cast("bigint").alias("depth"))


@query("b18_stage_rank", """
SELECT run_id, ref, CASE WHEN l LIKE '%landing%' THEN 0 WHEN l LIKE '%bronze%' THEN 3 WHEN l LIKE '%silver%' THEN 4 WHEN l LIKE '%gold%' THEN 5 ELSE -1 END AS rank,
 CASE WHEN l LIKE '%landing%' THEN 'Landing' WHEN l LIKE '%bronze%' THEN 'Bronze' WHEN l LIKE '%silver%' THEN 'Silver' WHEN l LIKE '%gold%' THEN 'Gold' ELSE 'Unstaged' END AS stage
FROM (SELECT run_id, ref, split_part(ref, '/', 2) AS l FROM fx_access) a""")
def _(f):
    rank = refs.stage_rank(refs.ref_lakehouse(F.col("ref")))
    return f("fx_access").select("run_id", "ref", rank.alias("rank"), refs.stage_label(rank).alias("stage"))


# -- corpus scans --------------------------------------------------------------

# The fixture cells use a few of the patterns; these expressions say what is in them.
_CELL_READS = """reads AS (SELECT run_id, cell_index, unnest(list_concat(list_concat(regexp_extract_all(source, 'spark\\.table\\("([^"]+)"', 1), regexp_extract_all(source, '\\.read\\.parquet\\("([^"]+)"', 1)),
 list_concat(regexp_extract_all(regexp_replace(source, 'from pyspark.sql import', ''), '(?i)\\bFROM\\s+([\\w.]+)', 1), regexp_extract_all(source, '(?i)\\bJOIN\\s+([\\w.]+)', 1)))) AS raw FROM fx_cell)"""
_CELL_WRITES = """writes AS (SELECT run_id, cell_index, unnest(list_concat(list_concat(regexp_extract_all(source, 'saveAsTable\\("([^"]+)"', 1), regexp_extract_all(source, '\\.write\\..*parquet\\("([^"]+)"', 1)),
 list_concat(regexp_extract_all(source, 'INSERT INTO ([\\w.]+)', 1), regexp_extract_all(source, 'MERGE INTO ([\\w.]+)', 1)))) AS raw FROM fx_cell)"""
_REF = "CASE WHEN raw LIKE 'Files/%' THEN concat('ws0/lh_def/', replace(raw, '/', '%2F')) WHEN raw LIKE '%.%' THEN concat('ws0/', replace(raw, '.', '/')) ELSE concat('ws0/lh_def/', raw) END"
_VIEWS = "views AS (SELECT DISTINCT run_id, regexp_extract(source, 'TempView\\(\"(\\w+)\"', 1) AS view FROM fx_cell WHERE source LIKE '%TempView(%')"
_ACCESS = f"""{_CELL_READS}, {_CELL_WRITES}, {_VIEWS},
acc AS (SELECT DISTINCT run_id, cell_index, mode, {_REF} AS ref FROM (SELECT *, 'read' AS mode FROM reads UNION ALL SELECT *, 'write' FROM writes) a
 WHERE NOT EXISTS (SELECT 1 FROM views v WHERE v.run_id = a.run_id AND v.view = a.raw))"""


@query("c01_scan_reads", f"WITH {_CELL_READS} SELECT DISTINCT run_id, cell_index, {_REF} AS ref FROM reads")
def _(f):
    return scan.scan_reads(f("fx_cell"), "ws0", "lh_def")


@query("c02_scan_writes", f"WITH {_CELL_WRITES} SELECT DISTINCT run_id, cell_index, {_REF} AS ref FROM writes")
def _(f):
    return scan.scan_writes(f("fx_cell"), "ws0", "lh_def")


@query("c03_strip_imports", "SELECT run_id, cell_index, replace(source, 'from pyspark.sql import', '') AS source FROM fx_cell")
def _(f):
    return f("fx_cell").select("run_id", "cell_index", scan.strip_imports(F.col("source")).alias("source"))


@query("c04_scan_temp_views", f"WITH {_VIEWS} SELECT run_id, view FROM views")
def _(f):
    return scan.scan_temp_views(f("fx_cell"))


@query("c05_cell_access", f"WITH {_ACCESS} SELECT run_id, cell_index, mode, ref FROM acc")
def _(f):
    return scan.cell_access(f("fx_cell"), "ws0", "lh_def")


@query("c06_run_access", f"WITH {_ACCESS} SELECT run_id, ref, max(mode) AS mode FROM acc GROUP BY run_id, ref")
def _(f):
    return reports.run_access(scan.cell_access(f("fx_cell"), "ws0", "lh_def"))


@query("c07_sql_magic", """
SELECT run_id, cell_index, source LIKE '\\%\\%sql%' ESCAPE '\\' AS is_magic, CASE WHEN source LIKE '\\%\\%sql%' ESCAPE '\\' THEN substr(source, 7) END AS body FROM fx_cell""")
def _(f):
    source = F.col("source")
    return f("fx_cell").select("run_id", "cell_index", scan.is_sql_magic(source).alias("is_magic"), scan.sql_magic_body(source).alias("body"))


@query("c08_sql_statements", """
SELECT run_id, cell_index, CAST(0 AS BIGINT) AS pos, CASE WHEN source LIKE 'spark.sql("%' THEN regexp_extract(source, 'spark\\.sql\\("([^"]*)"\\)', 1) ELSE substr(source, 7) END AS statement
FROM fx_cell WHERE source LIKE 'spark.sql("%' OR source LIKE '\\%\\%sql%' ESCAPE '\\'""")
def _(f):
    return scan.sql_statements(f("fx_cell"))


@query("c09_classify_statement", """
WITH s AS (SELECT run_id, pos, statement, lower(statement) AS low FROM fx_statement_text),
k AS (SELECT run_id, pos, statement, CASE WHEN low LIKE '%temp view%' THEN 'temp_view' WHEN low LIKE 'insert%' THEN 'insert' WHEN low LIKE 'create%' THEN 'ctas' WHEN low LIKE 'merge%' THEN 'merge'
 WHEN low LIKE 'update%' THEN 'update' WHEN low LIKE 'delete%' THEN 'delete' ELSE 'other' END AS kind FROM s)
SELECT run_id, pos, kind, CASE WHEN kind <> 'other' THEN regexp_extract(statement, '(?i)^(?:insert (?:into|overwrite table)|create or replace (?:table|temp view)|merge into|update|delete from) ([\\w.]+)', 1) END AS target,
 CASE WHEN kind = 'merge' THEN regexp_extract(statement, 'USING ([\\w.]+)', 1) END AS "using" FROM k""")
def _(f):
    return f("fx_statement_text").select("run_id", "pos", scan.classify_statement(F.col("statement")).alias("c")).select("run_id", "pos", "c.*")


_FLAGS = """flags AS (SELECT run_id, cell_index, CAST(CASE WHEN source LIKE 'spark.sql("%' OR source LIKE '\\%\\%sql%' ESCAPE '\\' THEN 1 ELSE 0 END AS BIGINT) AS sql_statements,
 source LIKE '%saveAsTable%' OR source LIKE '%.write.%' AS df_write, source = 'spark.sql(query)' AS dynamic_sql, source LIKE 'def broken%' AS unparsable, source LIKE '\\%\\%%' ESCAPE '\\' AS magic FROM fx_cell)"""


@query("c10_scan_cell_flags", f"WITH {_FLAGS} SELECT * FROM flags")
def _(f):
    return scan.scan_cell_flags(f("fx_cell"))


_COUNTS = """counts AS (SELECT run_id, count(*) AS cells, count(*) FILTER (sql_statements > 0) AS sql_cells, CAST(sum(sql_statements) AS BIGINT) AS sql_statements,
 count(*) FILTER (df_write AND sql_statements = 0) AS dataframe_write_cells, count(*) FILTER (dynamic_sql) AS dynamic_sql_cells, count(*) FILTER (unparsable) AS unparsable_cells FROM fx_cell_flags GROUP BY run_id)"""
_WRITES = """wf AS (SELECT a.run_id, a.ref, EXISTS (SELECT 1 FROM fx_column_flow f WHERE f.run_id = a.run_id AND f.to_table = a.ref) AS covered
 FROM (SELECT DISTINCT run_id, ref FROM fx_access WHERE mode = 'write') a)"""


@query("c11_coverage_counts", f"WITH {_COUNTS} SELECT * FROM counts")
def _(f):
    return scan.coverage_counts(f("fx_cell_flags"))


@query("c12_coverage_writes", f"WITH {_WRITES} SELECT run_id, count(*) AS writes, count(*) FILTER (covered) AS writes_with_column_lineage FROM wf GROUP BY run_id")
def _(f):
    return scan.coverage_writes(f("fx_access"), f("fx_column_flow"))


@query("c12_uncovered_writes", f"WITH {_WRITES} SELECT run_id, ref FROM wf WHERE NOT covered")
def _(f):
    return scan.uncovered_writes(f("fx_access"), f("fx_column_flow"))


_Q = {k: v.replace("'", "''") for k, v in vars(fixed).items() if k.startswith("NOTE_")}


@query("c13_coverage_notes", f"""
WITH {_COUNTS}, {_WRITES},
n AS (SELECT run_id, count(*) AS m, array_to_string(list_slice(list_sort(list(ref)), 1, 8), ', ') AS named FROM wf WHERE NOT covered GROUP BY run_id),
w AS (SELECT run_id, count(*) AS writes FROM wf GROUP BY run_id),
l AS (SELECT c.run_id, list_filter([CASE WHEN engine = 'stub' AND dataframe_write_cells > 0 AND m > 0 THEN format('{_Q["NOTE_DATAFRAME"].replace("%s", "{}")}', dataframe_write_cells) END,
 CASE WHEN dynamic_sql_cells > 0 THEN format('{_Q["NOTE_DYNAMIC"].replace("%s", "{}")}', dynamic_sql_cells) END,
 CASE WHEN unparsable_cells > 0 THEN format('{_Q["NOTE_UNPARSABLE"].replace("%s", "{}")}', unparsable_cells) END,
 CASE WHEN m > 0 THEN format('{_Q["NOTE_UNCOVERED"].replace("%s", "{}")}', m, writes, named) END], lambda x: x IS NOT NULL) AS notes
 FROM counts c LEFT JOIN n ON n.run_id = c.run_id LEFT JOIN w ON w.run_id = c.run_id LEFT JOIN fx_step_run s ON s.run_id = c.run_id)
SELECT run_id, unnest(range(0, len(notes))) AS pos, unnest(notes) AS note FROM l""")
def _(f):
    return scan.coverage_notes(
        scan.coverage_counts(f("fx_cell_flags")),
        scan.coverage_writes(f("fx_access"), f("fx_column_flow")),
        scan.uncovered_writes(f("fx_access"), f("fx_column_flow")),
        f("fx_step_run"),
    ).withColumn("pos", F.col("pos").cast("bigint"))


_VIEW_BASES = """SELECT DISTINCT run_id, concat('stage_', pos % 9) AS view, CASE WHEN run_id % 4 <> 0 THEN concat('ws0/lh_bronze/t', run_id % 7) END AS base_ref FROM fx_statement_text"""


@query("c14_statement_reads", f"""
WITH vb AS ({_VIEW_BASES}),
s AS (SELECT run_id, pos, unnest(regexp_extract_all(statement, 'FROM ([\\w.]+)', 1)) AS raw, regexp_extract(statement, '^(?:UPDATE|DELETE FROM) ([\\w.]+)', 1) AS target
 FROM fx_statement_text WHERE statement LIKE 'UPDATE%' OR statement LIKE 'DELETE%')
SELECT DISTINCT run_id, pos, ref FROM (SELECT s.run_id, s.pos, CASE WHEN v.view IS NOT NULL THEN v.base_ref ELSE {_REF} END AS ref, concat('ws0/', replace(target, '.', '/')) AS t
 FROM s LEFT JOIN vb v ON v.run_id = s.run_id AND v.view = s.raw) x WHERE ref IS NOT NULL AND ref <> t""")
def _(f):
    return scan.statement_reads(f("fx_statement_text"), f.sql(_VIEW_BASES), "ws0", "lh_def")


_PASTED = """SELECT c_custkey AS id, concat('a = ', c_nationkey, '\n# --- cell ---\n  ', c_mktsegment, '  \n # --- CELL --- \n\n  z = 1\n#---cell---\n  ') AS text FROM customer"""


@query("a02_split_cells", """
SELECT id, unnest([0, 1, 2]) AS cell_index, unnest([concat('a = ', c_nationkey), c_mktsegment, 'z = 1']) AS source FROM (SELECT c_custkey AS id, * FROM customer) c""")
def _(f):
    return text_sources.split_cells(f.sql(_PASTED), ["id"])


# Letters, marks and digits of any language make up a word.
_WORD = r"\p{L}\p{M}\p{N}_"


@query("c01_scan_documents", f"""
WITH d AS (SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '(?i)(?:^|[^{_WORD}])FROM\\s+([{_WORD}.`]+)', 1),
 regexp_extract_all(text, '(?i)(?:^|[^{_WORD}])JOIN\\s+([{_WORD}.`]+)', 1)))) AS names FROM documents)
SELECT doc_id, len(names) AS n, array_to_string(names, ' ') AS names FROM d""")
def _(f):
    """The read patterns over whole prose documents: what a scan of text without code finds."""
    found = f("documents").select("doc_id", F.array_sort(scan.pattern_matches(F.col("text"), fixed.READ_PATTERNS)).alias("names"))
    return found.select("doc_id", F.size("names").cast("bigint").alias("n"), F.array_join("names", " ").alias("names"))
