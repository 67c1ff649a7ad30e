"""Answers kept as a state that grows by batches: the newest observations of every table.

``newest`` of a union is the ``newest`` of its parts' ``newest``, so partial states may be merged in any order, and a
batch of finished runs updates the answers without a look at older runs. Rows of the columns' state: ref, column, traced, at, run_id, via, seq,
from_table, from_column, transform. Traced rows are the flows of the newest run that wrote the table and
traced the column; the others are the columns, at least one row with a null column, of the newest run that wrote the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import refs
from factloom.session import cut_lineage
from factloom.sources.file_table import FileTable

STATE = ("ref string, column string, traced boolean, at timestamp, run_id bigint, via string, seq bigint, "
         "from_table string, from_column string, transform string")
_COLUMNS = [c.split(" ")[0] for c in STATE.split(", ")]


def observed_columns(flow: DataFrame, schema: DataFrame, access: DataFrame, runs: DataFrame) -> DataFrame:
    """The state rows of some runs, not yet reduced; flows to tables that their run did not write count for nothing."""
    writes = access.filter("mode = 'write'").select("run_id", "ref").distinct().join(runs.select("run_id", "at", F.col("name").alias("via")), "run_id")
    traced = writes.join(
        flow.select("run_id", F.col("to_table").alias("ref"), F.col("to_column").alias("column"), "seq", "from_table", "from_column", "transform"), ["run_id", "ref"])
    known = writes.join(schema.select("run_id", "ref", F.col("name").alias("column")).distinct(), ["run_id", "ref"], "left")
    both = traced.withColumn("traced", F.lit(True)).unionByName(known.drop("via").withColumn("traced", F.lit(False)), allowMissingColumns=True)
    return _shaped(both, STATE)


def newest(state: DataFrame) -> DataFrame:
    """Of each traced column, and of each table's known columns, the rows of the newest run; of runs at one time the first by id.

    Ranks are limited before the shuffle, so a table that every run writes sends one run's rows per task.
    """
    group = F.when(F.col("traced"), F.col("column"))
    age = F.rank().over(Window.partitionBy("ref", "traced", group).orderBy(F.col("at").desc(), F.col("run_id")))
    return state.withColumn("_age", age).filter("_age = 1").select(_COLUMNS).distinct()


def column_sources(state: DataFrame) -> DataFrame:
    """ref, column, from_table, from_column, transform, via as :func:`reports.column_sources` gives them, from a reduced state."""
    key = ["ref", "column"]
    flows = state.filter("traced")
    once = Window.partitionBy(*key, "from_table", "from_column").orderBy("seq")
    found = flows.withColumn("_copy", F.row_number().over(once)).filter("_copy = 1")
    bare = state.filter("NOT traced AND column IS NOT NULL").join(flows.select(*key).distinct(), key, "left_anti")
    return found.unionByName(bare.withColumn("_copy", F.lit(1))).select(*key, "from_table", "from_column", "transform", "via")


# -- touches, consumers, real runs ---------------------------------------------

TOUCHES = "ref string, mode string, name string, at timestamp"
CONSUMERS = "ref string, checked boolean, at timestamp, run_id bigint, consumer_name string, consumer_kind string"
REAL_RUNS = ("ref string, at timestamp, run_id bigint, entry_id bigint, submitted_at timestamp, state string, submitter string, "
             "code_changed_at timestamp, via string")


def _shaped(rows: DataFrame, ddl: str) -> DataFrame:
    return rows.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in (c.split(" ") for c in ddl.split(", "))))


def observed_touches(access: DataFrame, runs: DataFrame) -> DataFrame:
    return _shaped(access.join(runs.select("run_id", "at", "name"), "run_id"), TOUCHES)


def newest_touches(state: DataFrame) -> DataFrame:
    return state.groupBy("ref", "mode", "name").agg(F.max("at").alias("at"))


def observed_consumers(downstream: DataFrame, access: DataFrame, runs: DataFrame) -> DataFrame:
    """A row without a time for every written table, and the consumers that its writers found, where one looked."""
    writes = access.filter("mode = 'write'").select("run_id", "ref").distinct()
    found = downstream.filter("available").join(runs.select("run_id", "at"), "run_id").join(writes, "run_id").withColumn("checked", F.lit(True))
    return _shaped(found, CONSUMERS).unionByName(_shaped(writes.select("ref", F.lit(False).alias("checked"), *(
        F.lit(None).alias(c) for c in ("at", "run_id", "consumer_name", "consumer_kind"))), CONSUMERS))


def newest_consumers(state: DataFrame) -> DataFrame:
    age = F.rank().over(Window.partitionBy("ref", "checked").orderBy(F.col("at").desc(), F.col("run_id")))
    return state.withColumn("_age", age).filter("_age = 1").drop("_age").distinct()


def observed_real_runs(observed: DataFrame, access: DataFrame, runs: DataFrame) -> DataFrame:
    writes = access.filter("mode = 'write'").select("run_id", "ref").distinct()
    return _shaped(writes.join(observed.filter("available"), "run_id").join(runs.select("run_id", "at", F.col("name").alias("via")), "run_id"), REAL_RUNS)


def newest_real_runs(state: DataFrame) -> DataFrame:
    order = F.struct(-F.unix_micros("at"), "run_id", "entry_id")
    return state.groupBy("ref").agg(F.min_by(F.struct(*(c for c in state.columns if c != "ref")), order).alias("r")).select("ref", "r.*")


#: kind of answer: columns of its state, how rows are reduced
KINDS = {
    "columns": (STATE, newest), "touches": (TOUCHES, newest_touches), "consumers": (CONSUMERS, newest_consumers), "real_runs": (REAL_RUNS, newest_real_runs)}


class AnswerStore:
    """One state per kind of answer, each in a table of files: a batch rewrites the files that hold one of its tables, and adds those of new tables.

    Rows are written in ranges of lower-cased table names, so one name's tables lie in few files and a question reads few.
    Every run is whole in one batch, and a batch may be added again.
    """

    def __init__(self, spark, path: str, kinds=tuple(KINDS)):
        self.tables = {kind: FileTable(spark, f"{path}/{kind}", KINDS[kind][0]) for kind in kinds}

    def add(self, access: DataFrame, runs: DataFrame, flow: DataFrame | None = None, schema: DataFrame | None = None,
            downstream: DataFrame | None = None, observed: DataFrame | None = None) -> None:
        """Merge the runs of one batch: into the states whose facts are given, touches always."""
        facts = {"touches": lambda: observed_touches(access, runs)}
        if flow is not None and schema is not None:
            facts["columns"] = lambda: observed_columns(flow, schema, access, runs)
        if downstream is not None:
            facts["consumers"] = lambda: observed_consumers(downstream, access, runs)
        if observed is not None:
            facts["real_runs"] = lambda: observed_real_runs(observed, access, runs)
        for kind, table in self.tables.items():
            if kind in facts:
                self._merge(table, facts[kind](), KINDS[kind][1])

    def _merge(self, table: FileTable, rows: DataFrame, reduce) -> None:
        batch = cut_lineage(reduce(rows).select(table.schema.names))
        names = batch.select("ref").distinct()

        def merged(held):
            return reduce(held.unionByName(batch)).repartitionByRange(F.lower(refs.ref_label(F.col("ref"))), *table.schema.names[:2])

        table._change(lambda held: held.join(names, "ref", "left_semi"), merged)

    def column_sources(self) -> DataFrame:
        return column_sources(self.tables["columns"].read())

    def touched_by(self) -> DataFrame:
        return self.tables["touches"].read()

    def downstream_consumers(self) -> DataFrame:
        """ref, consumer_name, consumer_kind, checked; a table that nobody checked has one row."""
        state = self.tables["consumers"].read()
        checked = state.filter("checked")
        open_ = state.filter("NOT checked").join(checked.select("ref").distinct(), "ref", "left_anti")
        return checked.unionByName(open_).select("ref", "consumer_name", "consumer_kind", "checked")

    def last_real_run(self) -> DataFrame:
        return self.tables["real_runs"].read().select("ref", "submitted_at", "state", "submitter", "code_changed_at", "via").withColumn(
            "code_changed_since_run", F.coalesce(F.col("code_changed_at") > F.col("submitted_at"), F.lit(False)))
