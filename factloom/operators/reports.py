"""Reports over saved runs: coverage, gaps, diffs, observed runs, answers.

Grain: one row of ``runs`` is one observation (``run_id``, ``at``, ``name`` ...).
Groups keyed by a table, a name or a workspace can be arbitrarily large, so they
are only ever reduced by aggregates that combine before the shuffle or by
"first k per group" windows, which Spark also limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import fixed
from factloom.functions import refs
from factloom.operators.ordering import number_rows
from factloom.session import cut_lineage


def _newest_first() -> list[Column]:
    return [F.col("at").desc(), F.col("run_id").asc()]


def _micros(at: str) -> Column:
    """Microseconds of a timestamp with or without time zone."""
    return F.unix_micros(F.col(at).cast("timestamp"))


def _age(at: str = "at", tie: str = "run_id") -> Column:
    """Sort key whose minimum is the newest row; ties go to the smaller id."""
    return F.struct(-_micros(at), F.col(tie))


def run_access(access: DataFrame) -> DataFrame:
    """Distinct accesses of a run; a ref both read and written counts as a write."""
    written = F.bool_or(F.col("mode") == "write")
    return access.groupBy("run_id", "ref").agg(F.when(written, "write").otherwise("read").alias("mode"))


# -- answers about a table ---------------------------------------------------


def column_sources(flow: DataFrame, schema: DataFrame, access: DataFrame, runs: DataFrame) -> DataFrame:
    """Where each column of each written table comes from.

    Sources are those of the newest run that wrote the column; a column the
    newest writer reports but nothing traces appears with null sources. A flow to a table
    that its run did not write counts for nothing.
    """
    flow = _to_written(flow, access)
    newest_write = (
        access.filter("mode = 'write'")
        .join(runs.select("run_id", "at"), "run_id")
        .groupBy("ref")
        .agg(F.min_by("run_id", _age()).alias("run_id"))
    )
    known = schema.join(newest_write, ["run_id", "ref"], "left_semi").select(
        "ref", F.col("name").alias("column"), F.lit(False).alias("traced")).distinct()
    traced = (
        flow.select("run_id", "seq", F.col("to_table").alias("ref"), F.col("to_column").alias("column"),
                    "from_table", "from_column", "transform", F.lit(True).alias("traced"))
        .join(runs.select("run_id", "at", F.col("name").alias("via")), "run_id")
    )
    # A known column is an observation older than any other: it shows only where no flow does.
    latest = Window.partitionBy("ref", "column").orderBy(F.col("traced").desc(), *_newest_first())
    once = Window.partitionBy("ref", "column", "from_table", "from_column").orderBy("seq")
    return (
        traced.unionByName(known, allowMissingColumns=True)
        .withColumn("_age", F.rank().over(latest))
        .filter("_age = 1")
        .withColumn("_copy", F.row_number().over(once))
        .filter("_copy = 1")
        .select("ref", "column", "from_table", "from_column", "transform", "via")
    )


def _to_written(flow: DataFrame, access: DataFrame) -> DataFrame:
    """Flows to tables that their run wrote. Writes are stacked on the flows, so that facts that lie together by run stay there."""
    marks = access.filter("mode = 'write' AND run_id IS NOT NULL AND ref IS NOT NULL").select("run_id", F.col("ref").alias("to_table"), F.lit(True).alias("_write"))
    stacked = flow.withColumn("_write", F.lit(False)).unionByName(marks, allowMissingColumns=True)
    wrote = F.max("_write").over(Window.partitionBy("run_id", "to_table"))
    return stacked.withColumn("_wrote", wrote).filter("_wrote AND NOT _write").select(flow.columns)


def touched_by(access: DataFrame, runs: DataFrame) -> DataFrame:
    """Steps that wrote or read each table, with their newest touch."""
    return (
        access.join(runs.select("run_id", "at", "name"), "run_id")
        .groupBy("ref", "mode", "name")
        .agg(F.max("at").alias("at"))
    )


def downstream_consumers(downstream: DataFrame, access: DataFrame, runs: DataFrame) -> DataFrame:
    """Consumers of each written table from the newest writer that checked.

    ``checked = false`` means nothing looked, which is not "nothing reads it".
    """
    writes = access.filter("mode = 'write'").select("run_id", "ref").distinct()
    newest = Window.partitionBy("ref").orderBy(*_newest_first())
    checked = (
        downstream.filter("available")
        .join(runs.select("run_id", "at"), "run_id")
        .join(writes, "run_id")
        .withColumn("_age", F.rank().over(newest))
        .filter("_age = 1")
        .select("ref", "consumer_name", "consumer_kind", F.lit(True).alias("checked"))
    )
    return (
        writes.select("ref").distinct().join(checked, "ref", "left")
        .withColumn("checked", F.coalesce("checked", F.lit(False)))
    )


def last_real_run(observed: DataFrame, access: DataFrame, runs: DataFrame) -> DataFrame:
    """The newest writing observation that has run history, per table."""
    row = F.struct("submitted_at", "state", "submitter", "code_changed_at", F.col("name").alias("via"))
    order = F.struct(-_micros("at"), F.col("run_id"), F.col("entry_id"))
    return (
        access.filter("mode = 'write'").select("run_id", "ref").distinct()
        .join(observed.filter("available"), "run_id")
        .join(runs.select("run_id", "at", "name"), "run_id")
        .groupBy("ref")
        .agg(F.min_by(row, order).alias("r"))
        .select("ref", "r.*")
        .withColumn("code_changed_since_run", F.coalesce(F.col("code_changed_at") > F.col("submitted_at"), F.lit(False)))
    )


def table_match(questions: DataFrame, access: DataFrame) -> DataFrame:
    """Refs each question names: case-insensitive table, optional lakehouse.

    One row per question and matched ref; a question no run touched stays with a
    null ref and ``unexamined = true``; several refs make it ``ambiguous``.
    """
    seen = access.select("ref").distinct().select(
        "ref",
        F.lower(refs.ref_label(F.col("ref"))).alias("_table"),
        F.lower(refs.ref_lakehouse(F.col("ref"))).alias("_lakehouse"),
    )
    same_table = F.lower("table_name") == F.col("_table")
    same_lake = F.col("lakehouse").isNull() | (F.col("lakehouse") == "") | (F.lower("lakehouse") == F.col("_lakehouse"))
    found = questions.join(seen, same_table & same_lake, "left").select("table_name", "lakehouse", "ref")
    counts = found.groupBy("table_name", "lakehouse").agg(F.count("ref").alias("_n"))
    return (
        found.join(
            counts.withColumnsRenamed({"table_name": "_t", "lakehouse": "_l"}),
            (F.col("table_name") == F.col("_t")) & F.col("lakehouse").eqNullSafe(F.col("_l")),
        )
        .select(
            "table_name", "lakehouse", "ref",
            (F.col("_n") > 1).alias("ambiguous"),
            (F.col("_n") == 0).alias("unexamined"),
        )
    )


def asked(facts: DataFrame, named: DataFrame, column: str = "ref") -> DataFrame:
    """Facts about the tables that questions name, with the question in place of the table.

    ``named``: question, ref. All tables that one question names become one, so that the operators above answer per question: the newest
    writer is the newest of any of them. A table that several questions name counts for each.
    """
    # Written first, so that their size is known: few pairs go to the facts, which stay in their tasks.
    pairs = cut_lineage(named.filter("ref IS NOT NULL").select("question", F.col("ref").alias(column)).distinct().coalesce(1))
    return facts.join(pairs, column).withColumn(column, F.col("question")).select(facts.columns).distinct()


# -- coverage ----------------------------------------------------------------


def bare_write_reason(engine: Column, has_coverage: Column) -> Column:
    """Why a written table has no column lineage, from its run's counts."""
    return (
        F.when(~has_coverage, fixed.REASON_PREDATES)
        .when(F.col("dataframe_write_cells") > 0, F.format_string(fixed.REASON_DATAFRAME, engine))
        .when(F.col("dynamic_sql_cells") > 0, fixed.REASON_DYNAMIC)
        .when(F.col("unparsable_cells") > 0, fixed.REASON_UNPARSABLE)
        .otherwise(fixed.REASON_NONE)
    )


def _coverage_facts(access, flow, schema, requests) -> DataFrame:
    """One row per (run, ref) with what the run knows about the ref.

    The four inputs are stacked and reduced in one shuffle instead of being
    joined three times.
    """
    no, yes = F.lit(False), F.lit(True)

    def fact(df, ref, touched=no, written=no, traced=no, described=no, unresolved=no):
        return df.select(
            "run_id", F.col(ref).alias("ref"), touched.alias("touched"), written.alias("written"),
            traced.alias("traced"), described.alias("described"), unresolved.alias("unresolved"),
        )

    stacked = (
        fact(access, "ref", touched=yes, written=F.col("mode") == "write")
        .unionByName(fact(flow, "to_table", traced=yes))
        .unionByName(fact(schema, "ref", described=yes))
        .unionByName(fact(requests.filter("state = 'unresolved'"), "ref", unresolved=yes))
    )
    flags = ["touched", "written", "traced", "described", "unresolved"]
    return stacked.groupBy("run_id", "ref").agg(*[F.bool_or(f).alias(f) for f in flags]).filter("touched")


def table_coverage(
    access: DataFrame, flow: DataFrame, schema: DataFrame, requests: DataFrame, coverage: DataFrame, runs: DataFrame
) -> DataFrame:
    """Best verdict per table over all runs, with the first reason given at that level."""
    failure = requests.filter("failure IS NOT NULL").groupBy("run_id").agg(F.min_by("failure", F.struct("seq", "ref")).alias("failure"))
    per_run = (
        runs.select("run_id", "at", "engine")
        .join(coverage.withColumn("has_coverage", F.lit(True)), "run_id", "left")
        .join(failure, "run_id", "left")
    )
    unread = F.when(F.col("failure").isNotNull(), F.format_string(fixed.REASON_UNREADABLE, F.col("failure"))).otherwise(
        fixed.REASON_UNRESOLVED
    )
    has_coverage = F.coalesce("has_coverage", F.lit(False))
    verdict = (
        F.when(F.col("traced"), F.struct(F.lit(2).alias("rank"), F.lit(fixed.TRACED).alias("level"), F.lit("").alias("reason")))
        .when(
            ~F.col("described"),
            F.struct(F.lit(0).alias("rank"), F.lit(fixed.BARE).alias("level"),
                     F.when(F.col("unresolved"), unread).otherwise(fixed.REASON_NO_COLUMNS).alias("reason")),
        )
        .otherwise(
            F.struct(F.lit(1).alias("rank"), F.lit(fixed.COLUMNS_ONLY).alias("level"),
                     F.when(F.col("written"), bare_write_reason(F.col("engine"), has_coverage))
                     .otherwise(fixed.REASON_READ_ONLY).alias("reason"))
        )
    )
    return (
        _coverage_facts(access, flow, schema, requests)
        .join(per_run, "run_id")
        .withColumn("v", verdict)
        .groupBy("ref")
        .agg(
            F.min_by("v", F.struct(-F.col("v.rank"), _micros("at"), F.col("run_id"))).alias("v"),
            F.bool_or("written").alias("written"),
        )
        .select("ref", "v.level", "v.reason", "written")
    )


def coverage_summary(verdicts: DataFrame) -> DataFrame:
    def total(level):
        return F.coalesce(F.sum(F.when(F.col("level") == level, 1).otherwise(0)), F.lit(0)).cast("bigint")

    return verdicts.agg(
        F.count("*").alias("tables"),
        total(fixed.TRACED).alias("traced"),
        total(fixed.COLUMNS_ONLY).alias("columns_only"),
        total(fixed.BARE).alias("bare"),
    )


def lineage_gaps(verdicts: DataFrame) -> DataFrame:
    """Tables not fully traced, bare first; a read-only table with known columns is no gap."""
    return (
        verdicts.filter((F.col("level") == fixed.BARE) | ((F.col("level") == fixed.COLUMNS_ONLY) & F.col("written")))
        .select("ref", "level", "reason")
        .orderBy(F.when(F.col("level") == fixed.BARE, 0).otherwise(1), "ref")
    )


def gap_notes(gaps: DataFrame, notes: DataFrame) -> DataFrame:
    """Latest note per gap; a blank note deletes."""
    latest = (
        notes.groupBy("ref")
        .agg(F.max(F.struct("updated_at", F.trim("note").alias("note"))).alias("n"))
        .filter("n.note <> ''")
        .select("ref", "n.note", "n.updated_at")
    )
    return gaps.join(latest, "ref", "left")


# -- run history -------------------------------------------------------------


def last_two_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """The newest run per group and the one before it."""
    newest = Window.partitionBy(*by).orderBy(*_newest_first())
    return (
        runs.withColumn("_n", F.row_number().over(newest))
        .filter("_n <= 2")
        .groupBy(*by)
        .agg(
            F.max(F.when(F.col("_n") == 1, F.col("run_id"))).alias("latest"),
            F.max(F.when(F.col("_n") == 2, F.col("run_id"))).alias("previous"),
        )
    )


def retain_runs(runs: DataFrame, by: list[str], max_runs: int = 5, max_bytes: int = 1_000_000) -> DataFrame:
    """Runs kept per group: newest first while they fit, at least one.

    A run over the budget on its own is never saved and evicts nothing. The
    budget counts the saved list as written: the runs, the commas between them
    and the two brackets.
    """
    newest = Window.partitionBy(*by).orderBy(*_newest_first())
    so_far = newest.rowsBetween(Window.unboundedPreceding, 0)
    return (
        runs.filter(F.col("size_bytes") <= max_bytes)
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= max_runs)
        .withColumn("total", F.sum("size_bytes").over(so_far) + F.col("position") + 1)
        .filter((F.col("position") == 1) | (F.col("total") <= max_bytes))
        .select(*by, "run_id", F.col("position").cast("bigint").alias("position"))
    )


def run_diff(pairs: DataFrame, access: DataFrame, schema: DataFrame, flow: DataFrame, by: list[str]) -> DataFrame:
    """What changed between ``previous`` and ``latest`` of each pair.

    One row per change. Lost lineage is reported only for a table still touched:
    one that went away is a removed table. A pair without a previous run has no
    changes.
    """
    known = pairs.filter("previous IS NOT NULL AND latest IS NOT NULL")
    sides = known.select(*by, F.col("previous").alias("run_id"), F.lit(False).alias("now")).unionByName(
        known.select(*by, F.col("latest").alias("run_id"), F.lit(True).alias("now"))
    )

    def items(df, kind, ref, column=None):
        return df.select("run_id", F.lit(kind).alias("kind"), F.col(ref).alias("ref"),
                         (F.col(column) if column else F.lit("")).alias("column"))

    stacked = (
        items(access, "table", "ref")
        .unionByName(items(schema, "column", "ref", "name"))
        .unionByName(items(flow, "traced", "to_table"))
        .join(sides, "run_id")
    )

    def side(kind, now):
        return F.coalesce(F.bool_or((F.col("kind") == kind) & (F.col("now") == now)), F.lit(False))

    flags = stacked.groupBy(*by, "ref", "column").agg(
        *[side(kind, now).alias(f"{kind}_{'now' if now else 'before'}") for kind in ("table", "column", "traced") for now in (False, True)]
    )
    change = F.filter(
        F.array(
            F.when(F.expr("table_now AND NOT table_before"), "added_table"),
            F.when(F.expr("table_before AND NOT table_now"), "removed_table"),
            F.when(F.expr("column_now AND NOT column_before"), "added_column"),
            F.when(F.expr("column_before AND NOT column_now"), "removed_column"),
            F.when(F.expr("traced_before AND table_now AND NOT traced_now"), "lost_lineage"),
        ),
        lambda c: c.isNotNull(),
    )
    return flags.select(*by, "ref", "column", F.explode(change).alias("change"))


def diff_is_clean(pairs: DataFrame, diff: DataFrame, by: list[str]) -> DataFrame:
    """One verdict per pair: ``empty`` without a previous run, ``clean`` without changes."""
    counts = diff.groupBy(*by).agg(F.count("*").alias("changes"))
    return pairs.join(counts, by, "left").select(
        *by,
        F.col("previous").isNull().alias("empty"),
        F.coalesce("changes", F.lit(0)).alias("changes"),
        (F.coalesce("changes", F.lit(0)) == 0).alias("clean"),
    )


# -- prediction and observation ----------------------------------------------


def compare_runs(predicted: DataFrame, observed: DataFrame) -> DataFrame:
    """Each (run, mode, ref) as agreed, predicted_only or observed_only."""
    stacked = predicted.select("run_id", "mode", "ref", F.lit(True).alias("p"), F.lit(False).alias("o")).unionByName(
        observed.select("run_id", "mode", "ref", F.lit(False).alias("p"), F.lit(True).alias("o"))
    )
    return (
        stacked.groupBy("run_id", "mode", "ref")
        .agg(F.bool_or("p").alias("p"), F.bool_or("o").alias("o"))
        .select(
            "run_id", "mode", "ref",
            F.when(F.col("p") & F.col("o"), "agreed").when(F.col("p"), "predicted_only").otherwise("observed_only").alias("side"),
        )
    )


def observed_rollup(statements: DataFrame) -> DataFrame:
    """A run's observed statements: how many, how many named a table, how many tables."""
    def tables(mode):
        return F.count_distinct(F.when(F.col("mode") == mode, F.col("ref")))

    return statements.groupBy("run_id").agg(
        F.count_distinct("execution_id").alias("statements"),
        F.count_distinct(F.when(F.col("ref").isNotNull(), F.col("execution_id"))).alias("resolved"),
        tables("read").alias("reads"),
        tables("write").alias("writes"),
    )


def observed_refs(statements: DataFrame) -> DataFrame:
    """The tables a run really touched, from its statements."""
    return statements.filter("ref IS NOT NULL").select("run_id", "mode", "ref").distinct()


def observed_summary(observed: DataFrame, comparison: DataFrame) -> DataFrame:
    """Run-level totals; a ref agreed anywhere in the run is no longer predicted-only."""
    newest = F.when(F.col("available"), F.struct("submitted_at", "submitter", "state"))
    order = F.when(F.col("available"), F.struct(-_micros("submitted_at"), F.col("entry_id")))
    runs = observed.groupBy("run_id").agg(
        F.count("*").alias("asked"),
        F.sum(F.col("available").cast("bigint")).alias("available"),
        F.count_distinct(F.when(~F.col("available"), F.col("note"))).alias("notes"),
        F.min_by(newest, order).alias("last"),
        F.coalesce(F.bool_or(F.col("available") & (F.col("code_changed_at") > F.col("submitted_at"))), F.lit(False)).alias("code_is_newer"),
    )
    sides = comparison.groupBy("run_id", "ref").agg(
        *[F.bool_or(F.col("side") == s).alias(s) for s in ("agreed", "predicted_only", "observed_only")]
    )
    totals = sides.groupBy("run_id").agg(
        F.count_if("agreed").alias("agreed"),
        F.count_if(F.expr("predicted_only AND NOT agreed")).alias("predicted_only"),
        F.count_if("observed_only").alias("observed_only"),
    )

    def total(name):
        return F.when(F.col("available") > 0, F.coalesce(name, F.lit(0))).otherwise(0).alias(name)

    return runs.join(totals, "run_id", "left").select(
        "run_id", "asked", "available", "notes",
        F.col("last.submitted_at").alias("last_run_at"), F.col("last.submitter").alias("last_run_by"),
        F.col("last.state").alias("last_run_state"), "code_is_newer",
        total("agreed"), total("predicted_only"), total("observed_only"),
    )


def observed_tables(observed: DataFrame, comparison: DataFrame) -> DataFrame:
    """Which tables a run's history confirms, misses or adds, for runs that have one: run_id, ref, verdict.

    A ref agreed anywhere in the run is not ``predicted_only``, but may be ``observed_only`` in the other mode.
    """
    known = observed.filter("available").select("run_id").distinct()
    sides = comparison.join(known, "run_id", "left_semi").groupBy("run_id", "ref").agg(F.collect_set("side").alias("sides"))
    kept = F.filter("sides", lambda side: (side != "predicted_only") | ~F.array_contains("sides", "agreed"))
    return sides.select("run_id", "ref", F.explode(kept).alias("verdict"))


def observed_notes(observed: DataFrame) -> DataFrame:
    """Why a history could not be read, each note once per run."""
    return observed.filter("NOT available AND note IS NOT NULL").select("run_id", "note").distinct()


def _plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count == 1, "").otherwise("s"))


def observed_headline(summary: DataFrame) -> DataFrame:
    """One sentence per run, and whether prediction and observation line up."""
    predicted = F.col("agreed") + F.col("predicted_only")
    confirmed = F.when(
        predicted > 0,
        F.concat(F.col("agreed").cast("string"), F.lit(" of "), _plural(predicted, "predicted table"), F.lit(" confirmed by the last real run")),
    ).otherwise("Compared against the last real run")
    missed = F.when(
        F.col("observed_only") > 0,
        F.concat(_plural(F.col("observed_only"), "table"), F.lit(" the run touched that this analysis did not predict")),
    )
    edited = F.when(F.col("code_is_newer"), "the notebook has been edited since that run")
    return summary.select(
        "run_id",
        F.when(F.col("available") == 0, "No readable run history for these notebooks.")
        .otherwise(F.concat_ws(" · ", confirmed, missed, edited))
        .alias("headline"),
        ((F.col("available") > 0) & (F.col("observed_only") == 0) & ((F.col("predicted_only") == 0) | F.col("code_is_newer"))).alias("agrees"),
    )


# -- run reports -------------------------------------------------------------


def run_failures(step_errors: DataFrame, entry_errors: DataFrame, cells: DataFrame) -> DataFrame:
    """Everything that went wrong: steps, entries, and cells inside steps that finished."""
    def whole(df, kind):
        return df.filter("error IS NOT NULL AND error <> ''").select(
            "run_id", F.lit(kind).alias("kind"), "name", F.lit(None).cast("bigint").alias("cell"), "error")

    broken = cells.filter("status = 'error' AND error IS NOT NULL AND error <> ''").select(
        "run_id", F.lit("cell").alias("kind"), "name", (F.col("cell_index") + 1).cast("bigint").alias("cell"), "error")
    return whole(step_errors, "step").unionByName(whole(entry_errors, "entry")).unionByName(broken)


def run_narrative(runs: DataFrame, cells: DataFrame, access: DataFrame, bare: DataFrame, failures: DataFrame) -> DataFrame:
    """The run in one sentence, failures last."""
    ran = runs.groupBy("run_id").agg(F.count("*").alias("notebooks"))
    counted = cells.groupBy("run_id").agg(F.count("*").alias("cells"))
    touched = access.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("mode") == "read", F.col("ref"))).alias("reads"),
        F.count_distinct(F.when(F.col("mode") == "write", F.col("ref"))).alias("writes"),
    )
    uncovered = bare.groupBy("run_id").agg(F.count_distinct("ref").alias("bare"))
    failed = failures.groupBy("run_id").agg(
        F.count_if(F.col("kind") == "cell").alias("failed_cells"), F.count_if(F.col("kind") != "cell").alias("failed_steps"))
    joined = ran
    for part in (counted, touched, uncovered, failed):
        joined = joined.join(part, "run_id", "left")
    joined = joined.fillna(0)
    io = F.when(
        (F.col("reads") > 0) | (F.col("writes") > 0),
        F.concat(F.lit("read "), _plural(F.col("reads"), "table"), F.lit(", wrote "), F.col("writes").cast("string")),
    ).otherwise("touched no tables")
    sentence = F.concat(
        F.lit("Ran "),
        F.concat_ws(", ", _plural(F.col("notebooks"), "notebook"), F.when(F.col("cells") > 0, _plural(F.col("cells"), "cell"))),
        F.lit(" — "), io,
        F.when(F.col("bare") > 0, F.concat(F.lit(", "), F.col("bare").cast("string"), F.lit(" without column lineage"))).otherwise(""),
        F.lit("."),
        F.when(F.col("failed_cells") > 0, F.concat(F.lit(" — "), _plural(F.col("failed_cells"), "cell"), F.lit(" failed")))
        .when(F.col("failed_steps") > 0, F.concat(F.lit(" — "), _plural(F.col("failed_steps"), "step"), F.lit(" failed")))
        .otherwise(""),
    )
    return joined.select("run_id", sentence.alias("narrative"))


def run_report(runs: DataFrame, access: DataFrame, requests: DataFrame, flow: DataFrame, coverage: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per run: size, schemas read, lineage coverage, confirmation, reasons."""
    head = runs.groupBy("run_id").agg(
        F.min_by("engine", "at").alias("engine"), F.count("*").alias("notebooks"), F.bool_or("saw_credentials").alias("breach"))
    facts = (
        access.select("run_id", "ref", "mode")
        .unionByName(flow.select("run_id", F.col("to_table").alias("ref"), F.lit("traced").alias("mode")))
        .unionByName(requests.select("run_id", "ref", F.when(F.col("state") == "resolved", "resolved").otherwise("requested").alias("mode")))
        .groupBy("run_id", "ref")
        .agg(*[F.bool_or(F.col("mode") == m).alias(m) for m in ("read", "write", "traced", "resolved", "requested")])
        .groupBy("run_id")
        .agg(
            F.count_if("read").alias("reads"),
            F.count_if("write").alias("writes"),
            F.count_if(F.expr("write AND traced")).alias("covered_writes"),
            F.count_if("resolved").alias("schemas_resolved"),
            F.count_if(F.expr("resolved OR requested")).alias("schemas_requested"),
        )
    )
    reasons = coverage.select(
        "run_id",
        F.concat_ws(
            ",",
            F.when(F.col("dataframe_write_cells") > 0, "dataframe"),
            F.when(F.col("dynamic_sql_cells") > 0, "dynamic-sql"),
            F.when(F.col("unparsable_cells") > 0, "unparsable"),
        ).alias("reasons"),
    )
    confirmed = summary.select("run_id", F.col("agreed").alias("confirmed"), (F.col("agreed") + F.col("predicted_only")).alias("comparable"))
    report = head.join(facts, "run_id", "left").join(reasons, "run_id", "left").join(confirmed, "run_id", "left")
    return report.fillna(0, ["reads", "writes", "covered_writes", "schemas_resolved", "schemas_requested"])


def run_markdown(steps: DataFrame, access: DataFrame, flow: DataFrame, gaps: DataFrame) -> DataFrame:
    """Runs as Markdown, one row per line: run_id, section, k1, k2, line, to be sorted by the keys.

    ``steps``: run_id, seq, name, status, error, engine. ``access``: run_id, seq (of the step), mode, ref, touched. ``flow``: run_id, seq, pos,
    to_table, to_column, from_table, from_column. ``gaps``: run_id, ref, level, reason, seq. Lines stay rows: a long report is never collected
    into one string. Only what one step reads or writes, and the engines of a run, are put into one line.

    Reports of up to ``LONG`` rows are made in one pass over the rows of the run, which stay in their task where the facts are placed by run;
    a longer one is numbered and joined by shuffles that divide it.
    """
    facts = steps, access, flow, gaps
    sizes = steps.select("run_id").unionByName(flow.select("run_id")).unionByName(gaps.select("run_id")).groupBy("run_id").count()
    long = cut_lineage(sizes.filter(F.col("count") > LONG).select("run_id"))
    if long.isEmpty():
        return _markdown_lines(_told_in_order(*facts))
    short = (df.join(F.broadcast(long), "run_id", "left_anti") for df in facts)
    rest = (df.join(F.broadcast(long), "run_id", "left_semi") for df in facts)
    return _markdown_lines(_told_in_order(*short)).unionByName(_markdown_lines(_told_by_joins(*rest)))


#: rows of a run that one task may go through: its steps, flows and gaps
LONG = 100_000
#: what a row of a report tells of; of one step, what it touched comes first
_TOUCHED, _STEP, _FLOW, _GAP, _RUN = range(5)


def _told(steps: DataFrame, access: DataFrame, flow: DataFrame, gaps: DataFrame) -> list[DataFrame]:
    """What was touched, steps, flows, gaps and runs, with what their lines say of themselves alone."""
    label = lambda ref: refs.ref_label(F.col(ref))

    def listed(mode):
        """By first touch within the step; a table it touches twice is named once."""
        touches = F.filter("touches", lambda t: t["mode"] == mode)
        once = F.array_distinct(touches["ref"])
        labels = F.when(F.size(once) == F.size(touches), touches["label"]).otherwise(F.transform(once, refs.ref_label))
        return F.nullif(F.array_join(labels, ", "), F.lit("")).alias(mode)

    kind = lambda k: F.lit(k).alias("kind")
    touches = F.sort_array(F.collect_list(F.struct("mode", "touched", label("ref").alias("label"), "ref")))
    touched = (
        access.groupBy("run_id", "seq").agg(touches.alias("touches"))
        .select("run_id", kind(_TOUCHED), "seq", listed("read"), listed("write")))
    ended = F.concat(F.lit("** — "), F.col("status"), F.when(F.coalesce("error", F.lit("")) != "", F.concat(F.lit(": "), F.col("error"))).otherwise(""))
    step = steps.select("run_id", kind(_STEP), "seq", "name", ended.alias("text"))
    source = F.when(F.coalesce("from_table", F.lit("")) == "", F.col("from_column")).otherwise(F.concat(label("from_table"), F.lit("."), F.col("from_column")))
    flows = flow.select(
        "run_id", kind(_FLOW), "seq", "pos", F.concat(F.lit("| "), label("to_table"), F.lit("."), F.col("to_column"), F.lit(" | "), source, F.lit(" | ")).alias("text"))
    reason = F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(fixed.REPORT_NO_REASON)
    missing = gaps.select(
        "run_id", kind(_GAP), "seq", F.when(F.col("level") == fixed.BARE, 0).otherwise(1).alias("pos"),
        F.concat(F.lit("- **"), label("ref"), F.lit("** — "), reason).alias("text"))
    engine = F.when((F.col("engine") != "") & F.col("run_id").isNotNull(), F.struct("at", "engine"))
    used = F.array_join(F.sort_array(F.collect_list(engine))["engine"], " and ")
    runs = (
        steps.groupBy("run_id", "engine").agg(F.count("*").alias("n"), F.min("seq").alias("at"))
        .groupBy("run_id").agg(F.sum("n").alias("n"), F.nullif(used, F.lit("")).alias("text")).select("run_id", kind(_RUN), "n", "text"))
    return [touched, step, flows, missing, runs]


def _told_in_order(*facts: DataFrame) -> DataFrame:
    """All that is told of a run in the order of its steps, its own row last: each row takes from those before it."""
    # A name of its own: with a table's name before it, a union of frames placed by run does not count as placed.
    told, *others = (df.withColumn("run_id", F.col("run_id").alias("run_id")) for df in _told(*facts))
    for other in others:
        told = told.unionByName(other, allowMissingColumns=True)
    told = told.withColumn("last", F.col("kind") == _RUN)
    is_a = lambda k: F.col("kind") == k
    in_run = Window.partitionBy("run_id").orderBy("last", "seq", "kind", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_step = Window.partitionBy("run_id", "last", "seq").orderBy("kind", "name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    keyed = F.col("run_id").isNotNull() & F.col("seq").isNotNull()  # others meet nothing, as in a join
    named = F.when(is_a(_STEP) & keyed, F.struct("name"))
    return (
        told.withColumn("number", F.count(F.when(is_a(_STEP), 1)).over(in_run))
        .withColumns({mode: F.first(F.when(keyed, F.col(mode)), ignorenulls=True).over(of_step) for mode in ("read", "write")} | {"steps": F.collect_list(named).over(of_step)})
        .withColumns({"flows": F.max(is_a(_FLOW) & (F.size("steps") > 0)).over(in_run), "gaps": F.max(is_a(_GAP) & F.col("run_id").isNotNull()).over(in_run)})
        .filter(~is_a(_TOUCHED)))


def _told_by_joins(*facts: DataFrame) -> DataFrame:
    """The same for runs of any length."""
    touched, step, flows, missing, runs = _told(*facts)
    numbered = number_rows(step, ["run_id"], ["seq", "name"], "number").join(touched.drop("kind"), ["run_id", "seq"], "left")
    via = flows.join(step.select("run_id", "seq", F.array(F.struct("name")).alias("steps")), ["run_id", "seq"])
    for name, found in (("flows", via), ("gaps", missing)):
        some = found.select("run_id").distinct().withColumn(name, F.lit(True))
        runs = runs.join(some, "run_id", "left").fillna(False, [name])
    told = numbered
    for other in (via, missing, runs):
        told = told.unionByName(other, allowMissingColumns=True)
    return told


def _markdown_lines(told: DataFrame) -> DataFrame:
    first, last = -(1 << 40), 1 << 40

    def line(section, k1, k2, text):
        value = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(F.lit(section).alias("section"), value(k1).cast("bigint").alias("k1"), value(k2).cast("bigint").alias("k2"), value(text).alias("line"))

    fixed_lines = lambda section, k1, texts: [line(section, k1, k2, text) for k2, text in enumerate(texts)]
    some = lambda flag, found, nothing: F.when(F.col(flag), F.array(*found)).otherwise(F.array(*nothing))
    none = lambda c: F.coalesce(c, F.lit("none"))
    head = F.concat(
        F.lit("Analysed "), _plural(F.col("n"), "step"),
        F.coalesce(F.concat(F.lit(" with the "), F.col("text"), F.lit(" engine.")), F.lit(".")))
    around = [
        text for section, title in enumerate((fixed.REPORT_TITLE, fixed.REPORT_STEPS, fixed.REPORT_FLOWS, fixed.REPORT_GAPS))
        for text in (*fixed_lines(section, first, [title, ""]), *fixed_lines(section, last, [""]))]
    of_run = F.concat(
        F.array(*around), F.array(line(0, 0, 0, head)),
        some("flows", fixed_lines(2, first + 1, fixed.REPORT_FLOW_HEAD), fixed_lines(2, 0, [fixed.REPORT_NO_FLOWS])),
        F.when(F.col("gaps"), F.slice(F.array(*around), 1, 0)).otherwise(F.array(*fixed_lines(3, 0, [fixed.REPORT_NO_GAPS]))))
    number = F.col("number")
    of_step = F.array(
        line(1, number, 0, F.concat(number.cast("string"), F.lit(". **"), F.col("name"), F.col("text"))),
        line(1, number, 1, F.concat(F.lit("   - reads: "), none("read"))), line(1, number, 2, F.concat(F.lit("   - writes: "), none("write"))))
    of_flow = F.array(line(2, F.col("seq"), F.col("pos"), F.concat(F.col("text"), F.col("step.name"), F.lit(" |"))))
    of_gap = F.array(line(3, F.col("pos"), F.col("seq"), F.col("text")))
    kind = F.col("kind")
    told = told.withColumn("step", F.explode(F.when(kind == _FLOW, F.col("steps")).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("name"))))))
    return told.select("run_id", F.inline(F.when(kind == _STEP, of_step).when(kind == _FLOW, of_flow).when(kind == _GAP, of_gap).otherwise(of_run)))


def schema_baseline(access: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every table of every lakehouse a run touched, and whether its schema can be read."""
    parts = refs.table_ref_parts(F.col("ref"))
    touched = (
        access.select("ref").distinct()
        .select(parts.alias("p"))
        .filter("p.resolved AND p.lakehouse <> '' AND p.kind <> 'file'")
        .select(F.col("p.workspace").alias("workspace"), F.col("p.lakehouse").alias("lakehouse"))
        .distinct()
    )
    return catalog.join(touched, ["workspace", "lakehouse"], "left_semi").select(
        refs.make_ref(F.col("name"), F.col("lakehouse"), F.col("workspace")).alias("ref"), "readable")


def step_tables(access: DataFrame, by: list[str]) -> DataFrame:
    """Distinct reads and writes of a step."""
    return access.select(*by, "mode", "ref").distinct()
