"""Scans of a notebook corpus: a ``cell`` table in, access and coverage facts out.

The table-level scan is pure Spark SQL over each cell's text; only literal SQL
strings need Python's own grammar, and those cells are read in Arrow batches.
A cell is keyed by ``run_id, cell_index``.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import fixed
from factloom.functions import refs

CELL = ["run_id", "cell_index"]


def strip_imports(source: Column) -> Column:
    """Source without import heads, which would read as ``FROM x``."""
    return F.when(F.contains(source, F.lit("import")), F.regexp_replace(source, fixed.IMPORT_LINE, "")).otherwise(source)


def pattern_matches(source: Column, patterns: list[tuple[str, str]]) -> Column:
    """Distinct first groups of all patterns, in pattern order.

    A pattern runs only on text that contains its word: most cells hold none.
    """
    none = F.array().cast("array<string>")

    def found(text):
        def matches(low):
            return F.flatten(F.array(*[
                F.when(F.contains(low, F.lit(word)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).otherwise(none)
                for word, pattern in patterns]))

        return refs.let(F.lower(text), matches)

    return F.array_distinct(refs.let(source, found))


def _each(df: DataFrame, keys: list[str | Column], values: Column, name: str) -> DataFrame:
    """A row per element of ``values`` that is not null; ``values`` is computed once per row.

    The optimizer puts a filter on the array before a plain ``explode``, which matches all patterns a second and a third time.
    """
    return df.select(*keys, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def _refs(raws: Column, workspace, lakehouse) -> Column:
    """The canonical refs of raw names; a blank leaf is dropped."""
    named = F.transform(raws, lambda raw: refs.qualify(raw, workspace, lakehouse))
    return F.filter(named, lambda ref: ~F.endswith(ref, F.lit("/")))


def _scan(cell: DataFrame, patterns: list[str], workspace, lakehouse) -> DataFrame:
    raws = pattern_matches(strip_imports(F.col("source")), patterns)
    return _each(cell, CELL, F.array_distinct(_refs(raws, workspace, lakehouse)), "ref").distinct()


def scan_reads(cell: DataFrame, workspace="", lakehouse="") -> DataFrame:
    """Tables each cell reads, by six text patterns."""
    return _scan(cell, fixed.READ_PATTERNS, workspace, lakehouse)


def scan_writes(cell: DataFrame, workspace="", lakehouse="") -> DataFrame:
    """Tables each cell writes, by nine text patterns."""
    return _scan(cell, fixed.WRITE_PATTERNS, workspace, lakehouse)


def scan_temp_views(cell: DataFrame) -> DataFrame:
    """Names each run registers as temp views, by DataFrame verb or by SQL."""
    names = pattern_matches(F.col("source"), [("temp", fixed.VIEW_VERB_CALL), ("temp", fixed.TEMP_VIEW_SQL)])
    return (
        _each(cell, ["run_id"], names, "raw")
        .select("run_id", refs.normalise_view_name(F.col("raw")).alias("view"))
        .filter("view IS NOT NULL")
        .distinct()
    )


def _cte_names(cell: DataFrame) -> DataFrame:
    """Names a cell's own SQL defines with WITH: no more tables than views are."""
    names = F.regexp_extract_all("source", F.lit(r"(?iU)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)(\w+)\s+AS\s*\("), F.lit(1))
    return (
        _each(cell.filter(F.rlike("source", F.lit(r"(?i)\bWITH\b"))), CELL, names, "raw")
        .select(*CELL, F.lower("raw").alias("name"))
        .distinct()
    )


def cell_access(cell: DataFrame, workspace="", lakehouse="") -> DataFrame:
    """Reads and writes of each cell, without temp views and CTE names.

    Both pattern lists are matched in one pass over the text; the joins that
    follow carry names only, never source text.
    """
    def found(mode, patterns):
        return lambda text: F.transform(pattern_matches(text, patterns), lambda raw: F.struct(F.lit(mode).alias("mode"), raw.alias("raw")))

    named = refs.let(strip_imports(F.col("source")), lambda text: F.concat(
        found("read", fixed.READ_PATTERNS)(text), found("write", fixed.WRITE_PATTERNS)(text)))
    raw = _each(cell, CELL, named, "f").select(*CELL, "f.mode", "f.raw").withColumn("_key", refs.normalise_view_name(F.col("raw")))
    views = scan_temp_views(cell).select("run_id", F.col("view").alias("_key"))
    ctes = _cte_names(cell).select(*CELL, F.col("name").alias("_key"))
    tables = raw.join(views, ["run_id", "_key"], "left_anti").join(ctes, [*CELL, "_key"], "left_anti")
    return _each(tables, [*CELL, "mode"], _refs(F.array("raw"), workspace, lakehouse), "ref").distinct()


def is_sql_magic(source: Column) -> Column:
    return F.rlike(F.coalesce(source, F.lit("")), F.lit(fixed.SQL_MAGIC_BODY))


def sql_magic_body(source: Column) -> Column:
    """Statement of a SQL magic cell, null for other cells."""
    return F.when(is_sql_magic(source), F.regexp_extract(source, fixed.SQL_MAGIC_BODY, 1))


# -- cells as Python -----------------------------------------------------------


def _parsed(source: str) -> ast.AST | None:
    """The cell as a tree, or None when it is not Python."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _calls(tree: ast.AST) -> list[ast.Call]:
    """Every call of a tree, level by level as ``ast.walk`` goes, in half its time."""
    todo = [tree]
    for node in todo:
        for value in map(node.__dict__.get, node._fields):
            if isinstance(value, ast.AST):
                todo.append(value)
            elif isinstance(value, list):
                todo += [item for item in value if isinstance(item, ast.AST)]
    return [node for node in todo if isinstance(node, ast.Call)]


def _sql_argument(call: ast.Call):
    """First argument of a ``.sql(...)`` call, or None for any other call."""
    if isinstance(call.func, ast.Attribute) and call.func.attr == "sql" and call.args:
        return call.args[0]
    return None


def _literal(node) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def sql_statements(cell: DataFrame) -> DataFrame:
    """Literal SQL strings each cell hands to Spark, in the order they are found.

    A magic cell's body is one statement and is cut out by a pattern. Of the
    rest only cells that name ``sql`` at all are handed to Python.
    """
    magic = cell.filter(is_sql_magic(F.col("source"))).select(
        *CELL, F.lit(0).cast("long").alias("pos"), sql_magic_body(F.col("source")).alias("statement"))

    def literals(batches):
        for batch in batches:
            rows = []
            for run_id, cell_index, source in zip(batch["run_id"], batch["cell_index"], batch["source"]):
                tree = _parsed(source)
                found = [_literal(a) for a in map(_sql_argument, _calls(tree) if tree else []) if a is not None]
                rows += [(run_id, cell_index, pos, text) for pos, text in enumerate(t for t in found if t is not None)]
            yield pd.DataFrame(rows, columns=[*CELL, "pos", "statement"])

    python = cell.select(*CELL, "source").filter(F.contains("source", F.lit("sql")) & ~is_sql_magic(F.col("source")))
    return magic.unionByName(python.mapInPandas(literals, magic.schema))


def _names_write(node: ast.AST) -> bool:
    """Whether ``.write`` or ``.writeTo`` stands somewhere left of a call's verb."""
    while isinstance(node, (ast.Attribute, ast.Call)):
        if isinstance(node, ast.Attribute):
            if node.attr in ("write", "writeTo"):
                return True
            node = node.value
        else:
            node = node.func
    return False


def _writes_frame(call: ast.Call) -> bool:
    verb = call.func
    if not isinstance(verb, ast.Attribute):
        return False
    return verb.attr in fixed.TARGET_VERBS or (verb.attr in fixed.FORMAT_WRITE_VERBS and _names_write(verb.value))


def scan_cell_flags(cell: DataFrame) -> DataFrame:
    """Per cell: SQL statements, DataFrame write, dynamic SQL, unparsable, magic."""
    # Python's patterns are Unicode without the flag that Java's need.
    sql_magic = re.compile(fixed.SQL_MAGIC.replace("(?iU)", "(?i)") + r"[^\n]*\n")
    any_magic = re.compile(fixed.ANY_MAGIC.replace("(?U)", ""))
    schema = cell.select(*CELL).withColumns({
        "sql_statements": F.lit(0).cast("long"), "df_write": F.lit(True), "dynamic_sql": F.lit(True),
        "unparsable": F.lit(True), "magic": F.lit(True),
    }).schema

    # What a call must name to count; other spellings of an identifier need letters beyond ASCII.
    words = re.compile("sql|write|" + "|".join(fixed.TARGET_VERBS))

    def flags(source: str):
        if any_magic.match(source):
            return int(bool(sql_magic.match(source))), False, False, False, True
        tree = _parsed(source)
        if tree is None:
            return 0, False, False, True, False
        if source.isascii() and not words.search(source):
            return 0, False, False, False, False
        calls = _calls(tree)
        arguments = [a for a in map(_sql_argument, calls) if a is not None]
        literals = [a for a in arguments if _literal(a) is not None]
        return len(literals), any(map(_writes_frame, calls)), len(literals) < len(arguments), False, False

    def scan(batches):
        for batch in batches:
            found = [flags(source or "") for source in batch.column("source").to_pylist()]
            kinds = [pa.int64()] + [pa.bool_()] * 4
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found) if found else [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in CELL), *columns], names=schema.names)

    return cell.select(*CELL, "source").mapInArrow(scan, schema)


def coverage_counts(flags: DataFrame) -> DataFrame:
    """CELLS per kind; a DataFrame-write cell counts only when it issues no SQL."""
    def cells(condition):
        return F.count_if(F.expr(condition))

    return flags.groupBy("run_id").agg(
        F.count("*").alias("cells"),
        cells("sql_statements > 0").alias("sql_cells"),
        F.sum(F.col("sql_statements").cast("bigint")).alias("sql_statements"),
        cells("df_write AND sql_statements = 0").alias("dataframe_write_cells"),
        cells("dynamic_sql").alias("dynamic_sql_cells"),
        cells("unparsable").alias("unparsable_cells"),
    )


def _write_facts(access: DataFrame, flow: DataFrame) -> DataFrame:
    """(run, written ref, covered): one shuffle over both facts."""
    return (
        access.filter("mode = 'write'").select("run_id", "ref", F.lit(True).alias("written"), F.lit(False).alias("covered"))
        .unionByName(flow.select("run_id", F.col("to_table").alias("ref"), F.lit(False).alias("written"), F.lit(True).alias("covered")))
        .groupBy("run_id", "ref")
        .agg(F.bool_or("written").alias("written"), F.bool_or("covered").alias("covered"))
        .filter("written")
    )


def coverage_writes(access: DataFrame, flow: DataFrame) -> DataFrame:
    """Written tables per run, and how many got column lineage."""
    return _write_facts(access, flow).groupBy("run_id").agg(
        F.count("*").alias("writes"), F.count_if("covered").alias("writes_with_column_lineage"))


def uncovered_writes(access: DataFrame, flow: DataFrame) -> DataFrame:
    """The written tables without column lineage, one row each."""
    return _write_facts(access, flow).filter("NOT covered").select("run_id", "ref")


def coverage_notes(counts: DataFrame, writes: DataFrame, uncovered: DataFrame, runs: DataFrame) -> DataFrame:
    """Log lines per run, each only when its count is positive; at most 8 refs are named.

    ``runs``: run_id, engine. That cells write through DataFrames is worth a line only where the stub engine read them and a write
    came back bare.
    """
    first = Window.partitionBy("run_id").orderBy("ref")
    named = (
        uncovered.withColumn("_n", F.row_number().over(first)).filter("_n <= 8")
        .groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("ref")), ", ").alias("named"))
    )
    joined = counts.join(writes, "run_id", "left").join(named, "run_id", "left").join(runs.select("run_id", "engine"), "run_id", "left")
    missing = F.coalesce(F.col("writes") - F.col("writes_with_column_lineage"), F.lit(0))
    frames, dynamic, unparsable = (F.col(c) for c in ("dataframe_write_cells", "dynamic_sql_cells", "unparsable_cells"))
    lines = F.array_compact(F.array(
        F.when((F.col("engine") == "stub") & (frames > 0) & (missing > 0), F.format_string(fixed.NOTE_DATAFRAME, frames)),
        F.when(dynamic > 0, F.format_string(fixed.NOTE_DYNAMIC, dynamic)),
        F.when(unparsable > 0, F.format_string(fixed.NOTE_UNPARSABLE, unparsable)),
        F.when(missing > 0, F.format_string(fixed.NOTE_UNCOVERED, missing, F.col("writes"), F.col("named"))),
    ))
    return joined.select("run_id", F.posexplode(lines).alias("pos", "note"))


# -- statements ----------------------------------------------------------------


def classify_statement(statement: Column) -> Column:
    """``struct<kind, target, using>`` of one SQL statement, by its head."""
    heads = [
        ("temp_view", fixed.TEMP_VIEW_TARGET),
        ("insert", fixed.INSERT_TARGET),
        ("ctas", fixed.CTAS_TARGET),
        ("merge", fixed.MERGE_TARGET),
        ("update", fixed.UPDATE_TARGET),
        ("delete", fixed.DELETE_TARGET),
    ]
    kind = target = None
    for name, pattern in heads:
        hit, value = F.rlike(statement, F.lit(pattern)), F.regexp_extract(statement, pattern, 1)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
        target = F.when(hit, value) if target is None else target.when(hit, value)
    kind = kind.otherwise("other")
    using = F.nullif(F.regexp_extract(statement, fixed.MERGE_USING, 1), F.lit(""))
    return F.struct(
        kind.alias("kind"), target.alias("target"),
        F.when(kind.isin("merge", "update", "delete"), using).alias("using"),
    )


def statement_reads(statements: DataFrame, views: DataFrame, workspace="", lakehouse="") -> DataFrame:
    """Tables an UPDATE or DELETE names besides its target; a view gives its base tables.

    ``views`` holds ``run_id, view, base_ref``; a view with unknown columns has a
    null base and contributes nothing.
    """
    parsed = statements.select("run_id", "pos", "statement", classify_statement(F.col("statement")).alias("c")).filter(
        "c.kind IN ('update', 'delete')")
    raw = _each(
        parsed, ["run_id", "pos", refs.qualify(F.col("c.target"), workspace, lakehouse).alias("_target")],
        pattern_matches(F.col("statement"), fixed.READ_PATTERNS), "raw").withColumn("view", refs.normalise_view_name(F.col("raw")))
    known = raw.join(views, ["run_id", "view"], "left").join(
        views.select("run_id", "view").distinct().withColumn("_is_view", F.lit(True)), ["run_id", "view"], "left")
    ref = F.when(F.col("_is_view"), F.col("base_ref")).otherwise(refs.qualify(F.col("raw"), workspace, lakehouse))
    return (
        known.withColumn("ref", ref)
        .filter(F.col("ref").isNotNull() & (F.col("ref") != F.col("_target")))
        .select("run_id", "pos", "ref")
        .distinct()
    )
