"""Data verbs that need more than one DataFrame method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import scratch_path


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Deterministic ``dropDuplicates(keys)``: the first row of each key by ``order``.

    An aggregate rather than a window: each task keeps one row per key before
    the shuffle, so a key that holds a third of the rows costs no more.
    """
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, unit: float = 1.0) -> DataFrame:
    """``points`` inside ``[low, high)`` of ``ranges``.

    A range is cut into at most two aligned pieces of each power of two times ``unit``, as a subnet list would be, so even
    the widest is some dozens of rows, and a point is looked up once for each width that
    occurs: the theta join becomes an equality join that Spark can hash or sort. Null and empty ranges hold nothing.
    """
    def cell(value):
        return F.greatest(F.lit(-_LAST_CELL), F.least(F.lit(_LAST_CELL), F.floor(F.col(value).cast("double") / unit).cast("bigint")))

    pieces = F.filter(F.array(*(p for k in range(64) for p in _pieces("_low", "_high", k))), lambda p: p.isNotNull())
    spread = (
        ranges.filter(F.col(low) < F.col(high)).withColumns({"_low": cell(low), "_high": cell(high)})
        .withColumn("_piece", F.explode(pieces)).select(*ranges.columns, "_piece.level", "_piece.at")
        .withColumnsRenamed({"level": "_level", "at": "_at"}))
    levels = sorted(r[0] for r in spread.select("_level").distinct().collect())  # at most 64 numbers
    looked = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn(
        "_at", F.call_function("shiftright", cell(point), F.col("_level")))
    inside = (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    return looked.join(spread, ["_level", "_at"]).filter(inside).drop("_level", "_at")


_LAST_CELL = 1 << 62


def _pieces(low: str, high: str, level: int) -> list[Column]:
    """The pieces of width 2^level at the ends of the cells ``low`` to ``high`` that make up no wider piece."""
    first = -F.call_function("shiftright", -F.col(low), F.lit(level))
    end = F.call_function("shiftright", F.col(high) + 1, F.lit(level))
    piece = lambda at: F.struct(F.lit(level).alias("level"), at.alias("at"))
    return [F.when((first < end) & (first % 2 != 0), piece(first)), F.when((first < end) & (end % 2 != 0), piece(end - 1))]


def hash_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """About ``percent`` of the rows, the same ones on every engine and partitioning."""
    bound = f"{round(percent / 100 * 0x10000):04x}"
    return df.filter(F.substring(F.md5(F.col(key).cast("string")), 1, 4) < bound)


def merge_rows(target: DataFrame, source: DataFrame, on: list[str], delete_when: Column | None = None,
               update: dict[str, Column] | None = None, update_when: Column | None = None,
               insert: dict[str, Column] | None = None, insert_when: Column | None = None) -> DataFrame:
    """MERGE: matched rows are deleted or updated, unmatched target rows stay, unmatched source rows arrive.

    Clauses may use ``t.<column>`` and ``s.<column>``. A matched row goes where ``delete_when`` holds; else it takes the values of
    ``update`` (all source columns, if None) where ``update_when`` holds or is None. A source row without target
    arrives, where ``insert_when`` holds or is None, with the values of ``insert`` (all source columns, if None; columns
    left out are null). A null key matches nothing. Several source rows for one target row are an error; several for no target row are not.
    """
    rest = [c for c in target.columns if c not in on]
    s_rest = [c for c in source.columns if c not in on]
    true = F.lit(True)
    counted = source.filter(_no_null(on)).groupBy(*on).agg(F.count("*").alias("_n"), F.first(F.struct(*on, *s_rest)).alias("s"))
    held = target.select(*on, F.struct(*on, *rest).alias("t")).join(counted, on, "left")
    s = F.when(F.col("_n") > 1, F.raise_error(F.lit("several source rows match one target row")).cast(counted.schema["s"].dataType)).otherwise(F.col("s"))
    held = held.withColumn("s", s)
    matched = F.col("s").isNotNull()
    if delete_when is not None:
        held = held.filter(~(matched & F.coalesce(delete_when, F.lit(False))))
    changes = matched & (true if update_when is None else F.coalesce(update_when, F.lit(False)))
    values = {c: F.col(f"s.{c}") for c in rest if c in s_rest} if update is None else update
    kept = held.select(*on, *[F.when(changes, values[c]).otherwise(F.col(f"t.{c}")).alias(c) if c in values else F.col(f"t.{c}").alias(c) for c in rest])
    arriving = source.join(target.select(*on).distinct(), on, "left_anti").withColumn("s", F.struct(*on, *s_rest))
    if insert_when is not None:
        arriving = arriving.filter(F.coalesce(insert_when, F.lit(False)))
    given = {c: F.col(f"s.{c}") for c in rest if c in s_rest} if insert is None else insert
    kinds = {f.name: f.dataType for f in target.schema}
    new = arriving.select(*on, *[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in rest])
    return kept.select(*target.columns).unionByName(new.select(*target.columns))


def _no_null(columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def update_rows(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE ... SET ... WHERE; every value reads the row as it was."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_rows(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE FROM ... WHERE; a row whose condition is unknown stays."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def write_and_read(df: DataFrame, *more: DataFrame, overwrite: DataFrame | None = None) -> DataFrame:
    """CREATE TABLE AS, INSERT INTO and INSERT OVERWRITE into a fresh folder, read back."""
    spark = df.sparkSession
    path = scratch_path(spark, "table")
    df.write.mode("errorifexists").parquet(path)
    for rows in more:
        rows.write.mode("append").parquet(path)
    if overwrite is not None:
        overwrite.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def variant_field(text: Column, path: str, type_name: str) -> Column:
    """A path into a JSON text read as VARIANT; null when it is absent or no JSON."""
    return F.try_variant_get(F.try_parse_json(text), path, type_name)


def load_variant(df: DataFrame, text: str, fields: dict[str, tuple[str, str]], path: str) -> DataFrame:
    """Write ``df`` with the JSON in column ``text`` parsed once, and read it back.

    The text becomes a VARIANT; ``fields`` (column name: path, type) are written beside it as plain columns, null where the path is absent
    or the text is no JSON. Rows are sorted by them within files, so that filters on a field reach the scan and leave row groups
    unread: inside a VARIANT Spark keeps no statistics that a filter could use. Other paths are read from the VARIANT
    without parsing again.
    """
    parsed = df.withColumn(text, F.try_parse_json(text))
    whole = parsed.withColumns({name: F.try_variant_get(text, at, kind) for name, (at, kind) in fields.items()})
    (whole.sortWithinPartitions(*fields) if fields else whole).write.parquet(path)
    return df.sparkSession.read.schema(whole.schema).parquet(path)
