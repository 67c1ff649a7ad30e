"""Reading tables and files by name or format; writing facts and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from factloom import fixed
from factloom.session import cut_lineage, exists

FLOW_COLUMNS = ["step", "from_table", "from_column", "to_table", "to_column", "transform"]


def read_table(spark, name_or_path: str, format: str | None = None, schema=None, **options) -> DataFrame:
    """``table(name)`` without a format, else the reader of that format on a path."""
    if format is None:
        return spark.table(name_or_path)
    if format not in fixed.FORMATS:
        raise ValueError(f"unknown format {format!r}; known: {', '.join(fixed.FORMATS)}")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(name_or_path)


def write_column_lineage_csv(flow: DataFrame, path: str) -> None:
    """Flows as CSV with a header; nulls empty, quotes doubled, cells quoted where needed."""
    (
        flow.select(*FLOW_COLUMNS).na.fill("")
        .write.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "")
        .csv(path)
    )


def save_run(facts: dict[str, DataFrame], path: str, batch: str) -> None:
    """Save the fact tables of finished runs under a batch name, all of them or none.

    Every attempt has folders of its own; the commit, one small file, is written when all tables are complete, and readers
    go by commits, so a failure halfway leaves nothing that anyone reads. Saving a batch again replaces it, at the moment of
    the commit. Rows are divided by date, run and row hash, into ranges of even size: a busy day or run fills as many files as it needs.
    """
    for name, frame in facts.items():
        if "run_date" not in frame.columns:
            raise ValueError(f"{name} has no run_date column")
    if not facts:
        raise ValueError("no facts to save")
    spark = next(iter(facts.values())).sparkSession
    attempt = _write_attempt(facts, path)
    earlier = _live(spark, path).filter(F.col("batch") == batch).select("attempt")
    _commit(spark, path, attempt, batch, earlier)


def _write_attempt(facts: dict[str, DataFrame], path: str) -> str:
    attempt = uuid.uuid4().hex
    for name, frame in facts.items():
        plain = [f.name for f in frame.schema if "map<" not in f.dataType.simpleString()]
        spread = frame.repartitionByRange("run_date", "run_id", F.xxhash64(*plain))
        spread.write.partitionBy("run_date").parquet(f"{path}/{name}/attempt={attempt}")
    return attempt


def _commit(spark, path: str, attempt: str, batch: str, replaced: DataFrame) -> None:
    """One file: the attempt, and a row for each earlier one that it stands for."""
    own = spark.range(1).select(F.lit(attempt).alias("attempt"), F.lit(batch).alias("batch"), F.lit(None).cast("string").alias("replaces"))
    more = replaced.select(F.lit(attempt).alias("attempt"), F.lit(batch).alias("batch"), F.col("attempt").alias("replaces"))
    own.unionByName(more).coalesce(1).write.mode("append").json(f"{path}/commits")


def _live(spark, path: str) -> DataFrame:
    """attempt, batch of what is committed and not replaced."""
    schema = "attempt string, batch string, replaces string"
    if not exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], schema).drop("replaces")
    commits = spark.read.schema(schema).json(f"{path}/commits")
    replaced = commits.filter("replaces IS NOT NULL").select(F.col("replaces").alias("attempt"))
    return commits.select("attempt", "batch").distinct().join(replaced, "attempt", "left_anti")


def read_runs(spark, path: str, name: str, schema) -> DataFrame:
    """One fact table of all committed batches, as one scan however many batches there are.

    ``attempt`` and ``run_date`` are partition columns: those of no commit, and filters on the date, leave their files
    unread. A store without a commit, or without the table, is empty.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    whole = StructType([*schema.fields, StructField("attempt", StringType())])
    return spark.read.schema(whole).parquet(f"{path}/{name}").join(_live(spark, path), "attempt", "left_semi").select(schema.names)


def compact_runs(spark, path: str, schemas: dict[str, object], batch: str = "compacted") -> None:
    """Write what is committed anew as one batch and let it stand for all others: many small batches become even files.

    ``schemas``: those of all fact tables of the store. Batches saved meanwhile stay as they are; readers
    see the old files until the commit and the new ones after it.
    """
    live = cut_lineage(_live(spark, path))
    if live.isEmpty():
        return
    whole = {}
    for name, schema in schemas.items():
        schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        if exists(spark, f"{path}/{name}"):
            rows = spark.read.schema(StructType([*schema.fields, StructField("attempt", StringType())])).parquet(f"{path}/{name}")
            whole[name] = rows.join(live, "attempt", "left_semi").select(schema.names)
    _commit(spark, path, _write_attempt(whole, path), batch, live.select("attempt"))


def write_model(entity: DataFrame, child: DataFrame, transition: DataFrame, root: DataFrame, path: str) -> None:
    """Publish an entity/transition model as gzipped JSON lines, replacing what is there.

    Names and ids repeat in every line, so the files are a small part of their text; any JSON reader of Spark takes them as they are.
    """
    for name, frame in (("entity", entity), ("entity_child", child), ("transition", transition), ("root", root)):
        frame.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")
