"""Table schemas from Delta transaction logs: JSON commits and Parquet checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``<version>.json``, ``<version>.checkpoint.parquet``, a part ``<version>.checkpoint.<part>.<parts>.parquet``, or
#: ``<version>.checkpoint.<uuid>.parquet`` and ``.json``
_FILE = r"^(.*)/_delta_log/(\d+)\.(?:checkpoint\.(?:[^/]+\.)?)?(?:json|parquet)$"


def log_lines(spark, tables: str) -> DataFrame:
    """``file, value`` of every line of the JSON files in the logs of the tables matched by the glob ``tables``.

    The log folder is named in the path, because a listing skips folders whose
    name starts with an underscore. A log whose JSON is all gone has no lines.
    """
    read = spark.read.option("pathGlobFilter", "*.json")
    return read.text(f"{tables}/_delta_log").select(F.col("_metadata.file_path").alias("file"), "value")


def checkpoint_lines(spark, tables: str) -> DataFrame:
    """The metaData entries of Parquet checkpoints in the same form as :func:`log_lines`.

    Old commits are cleaned away once a checkpoint holds what they said, so a table of any age may have its schema
    there only. Of a checkpoint (one file, or several parts) one column is read, and of that the schema.
    """
    read = spark.read.option("pathGlobFilter", "*.checkpoint*.parquet").schema("metaData struct<schemaString:string>")
    entries = read.parquet(f"{tables}/_delta_log").filter("metaData.schemaString IS NOT NULL")
    return entries.select(F.col("_metadata.file_path").alias("file"), F.to_json(F.struct("metaData")).alias("value"))


def replayed(spark, tables: str) -> DataFrame:
    """All that logs say of their tables' schemas: checkpoints, then the commits after them."""
    return log_lines(spark, tables).unionByName(checkpoint_lines(spark, tables))


def table_schemas(lines: DataFrame, latest: bool = True) -> DataFrame:
    """``table_path, pos, name, type`` from the newest metaData entry, or from commit 0.

    A checkpoint repeats the newest entry up to its version, so the greatest version of an entry, in a commit or a checkpoint, tells the
    schema, whether earlier files are still there or not; the commit goes first where both have one version. A log
    without commit 0 has no first schema. Of a nested type only the outer type name is kept.
    """
    entries = lines.filter(F.contains("value", F.lit('"metaData"'))).select(
        F.regexp_extract("file", _FILE, 1).alias("table_path"),
        F.expr("try_cast(regexp_extract(file, '{}', 2) AS BIGINT)".format(_FILE.replace("\\", "\\\\"))).alias("version"),
        F.contains("file", F.lit(".checkpoint.")).alias("checkpoint"),
        F.get_json_object("value", "$.metaData.schemaString").alias("schema"),
    ).filter("version IS NOT NULL AND schema IS NOT NULL")
    if not latest:
        entries = entries.filter("version = 0")
    newest = entries.groupBy("table_path").agg(F.max_by("schema", F.struct("version", ~F.col("checkpoint"), "schema")).alias("schema"))
    fields = F.from_json("schema", "fields array<struct<name:string,type:string>>")["fields"]
    outer = F.when(F.ltrim("f.type").startswith("{"), F.get_json_object("f.type", "$.type")).otherwise(F.col("f.type"))
    return newest.select("table_path", F.posexplode(fields).alias("pos", "f")).select(
        "table_path", (F.col("pos") + 1).alias("pos"), "f.name", outer.alias("type"))
