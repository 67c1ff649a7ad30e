"""The entity / transition model of a run, as four tables.

Keys stay separate columns; the ``id`` strings are for display and export.
``by`` names the grain of a model, one run by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = ("run_id",)


def _table_id(ref):
    return F.concat(F.lit("table:"), F.col(ref))


def _column_id(ref, column):
    return F.concat(F.lit("col:"), F.col(ref), F.lit(":"), F.col(column))


def _columns(schema, flow, by):
    """Every column a model knows: schema columns and both ends of its flows."""
    owned = flow.filter("from_table IS NOT NULL AND from_table <> ''")
    return (
        schema.select(*by, "ref", F.col("name").alias("column"))
        .unionByName(flow.select(*by, F.col("to_table").alias("ref"), F.col("to_column").alias("column")))
        .unionByName(owned.select(*by, F.col("from_table").alias("ref"), F.col("from_column").alias("column")))
    )


def entities(schema: DataFrame, flow: DataFrame, access: DataFrame, by=RUN) -> DataFrame:
    """A table entity per ref and a column entity per column."""
    columns = _columns(schema, flow, by).withColumn("kind", F.lit("column"))
    tables = (
        columns.select(*by, "ref").unionByName(access.select(*by, "ref"))
        .select(*by, "ref", F.lit(None).cast("string").alias("column"), F.lit("table").alias("kind"))
    )
    distinct = columns.select(*by, "ref", "column", "kind").unionByName(tables).distinct()
    return distinct.select(
        *by,
        F.when(F.col("kind") == "table", _table_id("ref")).otherwise(_column_id("ref", "column")).alias("id"),
        F.coalesce("column", "ref").alias("name"),
        "kind",
    )


def entity_children(schema: DataFrame, flow: DataFrame, by=RUN) -> DataFrame:
    """Columns under their table, one row per child."""
    return _columns(schema, flow, by).distinct().select(
        *by, _table_id("ref").alias("parent"), _column_id("ref", "column").alias("child"))


def roots(entity: DataFrame, by=RUN) -> DataFrame:
    """Every table is a root."""
    return entity.filter("kind = 'table'").select(*by, "id")


def column_transitions(flow: DataFrame, by=RUN, order=("seq",)) -> DataFrame:
    """One transition per owned pair of columns; a repeated pair keeps the last transform."""
    pair = ["from_table", "from_column", "to_table", "to_column"]
    return (
        flow.filter("from_table IS NOT NULL AND from_table <> ''")
        .groupBy(*by, *pair)
        .agg(F.max_by(F.coalesce("transform", F.lit("")), F.struct(*order)).alias("transform"))
        .select(
            *by,
            _column_id("from_table", "from_column").alias("source"),
            _column_id("to_table", "to_column").alias("target"),
            "transform",
        )
    )


def table_transitions(flow: DataFrame, access: DataFrame, by=RUN) -> DataFrame:
    """Every read of a run to each of its writes that has no column flow.

    The pairs are the answer itself, so the grain matters: one run joins its own
    reads and writes only, on the run key, and never the merged estate.
    """
    bare = (
        access.filter("mode = 'write'").select(*by, F.col("ref").alias("target_ref")).distinct()
        .join(flow.select(*by, F.col("to_table").alias("target_ref")).distinct(), [*by, "target_ref"], "left_anti")
    )
    reads = access.filter("mode = 'read'").select(*by, F.col("ref").alias("source_ref")).distinct()
    return bare.join(reads, list(by)).select(
        *by,
        _table_id("source_ref").alias("source"),
        _table_id("target_ref").alias("target"),
        F.lit("table-level").alias("resolution"),
    )
