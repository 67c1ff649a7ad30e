"""Positions within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.session import cut_lineage


def number_rows(df: DataFrame, keys: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, ... within ``keys`` by ``order``, however large one group is.

    A plain ``row_number`` sorts a whole group in one task. Here the rows are
    range-partitioned by keys and order, so a heavy group spreads over many
    tasks; each numbers its own stretch and adds what the stretches before it
    hold. The stretches are written once, which keeps them the same for the
    count and for the numbering.
    """
    by = [F.col(k) for k in keys]
    placed = cut_lineage(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    stretch = [*keys, "_part"]
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy(*stretch).agg(F.count("*").alias("_size")).select(
        *stretch, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*stretch).orderBy(*order))
    return (
        placed.withColumn("_here", here).join(before, stretch)
        .withColumn(name, (F.col("_here") + F.col("_before")).cast("bigint"))
        .select(*df.columns, name)
    )
