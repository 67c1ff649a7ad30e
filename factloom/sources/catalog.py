"""Workspace items and display names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_items(raw: DataFrame) -> DataFrame:
    """Items shaped and put into buckets; pipelines are among the others."""
    kind = F.col("type")
    bucket = F.when(kind == "Notebook", "notebooks").when(kind == "Lakehouse", "lakehouses").otherwise("others")
    return raw.select(
        "id", F.col("displayName").alias("name"), "type", F.col("folderId").alias("folder_id"), "description", bucket.alias("bucket"))


def name_map(workspaces: DataFrame, items: DataFrame) -> DataFrame:
    """Lower-cased GUID -> display name; an item overrides a workspace, a later write an earlier one."""
    both = workspaces.select("id", "name", F.struct(F.lit(0).alias("p"), "written").alias("_at")).unionByName(
        items.select("id", "name", F.struct(F.lit(1).alias("p"), "written").alias("_at")))
    return both.groupBy(F.lower("id").alias("guid")).agg(F.max_by("name", "_at").alias("name"))
