"""Reading the given tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import scratch_path


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table under the shared checkpoint folder and read it.

    What follows starts from files: they outlive executors, are computed once
    and bring their size to the optimizer. Empty tables keep their schema.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """With doc_id this names a row for joins: rows that share both share every decision."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def join_rows(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join on the keys, where null equals null; the right side's keys are dropped."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__{k}" for k in keys))


def crc_of(number: str | Column) -> Column:
    """Unsigned crc32 of a number's decimal text; null for null."""
    return F.crc32((F.col(number) if isinstance(number, str) else number).cast("string").cast("binary"))
