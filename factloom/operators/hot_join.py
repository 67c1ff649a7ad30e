"""Equi-joins in which a few keys hold a large part of the rows.

Adaptive execution splits a skewed partition only where both sides are plain shuffles; behind an aggregate, or below a
window, it cannot. Here the heavy keys are found first, by a mergeable frequent-items sketch over either
side, and their rows are dealt over several places; the rows of the other side that they may meet are repeated in each place. All
other keys are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: places that one key is dealt over, at most
MOST_PLACES = 4096
#: keys that the sketch keeps for each place; its counts are too high by less than rows / (places * this)
PRECISION = 16


def heavy_keys(df: DataFrame, on: list[str], places: int) -> DataFrame:
    """_key (hash of the keys) and places of every key that holds more than one ``places``-th of the rows, at most ``places`` rows.

    A key gets as many places as it holds such shares. Null keys meet nothing and are never heavy.
    """
    tracked = min(places * PRECISION, 1_000_000)
    items = df.filter(_no_null(on)).select(F.xxhash64(*on).alias("_key"))
    counted = items.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(_key, {places}, {tracked})").alias("top"))
    share = F.greatest(F.col("n") / F.lit(float(places)), F.lit(1.0))
    return counted.select("n", F.inline("top"), share.alias("share")).filter("count > share").select(
        F.col("item").alias("_key"), F.least(F.ceil(F.col("count") / F.col("share")), F.lit(MOST_PLACES)).cast("int").alias("places"))


def _no_null(columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).isNotNull()
    return condition


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", places: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` for inner, left, right, full, left_semi and left_anti, with heavy keys of either side dealt over places.

    ``places``: as many even shares the rows are thought of in; the session's shuffle partitions if None. Rows are dealt by their
    place in the input, so identical ones spread as well; an input that comes out of a shuffle should be a written table,
    or a lost task might deal its rows anew.
    """
    if how not in ("inner", "left", "right", "full", "left_semi", "left_anti"):
        raise ValueError(f"unknown join {how!r}")
    spark = left.sparkSession
    places = places or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if how in ("left", "right", "full"):
        # A row has copies in several places and may be missed in some: what is missed in all is found by the keys alone.
        out = hot_join(left, right, on, "inner", places)
        if how != "right":
            out = out.unionByName(hot_join(left, right, on, "left_anti", places), allowMissingColumns=True)
        if how != "left":
            out = out.unionByName(hot_join(right, left, on, "left_anti", places), allowMissingColumns=True)
        return out
    filtering = how in ("left_semi", "left_anti")
    if filtering:
        right = right.select(*on).distinct()
    hot = _told(heavy_keys(left, on, places), "l")
    if not filtering:
        hot = hot.join(_told(heavy_keys(right, on, places), "r"), "_key", "full")
    hot = hot.select("_key", F.coalesce("l", F.lit(1)).alias("_l"), (F.lit(1) if filtering else F.coalesce("r", F.lit(1))).alias("_r"))
    hot = F.broadcast(spark.createDataFrame(hot.collect(), hot.schema))  # at most 2 * places rows

    def dealt(df, own, other):
        keyed = df.withColumns({"_key": F.xxhash64(*on)}).join(hot, "_key", "left").drop("_key")
        mine = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(own)), F.lit(0)).cast("int")
        met = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        return keyed.withColumn(f"_at{own}", mine).withColumn(f"_at{other}", met).drop(own, other)

    place = ["_at_l", "_at_r"]
    return dealt(left, "_l", "_r").join(dealt(right, "_r", "_l"), [*on, *place], how).drop(*place)


def _told(keys: DataFrame, name: str) -> DataFrame:
    return keys.withColumnRenamed("places", name)
