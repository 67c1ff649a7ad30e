import random
import statistics

import pytest
from pyspark.sql import functions as F

from factloom.operators import hot_join


@pytest.fixture
def sides(rows):
    rng = random.Random(7)
    left = [(0, i) for i in range(600)] + [(rng.randrange(1, 300), i) for i in range(500)] + [(None, 1), (None, 2), (1000, 5)] + [(7, 7)] * 200
    right = [(0, "a"), (0, "b"), (None, "n"), (2000, "only right")] + [(k, f"r{k}") for k in range(1, 300, 2)] + [(4, f"c{i}") for i in range(150)]
    return rows("k int, v int", left).repartition(3), rows("k int, w string", right).repartition(3)


@pytest.mark.parametrize("how", ["inner", "left", "right", "full", "left_semi", "left_anti"])
def test_equals_a_plain_join(sides, got, how):
    left, right = sides
    plain, dealt = left.join(right, ["k"], how), hot_join.hot_join(left, right, ["k"], how, places=8)
    assert dealt.columns == plain.columns and got(dealt) == got(plain)


def test_heavy_keys_are_those_beyond_an_even_share(sides):
    left, _ = sides
    hashes = {r[0]: r[1] for r in left.select("k", F.xxhash64("k")).distinct().collect()}
    found = {r["_key"]: r["places"] for r in hot_join.heavy_keys(left, ["k"], 8).collect()}
    assert set(found) == {hashes[0], hashes[7]} and found[hashes[0]] == 4 and found[hashes[7]] == 2
    assert hot_join.heavy_keys(left.limit(0), ["k"], 8).count() == 0


def test_no_task_has_much_more_than_the_median(spark, sides):
    left = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def tasks(joined):
            return [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]

        plain, dealt = tasks(left.join(right, "k")), tasks(hot_join.hot_join(left, right, ["k"], places=64))
        assert max(plain) > 2 * statistics.median(plain) and max(dealt) < 2 * statistics.median(dealt) and sum(plain) == sum(dealt)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_unknown_join(sides):
    with pytest.raises(ValueError, match="unknown join"):
        hot_join.hot_join(*sides, ["k"], "cross")
