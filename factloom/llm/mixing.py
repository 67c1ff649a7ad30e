"""Mixing sources to target weights by hash-threshold histograms.

Every document has a place: a hash of its id and text. A source's share of a
budget is the documents below a threshold place. The threshold is found by
summing sizes by source and bucket of places, walking the at most 1,024 buckets to
the one where the budget ends, and refining that bucket alone, down to one place.
Nothing is sorted; sums are combined before each shuffle, so a source that holds
a third of all rows costs as much as any other. A larger budget has a larger
threshold, so smaller mixes lie within larger ones.

Documents are taken whole. What a threshold leaves of a budget, because the next
document is too large, is filled the same way from the documents that fit, a
fixed number of times; last, the one document that brings the sum nearest to the
budget is added, if that is nearer than none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.tables import join_rows, save

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
LEVEL_BITS, PLACE_BITS = 10, 60
PASSES = 4
WORDS = r"[^\x20\x09-\x0D]+"


def place() -> F.Column:
    """60 bits of a hash of doc_id and text; rows that share both share their place."""
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\n"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, PLACE_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size), a row per source, with ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all sizes; no target is above
    ``most`` times its source, the excess is shared again by weight. In order of limit by weight, the
    first source whose share is within its limit sets the share of all that follow.
    """
    everywhere = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") - 1) % len(weights) + 1)
    limited = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("limit") / F.col("weight"), "rank").rowsBetween(0, Window.unboundedFollowing)
    rate = (F.sum("source_size").over(everywhere) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    fits = F.col("rate") * F.col("weight") <= F.col("limit")
    order = F.struct(F.col("limit") / F.col("weight"), "rank")
    level = F.min_by(F.when(fits, F.col("rate")), F.when(fits, order)).over(everywhere)
    return limited.withColumn("rate", rate).withColumn("level", level).select(
        "source", "source_size", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the largest ``threshold`` such that rows placed below it sum to at most ``budget``; ``left`` is the rest.

    ``rows``: source, place, size. ``budgets``: source, budget (whole, not negative).
    """
    end, done = 1 << PLACE_BITS, []
    open_, candidates = budgets, rows
    for shift in range(PLACE_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        bucket = F.shiftright("place", shift)
        sums = candidates.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("place").alias("low"), F.max("place").alias("high"))
        through = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        cut = (
            join_rows(sums.withColumn("through", through), open_, ["source"], "inner")
            .where((F.col("through") > F.col("budget")) & (F.col("through") - F.col("size") <= F.col("budget")))
            .select("source", "bucket", (F.col("budget") - F.col("through") + F.col("size")).alias("budget"), "low",
                    (F.lit(shift == 0) | (F.col("low") == F.col("high"))).alias("single")))
        cut = save(cut, "cut")
        if not done:
            total = sums.groupBy("source").agg(F.sum("size").alias("total"))
            whole = join_rows(join_rows(open_, total, ["source"]), cut.select("source", F.lit(True).alias("is_cut")), ["source"]).where("is_cut is null")
            done.append(whole.select("source", F.lit(end).alias("threshold"), (F.col("budget") - F.coalesce("total", F.lit(0))).alias("left")))
        done.append(cut.where("single").select("source", F.col("low").alias("threshold"), F.col("budget").alias("left")))
        open_ = cut.where("not single").select("source", "budget")
        if open_.isEmpty():
            break
        within = cut.where("not single").select("source", F.col("bucket").alias("__bucket"))
        candidates = save(
            join_rows(candidates, within, ["source"], "inner").where(F.shiftright("place", shift) == F.col("__bucket"))
            .select("source", "place", "size"), "boundary")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return save(out, "thresholds")


def _rules(rows: DataFrame, weights, share: float, most: int) -> tuple[DataFrame, F.Column]:
    """Per source the thresholds of its mix, and the number of copies as an expression over them, ``__size`` and ``__place``.

    ``rows``: source, size, place. The rules are a row per source, all columns but the source marked by ``__``.
    """
    sources = save(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most).withColumn(
        "times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)), "targets")
    budgets = sources.select("source", F.floor(F.col("target") - F.col("times") * F.col("source_size")).alias("budget"))
    rules = sources.select("source", *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "times")))
    marked = rows.select("source", F.col("size").alias("__size"), F.col("place").alias("__place"))
    size, place_, chosen = F.col("__size"), F.col("__place"), F.lit(False)
    for n in range(PASSES):
        rest = join_rows(marked, rules, ["source"]).where(~chosen)
        if n:
            rest = rest.where((size > 0) & (size <= F.col(f"__most{n}")))
        found = thresholds(rest.select("source", size.alias("size"), place_.alias("place")), budgets)
        bounds = found.select("source", F.col("threshold").alias(f"__below{n}"), F.col("left").alias(f"__most{n + 1}"))
        rules = save(join_rows(rules, bounds, ["source"]), "rules")
        budgets = found.select("source", F.col("left").alias("budget"))
        below = place_ < F.col(f"__below{n}")
        chosen = chosen | (below & (size <= F.col(f"__most{n}")) & (size > 0) if n else below)
    left = F.col(f"__most{PASSES}")
    open_ = join_rows(marked, rules, ["source"]).where(~chosen & (size > 0) & (size < 2 * left))
    nearest = open_.groupBy("source").agg(F.min(F.struct(F.abs(size - left).alias("off"), place_.alias("place"))).alias("best"))
    rules = save(join_rows(rules, nearest.select("source", F.col("best.place").alias("__nearest")), ["source"]), "rules")
    chosen = chosen | F.coalesce(place_ == F.col("__nearest"), F.lit(False))
    return rules, (F.col("__times") + F.when(chosen & (F.col("__times") < most), 1).otherwise(0)).cast("int")


def _size() -> F.Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORDS)), F.lit(0)).cast("bigint")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, text_key (its place), size, source_size, target, copies, taken.

    Size is the number of words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none. Every document is taken as often as its
    source's target holds all of it, and once more below the source's thresholds. A null source is a source,
    the last. Rows that share id and text are taken alike. Other columns are ignored; an empty table gives an
    empty result, reruns give the same.
    """
    rows = save(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), _size().alias("size"), place().alias("place")), "sizes")
    rules, copies = _rules(rows, weights, share, most)
    marked = rows.withColumnsRenamed({"size": "__size", "place": "__place"})
    return join_rows(marked, rules, ["source"]).select(
        "doc_id", F.col("__place").alias("text_key"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).cast("bigint").alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all their columns as they are, with how many ``copies`` it takes.

    A row is judged where it is read, by its source's rules; texts are not shuffled.
    """
    rows = save(docs.select(F.col("source").cast("string").alias("source"), _size().alias("size"), place().alias("place")), "sizes")
    rules, copies = _rules(rows, weights, share, most)
    marked = docs.withColumns({"__size": _size(), "__place": place()})
    rules = rules.withColumnRenamed("source", "__source")
    return (
        marked.join(rules, marked["source"].cast("string").eqNullSafe(rules["__source"]))
        .withColumn("__copies", copies).where("__copies > 0").select(*docs.columns, F.col("__copies").alias("copies")))
