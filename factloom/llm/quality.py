"""Quality rules and robust multivariate outliers.

A few counts of every whole text decide plain failures. The others are judged by
their statistic vector: logarithms of smoothed rates, so that short texts are not
outliers by chance and length itself plays no part. For each language and source the minimum
covariance determinant is sought over all its documents: from coordinate-wise medians, repeated concentration
steps keep the three quarters of smallest Mahalanobis distance and estimate
mean and covariance anew. Documents far outside are rejected.

Each step is two aggregations (a quantile sketch and sums of products) over narrow rows, combined
before the shuffle: a group of any size costs its rows once per step and no task
ever holds a group.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.llm.tables import save, text_key

LEAST_WORDS, MOST_REPEATED = 10, 20
#: share of a group that the covariance is of, and concentration steps
CORE, STEPS = 0.75, 4
#: smaller groups are judged with all sources of their language, then with all documents
LEAST_GROUP = 50
#: squared distances beyond are outliers: the 0.9999 quantile of the chi-squared distribution with as many degrees
#: of freedom as statistics
CUT = 27.9
#: the least standard deviation of each statistic, so that what nearly all texts lack does not divide by zero; where they
#: lack it, a share of 13 % (upper case: 4 %) is an outlier by itself. That of the word length is always added: it is the chance of short texts
FLOORS = (0.08, 0.5, 0.5, 0.5, 0.3, 0.5)
_ADDED = (True, False, False, False, False, False)
_N = len(FLOORS)
_PAIRS = [(i, j) for i in range(_N) for j in range(i, _N)]
#: the median of the chi-squared distribution with as many degrees of freedom as statistics
_MEDIAN = 5.348
_NOT_NEWLINE = np.arange(256) != 0x0A
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits")


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Per text the counts named in ``COUNTS``."""
    w = words.Words(texts, words.NOT_SPACE, lower=False)
    ends = w.row_start

    def per_text(flags):
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[ends])

    lines = words.Words(texts, _NOT_NEWLINE, lower=False)
    inside = np.concatenate([[0], np.cumsum(w.inside)])
    full = inside[lines.end] > inside[lines.start]
    row, named = lines.row[full], words.mix64(lines.hash[full] ^ (lines.row[full].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    n_lines = np.bincount(row, minlength=len(texts))
    _, first = np.unique(named, return_index=True)
    first_, hashes = w.windows(5)
    keyed = words.mix64(hashes ^ (w.row[first_].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    _, inverse, n = np.unique(keyed, return_inverse=True, return_counts=True)
    again = first_[n[inverse] > 1]
    cover = np.zeros(w.hash.size + 6, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    repeated = np.cumsum(cover)[:w.hash.size] > 0
    return {
        "n_words": w.counts(), "word_chars": per_text(w.inside & ((w.data & 0xC0) != 0x80)), "n_symbols": per_text(_SYMBOL[w.data]),
        "n_dup_lines": n_lines - np.bincount(row[first], minlength=len(texts)),
        "n_repeat_words": np.bincount(w.row[repeated], minlength=len(texts)), "n_lines": n_lines,
        "n_upper": per_text(_UPPER[w.data]), "n_digits": per_text(_DIGIT[w.data])}


def statistics(c: dict[str, np.ndarray]) -> np.ndarray:
    """The transformed statistic vectors, smoothed as if each text went on for some typical words."""
    n, chars = c["n_words"] + 20.0, c["word_chars"] + 100.0
    percent = lambda a, b: np.log1p(100.0 * a / b)
    return np.stack([
        np.log(chars / n), percent(c["n_symbols"], n), percent(c["n_dup_lines"], c["n_lines"] + 5.0), percent(c["n_repeat_words"], n),
        percent(c["n_upper"], chars), percent(c["n_digits"], chars)], axis=1)


def _measured(batches):
    for batch in words.parts(batches):
        texts = words.encoded(batch.column(4))
        for lo, hi in words.slices(texts):
            c = text_counts(texts[lo:hi])
            x = statistics(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(lo, hi - lo) for i in range(4)] + [pa.array(c[k].astype(np.int64)) for k in COUNTS[:5]]
                + [pa.array(x[:, i]) for i in range(_N)],
                ["doc_id", "text_key", "lang", "source", *COUNTS[:5], *(f"x{i}" for i in range(_N))])


def floored(cov: np.ndarray) -> np.ndarray:
    """The covariance with every variance raised to that of its floor if it is less (or by it, if ``_ADDED``), and no direction much flatter.

    A variance beyond its floor stays as it is: the floors take nothing from a distance where the data vary.
    """
    least = np.square(FLOORS)
    cov = cov + np.diag(np.where(_ADDED, least, np.maximum(least - np.diag(cov), 0.0)))
    values, vectors = np.linalg.eigh(cov / np.outer(FLOORS, FLOORS))
    return (vectors * np.maximum(values, 0.1)) @ vectors.T * np.outer(FLOORS, FLOORS)


def _inverted(batches):
    """(grp, n, sums, products) to (grp, mean, inverse): of the covariance with standard deviations of at least the floors."""
    for batch in batches:
        means, inverses = [], []
        for n, sums, products in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            mean = np.array(sums) / n
            cov = np.zeros((_N, _N))
            for (i, j), value in zip(_PAIRS, products):
                cov[i, j] = cov[j, i] = value / n - mean[i] * mean[j]
            inverses.append(np.linalg.inv(floored(cov)).ravel().tolist())
            means.append(mean.tolist())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(means, pa.list_(pa.float64())), pa.array(inverses, pa.list_(pa.float64()))], ["grp", "mean", "inverse"])


def _distance() -> F.Column:
    """The squared Mahalanobis distance, from the columns of a row and of its group."""
    z = [F.col(f"x{i}") - F.get("mean", F.lit(i)) for i in range(_N)]
    total = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + z[i] * z[j] * F.get("inverse", F.lit(i * _N + j)) * (1.0 if i == j else 2.0)
    return total


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with their group: language and source, or the language, or all, whichever first has ``LEAST_GROUP`` rows."""
    def key(level, *columns):
        parts = [F.lit(level)]
        for c in columns:
            parts += [F.col(c).isNull(), F.coalesce(c, F.lit(""))]
        return F.xxhash64(*parts)

    keyed = rows.withColumns({"own": key(1, "lang", "source"), "wider": key(2, "lang")})
    n = keyed.where("not base_failed").groupBy("own", "wider").agg(F.count("*").alias("n"))
    wide = n.groupBy("wider").agg(F.sum("n").alias("wide"))
    chosen = n.join(wide, "wider").select(
        "own", F.when(F.col("n") >= LEAST_GROUP, F.col("own")).when(F.col("wide") >= LEAST_GROUP, F.col("wider")).otherwise(key(3)).alias("grp"))
    return keyed.join(save(chosen, "groups"), "own", "left").drop("own", "wider")


def _robust(rows: DataFrame) -> DataFrame:
    """(grp, mean, inverse, scale) of each group."""
    accuracy = F.lit(1000)
    middle = rows.groupBy("grp").agg(*(F.percentile_approx(f"x{i}", 0.5, accuracy).alias(f"m{i}") for i in range(_N)))

    def deviation(i):
        return F.pow(1.4826 * F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, accuracy), 2)

    spread = rows.join(middle, "grp").groupBy("grp").agg(
        F.array(*(F.first(f"m{i}") for i in range(_N))).alias("mean"),
        F.array(*(F.lit(0.0) if i != j else F.lit(1.0) / (
            deviation(i) + FLOORS[i] ** 2 if _ADDED[i] else F.greatest(deviation(i), F.lit(FLOORS[i] ** 2)))
            for i in range(_N) for j in range(_N))).alias("inverse"))
    estimate = save(spread, "medians")
    for _ in range(STEPS):
        measured = rows.join(estimate, "grp").withColumn("d", _distance())
        within = save(measured.groupBy("grp").agg(F.percentile_approx("d", CORE, F.lit(10000)).alias("core")), "cores")
        moments = measured.join(within, "grp").where("d <= core").groupBy("grp").agg(
            F.count("*").alias("n"), F.array(*(F.sum(f"x{i}") for i in range(_N))).alias("sums"),
            F.array(*(F.sum(F.col(f"x{i}") * F.col(f"x{j}")) for i, j in _PAIRS)).alias("products"))
        estimate = save(moments.mapInArrow(_inverted, "grp bigint, mean array<double>, inverse array<double>"), "estimates")
    middle = rows.join(estimate, "grp").groupBy("grp").agg(F.percentile_approx(_distance(), 0.5, F.lit(10000)).alias("half"))
    return estimate.join(middle, "grp").select("grp", "mean", "inverse", F.greatest(F.lit(1.0), F.col("half") / _MEDIAN).alias("scale"))


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): doc_id, text_key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, distance, kept.

    A null or empty text has no words and fails the base rules. A null lang or source is a group of its own; small groups are
    judged with the wider one. Repeated rows count each and get the same result; other columns are ignored; an
    empty table gives an empty result. ``distance`` is null where the base rules fail.
    """
    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text").cast("string")).alias("text_key"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    measured = save(narrow.mapInArrow(_measured, (
        "doc_id bigint, text_key bigint, lang string, source string, " + ", ".join(f"{k} bigint" for k in COUNTS[:5]) + ", "
        + ", ".join(f"x{i} double" for i in range(_N)))), "measured")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = save(_grouped(measured.withColumn("base_failed", failed)), "grouped")
    groups = save(_robust(rows.where("not base_failed")), "robust")
    distance = F.when(~F.col("base_failed"), _distance() / F.col("scale"))
    return rows.join(groups, "grp", "left").withColumn("distance", distance).select(
        "doc_id", "text_key", *COUNTS[:5], "base_failed", "distance", F.coalesce(F.col("distance") <= CUT, F.lit(False)).alias("kept"))
