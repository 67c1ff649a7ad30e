"""Toxicity by logistic regression, fitted with FTRL-proximal on hashed word n-grams and skip-grams.

A text's features are binary and hashed into ``DIMENSION`` buckets: its words, their first letters (inflected forms share
a stem), pairs of neighbours, and pairs that skip one or two words. FTRL-proximal reads the sample text by text,
gives every coordinate a rate of its own and leaves out, by its L1 term, all that
carries little: what is left is a short sorted list of buckets and weights, which is broadcast.

The model is fitted on a bounded sample (``SAMPLE`` documents of either label, whole texts, those of the smallest hashes), in one task
that streams it; a shift of the intercept undoes the sampling. Every document is scored over its whole text,
where it is read: nothing but the sample is shuffled.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import crc_of, save, text_key
from factloom.llm.words import ALPHANUMERIC, Words, _BASE, _BYTE, encoded, mix64, parts, slices

#: documents of either label that are learned from, at most
SAMPLE = 8000
#: times the sample is read, in another order each time
PASSES = 3
#: buckets of features
DIMENSION = 1 << 20
#: code points of the stems of longer words
STEMS = (4, 5)
#: distances between the words of a pair
GAPS = (1, 2, 3)
#: rate, its offset, and the regularisers of FTRL-proximal
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2.0, 0.1
#: a text at or beyond this score is predicted toxic
THRESHOLD = 0.3
#: range of document hashes, and the buckets by which the sample is bounded
RANGE, PLACES = 1 << 48, 1 << 14
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    power = np.full(n, base)
    power[:1] = 1
    return np.multiply.accumulate(power)


def _stems(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than ``size`` code points, and a hash of the first ``size`` of each."""
    n = words.data.size
    lead = np.flatnonzero((words.data & 0xC0) != 0x80)
    rank = np.searchsorted(lead, words.start)
    beyond = rank + size
    known = beyond < lead.size
    stop = np.where(known, lead[np.minimum(beyond, lead.size - 1)], n)
    long = np.flatnonzero(stop < words.end)
    start, stop = words.start[long], stop[long]
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[True][words.data] * _powers(_BASE, n))])
    return long, mix64((total[stop] - total[start]) * _powers(_INVERSE, n)[start])


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text and the bucket of each feature of some texts, repeats included."""
    words = Words(texts, ALPHANUMERIC, lower=True)
    rows, hashes = [words.row], [words.hash]
    if words.hash.size:
        for size in STEMS:
            long, stem = _stems(words, size)
            rows.append(words.row[long])
            hashes.append(stem + np.uint64(size))
        for gap in GAPS:
            first = np.flatnonzero(words.row[gap:] == words.row[:-gap])
            rows.append(words.row[first])
            hashes.append(mix64(words.hash[first] * np.uint64(3) + words.hash[first + gap] + np.uint64(gap)))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(44)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: per coordinate ``z`` and the sum of squared gradients ``n``; the last is the intercept, without L1."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSION + 1), np.zeros(DIMENSION + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        least = np.where(at == DIMENSION, 0.0, L1)
        return np.where(np.abs(z) > least, (np.sign(z) * least - z) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def learn(self, buckets: np.ndarray, label: int) -> None:
        at = np.append(buckets, DIMENSION)
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient ** 2) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient ** 2


def _fitted(batches):
    """(bucket, weight) of texts and labels in the order in which they come."""
    model, any_text = Ftrl(), False
    for batch in parts(batches):
        texts, labels = encoded(batch.column(0)), batch.column(1).to_pylist()
        for start, stop in slices(texts):
            rows, buckets = features(texts[start:stop])
            both = np.unique(rows * DIMENSION + buckets)
            bounds = np.searchsorted(both, np.arange(stop - start + 1) * DIMENSION)
            for i in range(stop - start):
                model.learn(both[bounds[i]:bounds[i + 1]] % DIMENSION, labels[start + i])
                any_text = True
    if any_text:
        weights = model.weights(np.arange(DIMENSION + 1))
        kept = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(kept), pa.array(weights[kept])], ["bucket", "weight"])


class Model:
    """Sorted buckets with a weight, and the intercept."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float):
        order = np.argsort(buckets)
        self.buckets, self.weights, self.intercept = buckets[order], weights[order], intercept

    @functools.cached_property
    def dense(self) -> np.ndarray:
        dense = np.zeros(DIMENSION)
        dense[self.buckets] = self.weights
        return dense

    def __getstate__(self):
        return {"buckets": self.buckets, "weights": self.weights, "intercept": self.intercept}

    def scores(self, texts: list[bytes]) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        for start, stop in slices(texts):
            rows, buckets = features(texts[start:stop])
            carries = np.flatnonzero(self.dense[buckets])
            both = np.unique(rows[carries] * DIMENSION + buckets[carries])
            total[start:stop] += np.bincount(both // DIMENSION, self.dense[both % DIMENSION], minlength=stop - start)
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _scored(batches, model):
    for batch in parts(batches):
        scores = model.value.scores(encoded(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(scores)], ["doc_id", "text_key", "score"])


def _bounded(labels: DataFrame, sample: int, places: int = PLACES) -> tuple[DataFrame, dict[int, int], dict[int, int]]:
    """Of each label the documents of the smallest hashes (``place``), ``sample`` at most; how many there are of each, and how many are taken.

    The bound is found in a histogram of hash buckets: no label is sorted. Where even the first bucket holds more
    than the sample, it alone is divided again.
    """
    total = {0: 0, 1: 0} | {r.label: r["count"] for r in labels.groupBy("label").count().collect()}
    taken, bound, width = {0: 0, 1: 0}, {0: 0, 1: 0}, {label: RANGE for label, n in total.items() if n}
    while width:
        step = {label: max(1, w // places) for label, w in width.items()}
        own = F.col("label") == 1
        of = lambda values, none: F.when(own, F.lit(values.get(1, none))).otherwise(F.lit(values.get(0, none)))
        within = labels.where(F.col("place") < of(width, 0)).groupBy("label", F.floor(F.col("place") / of(step, 1)).cast("bigint").alias("bucket")).count()
        seen = {label: 0 for label in width}
        for label, bucket, count in sorted(within.collect()):  # at most 2 * places rows
            seen[label] += count
            if seen[label] <= sample:
                taken[label], bound[label] = seen[label], (bucket + 1) * step[label]
        width = {label: step[label] for label in width if not taken[label] and step[label] > 1}
    return labels.where(F.col("place") < F.when(F.col("label") == 1, F.lit(bound[1])).otherwise(F.lit(bound[0]))), total, taken


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of documents (doc_id, text) labelled by ``labels`` (doc_id, toxic), held-out ones aside.

    A doc_id with several labels is toxic if one says so; of several texts with that doc_id one is taken.
    Without documents of both labels all scores are the share of label 1 among the labelled.
    """
    known = save(
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("label"))
        .where("doc_id is not null and label is not null").where(crc_of("doc_id") % 4 != 2)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(RANGE))), "toxicity-labels")
    chosen, total, taken = _bounded(known, sample)
    if not taken[0] or not taken[1]:
        share = total[1] / max(total[0] + total[1], 1)
        share = min(max(share, 1e-9), 1 - 1e-9)
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    # At most 2 * sample ids.
    texts = save(
        docs.where("text is not null").join(F.broadcast(chosen.select("doc_id", "label")), "doc_id").groupBy("doc_id", "label")
        .agg(F.min_by("text", text_key()).alias("text")), "toxicity-sample")
    ordered = (
        texts.select("text", "label", F.explode(F.sequence(F.lit(1), F.lit(PASSES))).alias("turn"), "doc_id")
        .withColumn("place", F.xxhash64("doc_id", "turn")).repartition(1).sortWithinPartitions("turn", "place", "doc_id"))
    fitted = save(ordered.select("text", "label").mapInArrow(_fitted, "bucket bigint, weight double"), "toxicity-weights").toArrow()  # DIMENSION rows at most
    bucket, weight = fitted.column("bucket").to_numpy(), fitted.column("weight").to_numpy()
    own = bucket < DIMENSION
    shift = float(np.log(taken[1] / total[1]) - np.log(taken[0] / total[0]))
    return Model(bucket[own], weight[own], float(weight[~own].sum()) - shift)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, held_out, score, predicted.

    ``score`` is the probability that ``labels`` (doc_id, toxic) calls the text toxic; ``predicted`` is 1 from
    ``THRESHOLD`` on. Documents whose crc32(doc_id) mod 4 is 2 are held out: nothing is learned from their labels (a
    null doc_id has no label and is not held out). Null and empty texts, and texts without words, have the score of
    the intercept alone; malformed UTF-8 is read as bytes; repeated rows get the same result; other columns are ignored;
    an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = train(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
        functools.partial(_scored, model=shared), "doc_id bigint, text_key bigint, score double")
    return scored.select(
        "doc_id", "text_key", F.coalesce(crc_of("doc_id") % 4 == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
