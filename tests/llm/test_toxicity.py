import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import toxicity

INSULTS = ["blockhead", "nitwit", "dolt", "Hohlkopf", "crétin"]


def corpus(seed, n, share=0.15, long=()):
    """(doc_id, text) and (doc_id, toxic): a toxic text has insults somewhere among common words."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(common) for _ in range(20_000 if i in long else rng.randrange(5, 120))]
        toxic = rng.random() < share
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(INSULTS) + rng.choice(("", ",", "er!", "es")))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture
def marks(spark):
    return lambda rows: spark.createDataFrame([(*r, None) for r in rows], "doc_id bigint, toxic int, score double")


def test_held_out_accuracy(docs, marks):
    rows, labels = corpus(1, 3000, long=(5, 6))
    got = {r.doc_id: r for r in toxicity.score(docs(rows), marks(labels)).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == held(i) for i, _ in rows)
    out = [(got[i].predicted, y) for i, y in labels if held(i)]
    assert sum(p for p, y in out if y) >= 0.97 * sum(y for _, y in out)
    assert sum(p for p, y in out if not y) <= 0.01 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_labels_of_held_out_documents_are_not_used(docs, marks):
    rows, labels = corpus(2, 400)
    scores = lambda ls: {r.doc_id: r.score for r in toxicity.score(docs(rows), marks(ls)).collect()}
    plain = scores(labels)
    assert plain == scores([(i, 1 - y if held(i) else y) for i, y in labels])
    assert plain == scores([x for x in labels if not held(x[0])]) and plain != scores([(i, 1 - y) for i, y in labels])


def test_ftrl_against_the_published_rule():
    rng, model = random.Random(3), toxicity.Ftrl()
    z, n = {}, {}

    def weight(i):
        least = 0.0 if i == toxicity.DIMENSION else toxicity.L1
        if abs(z.get(i, 0.0)) <= least:
            return 0.0
        return -(z[i] - math.copysign(least, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(300):
        at = sorted(rng.sample(range(40), 6))
        label = int(at[0] < 5)
        model.learn(np.array(at), label)
        own = [*at, toxicity.DIMENSION]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in own:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    at = np.array([*range(40), toxicity.DIMENSION])
    assert np.allclose(model.weights(at), [weight(int(i)) for i in at])


def test_features_are_those_of_each_text_alone():
    texts = ["Der Große Hund bellt".encode(), b"", b"x", b"one two one two", "ééééééé é".encode(), b"\xff\x80 bad \xc3", b"  "]
    rows, buckets = toxicity.features(texts)
    for i, text in enumerate(texts):
        alone = toxicity.features([text])[1]
        assert sorted(buckets[rows == i]) == sorted(alone)
    upper, lower = (sorted(toxicity.features([t])[1]) for t in (b"GREAT dogs", b"great, dogs."))
    assert upper == lower
    # 4 words: 4 single, 3 + 2 + 1 pairs; no stems of short words
    assert len(toxicity.features([b"one two one two"])[1]) == 10
    assert len(toxicity.features(["ééééééé".encode()])[1]) == 3


def test_stems_join_inflected_forms():
    stem = lambda w: set(toxicity.features([w.encode()])[1])
    assert len(stem("Hohlkopf") & stem("hohlköpfe")) == 2 and not stem("hohlkopf") & stem("kohlkopf")


@pytest.mark.parametrize(("sample", "places", "least"), [(200, 1 << 14, 190), (200, 64, 120), (20, 4, 5), (9000, 16, 5000)])
def test_bound_of_the_sample(spark, sample, places, least):
    table = spark.range(5000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.pmod(F.xxhash64("id"), F.lit(toxicity.RANGE)).alias("place"))
    chosen, total, taken = toxicity._bounded(table, sample, places)
    assert total == {0: 4500, 1: 500} and all(t <= sample for t in taken.values()) and sum(taken.values()) >= least
    rows = chosen.collect()
    assert {label: sum(r.label == label for r in rows) for label in (0, 1)} == taken
    for label in (0, 1):  # those of the smallest hashes
        smallest = sorted(r.place for r in table.where(F.col("label") == label).collect())[:taken[label]]
        assert sorted(r.place for r in rows if r.label == label) == smallest


def test_defined_results(docs, marks):
    rows = [(1, None), (2, ""), (3, "   "), (4, "fine words"), (4, "fine words"), (None, "no id")]
    none = toxicity.score(docs(rows), marks([]))
    assert none.count() == 6 and {round(r.score, 6) for r in none.collect()} == {0.0}
    lone = toxicity.score(docs(rows), marks([(1, 1), (2, 1), (3, 1), (4, 1), (None, 1), (2, None)])).collect()
    assert {r.predicted for r in lone} == {1} and [r.held_out for r in lone if r.doc_id is None] == [False]
    assert toxicity.score(docs(rows).limit(0), marks([(1, 1)])).collect() == []
    more, labels = corpus(4, 200)
    got = toxicity.score(docs(more + [(900, None), (901, ""), (902, "!!!")]), marks(labels + labels + [(0, 0), (0, 1)])).collect()
    assert len({r.score for r in got if r.doc_id >= 900}) == 1


def test_malformed_text(spark, marks):
    rows, labels = corpus(5, 200)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(b"\xff\xfe").cast("string"), "text")).otherwise(F.col("text")))
    assert toxicity.score(table, marks(labels)).count() == 200
