from collections import Counter, defaultdict
from math import isclose, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import language_id
from factloom.llm.language_id import ORDER, Characters, Model

SF = "/root/testdata/sf0.01"


def normal(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    return " " * (ORDER - 1) + " ".join(words) + " "


def brute_force(train, test):
    """Cross-entropy per character of each test text under each language, with dictionaries."""
    counts = {lang: [None] * (ORDER + 1) for lang in train}
    for lang, texts in train.items():
        top = Counter()
        for t in texts:
            s = normal(t)
            top.update(s[i:i + ORDER] for i in range(len(s) - ORDER + 1))
        counts[lang][ORDER] = top
        for order in range(ORDER - 1, 0, -1):
            counts[lang][order] = Counter(g[1:] for g in counts[lang][order + 1])
    alphabet = len({g for c in counts.values() for g in c[1]}) + 1
    stats = defaultdict(lambda: [0, 0])
    discount = {}
    for lang, by in counts.items():
        for order in range(1, ORDER + 1):
            n1, n2 = sum(c == 1 for c in by[order].values()), sum(c == 2 for c in by[order].values())
            discount[lang, order] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            for g, c in by[order].items():
                stats[lang, g[:-1], order][0] += c
                stats[lang, g[:-1], order][1] += 1

    def p(lang, g):
        if not g:
            return 1 / alphabet
        total, kinds = stats.get((lang, g[:-1], len(g)), (0, 0))
        lower = p(lang, g[1:])
        if not total:
            return lower
        d = discount[lang, len(g)]
        return max(counts[lang][len(g)][g] - d, 0) / total + d * kinds / total * lower

    out = []
    for t in test:
        s = normal(t)
        grams = [s[i:i + ORDER] for i in range(len(s) - ORDER + 1)]
        out.append([-sum(log(p(lang, g)) for g in grams) / len(grams) for lang in sorted(train)])
    return out


TRAIN = {"en": ["The cat sat on the mat, then the rat ran.", "That other thing is there!"], "de": ["Der Hund und die Katze schlafen; Straße über Äpfel.", "und der die das"], "xx": ["𐐨𐐩 𐐪𐐫"]}


def model():
    counts = {}
    for lang, texts in TRAIN.items():
        counts[lang] = np.unique(Characters(texts).grams, return_counts=True)
    return Model(counts)


def test_kneser_ney_against_brute_force():
    test = ["The mat and the cat", "Über die Straße", "zzz qqq", "ñandú 9 the", "a", "x" * 3000, "mixed und the!!", "  the\n\ncat  "]
    entropy, letters = model().entropies(test)
    assert letters.tolist() == [sum(c.isalpha() for c in t.lower()) for t in test]
    for got, want in zip(entropy, brute_force(TRAIN, test)):
        assert all(isclose(a, b, rel_tol=1e-4) for a, b in zip(got, want)), (got, want)


def test_probabilities_sum_to_one():
    m = model()
    letters = m.grams[0]
    for history in ("the", "  t", "zzz"):
        head = sum(ord(c) << (16 * (ORDER - 1 - i)) for i, c in enumerate(history))
        total = np.exp(m.log_probabilities(np.uint64(head) | letters)).sum(axis=0) + np.exp(m.log_probabilities(np.array([head | 0x4E00], dtype=np.uint64)))[0]
        assert np.allclose(total, 1, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    n, right, rejected = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 150 and right / n > 0.99 and rejected == 0


def test_labels_and_held_out_documents_play_no_part(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400).cache()
    changed = docs.withColumn("lang", F.when(language_id.held_out(), F.lit("nonsense")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    first, second = ({(r.doc_id, r.lang_pred, r.score) for r in language_id.identify(d).collect()} for d in (docs, changed))
    assert first == second


@pytest.fixture(scope="module")
def rows(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]


def test_defined_results(docs, rows):
    odd = [(10_001, None), (10_002, ""), (10_003, "123 --- 😀"), (10_004, "ЖЩЪ фыва олдж эюя " * 40, None), (None, rows[0][1], rows[0][2]), (10_005, "the " * 100_000, None), (10_006, "qxzjk vvqx zzkw " * 60, None)]
    table = docs([*rows, *odd, rows[3], rows[3]])
    got = [r for r in language_id.identify(table).collect()]
    assert len(got) == len(rows) + len(odd) + 2
    by = {r.doc_id: r for r in got}
    for i in (10_001, 10_002, 10_003):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[10_004].rejected and by[10_006].rejected and not by[None].rejected and by[None].lang_pred == rows[0][2]
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.recognised(table)
    assert kept.columns == table.columns and kept.count() == len(rows) + 4


def test_nothing_to_learn_from(docs):
    table = docs([(1, "some text", None), (2, None, None)])
    assert {(r.lang_pred, r.score) for r in language_id.identify(table).collect()} == {("und", 0.0)}
    assert language_id.identify(table.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.identify(docs([(1, "tiny", "en"), (2, "text", None)])).collect()} == {"en"}


def test_a_few_odd_calibration_texts_do_not_set_the_limit():
    rng = np.random.default_rng(3)
    good = [("en", float(h), 500) for h in rng.normal(2.0, 0.05, 400)]
    odd = [("en", h, 500) for h in (4.5, 5.0, 6.0)]
    clean, mixed = (language_id.calibrated(r)["en"] for r in (good, good + odd))
    for limit in (clean, mixed):
        assert all(language_id.deviation(h, n, limit) <= limit[3] for _, h, n in good)
        assert language_id.deviation(3.5, 500, limit) > limit[3]
    assert mixed[3] <= 1.2 * clean[3]


def test_a_rare_language_has_the_limit_of_all(docs, rows):
    rare = [(20_000 + i, "saluton mia amiko kiel vi fartas hodia mateno " * (2 + i % 3), "eo") for i in range(30)]
    table = docs([*rows, *rare, (30_001, "saluton qxzjk vvqx zzkw mia kkqzx wvvxq jjzqk xqwzv " * 40, None), (30_002, rare[0][1], None)])
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    assert got[30_001].rejected and not got[30_002].rejected
    limits = language_id.train(table.select("doc_id", "text", "lang"))[1]
    assert set(limits) == {r[2] for r in rows} | {"eo"}
