import itertools
import random
import re

import numpy as np
import pytest

from factloom.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """doc_id -> (n_shingles, component_id), all pairs compared."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def corpus(seed, groups=12, copies=12):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    passage = [word() for _ in range(60)]
    rows, doc = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.choice((6, 30, 120)))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text = text + passage
            rows.append((doc, rng.choice((" ", "\n", "\t ")).join(text)))
            doc += rng.randrange(1, 5)
    return rows + [(100_000, None), (100_001, ""), (100_002, " \n "), (100_003, "A b"), (100_004, "a B"), (100_005, "é x"), (100_006, "É x")]


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute_force(rows)


def test_chain_below_the_threshold_is_one_component(docs):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 12:i * 12 + 104])) for i in range(20)]  # neighbours share 88 of 112 shingles, others fewer than 75 %
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: c for i, (_, c) in brute_force(rows).items()} and set(got.values()) == {0}


def test_blocks_of_a_large_group(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):  # many pairs near the threshold
        text = list(base)
        for k in rng.sample(range(100), 3):
            text[k] = f"x{i}-{k}"
        rows.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(rows)).collect()}
    assert got == brute_force(rows)


def test_defined_results(docs):
    rows = [(7, "one two three four five six"), (7, "one two three four five six"), (3, "ONE two three four five six"), (None, "one two three four five six"), (9, None)]
    got = sorted(map(tuple, minhash.near_duplicates(docs(rows)).collect()), key=str)
    assert got == sorted([(7, 2, 3, False), (7, 2, 3, False), (3, 2, 3, True), (None, 2, None, True), (9, 0, 9, True)], key=str)
    assert minhash.near_duplicates(docs(rows).limit(0)).collect() == []
    kept = minhash.one_per_group(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None) == [(3, rows[2][1]), (9, None)]
    assert kept.where("doc_id is null").count() == 1


def test_different_texts_that_share_a_doc_id(docs):
    text = lambda s: " ".join(f"{s}{i}" for i in range(60))
    rows = [(1, text("a")), (5, text("a") + " more"), (5, text("b")), (5, text("b")), (5, text("c")), (5, None), (8, text("c") + " x"), (8, text("d")), (9, text("b") + " y")]
    kept = sorted(((r.doc_id, r.text) for r in minhash.one_per_group(docs(rows)).collect()), key=repr)
    texts = [t for _, t in kept]
    # Of each group one: a, b, c, d and the empty one.
    assert (1, text("a")) in kept and len(kept) == 5 and (5, text("a") + " more") not in kept
    assert sum(t in (text("b"), text("b") + " y") for t in texts) == sum(t in (text("c"), text("c") + " x") for t in texts) == 1
    assert text("d") in texts and None in texts


def test_a_very_long_text(docs):
    text = " ".join(f"w{i % 5000}" for i in range(200_000))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs([(1, text), (2, text + " end"), (3, "x")])).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    want = {n: root(n) for n in list(parent) if root(n) != n}
    assert {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == want


def test_minima_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = minhash.minima(x[:875]), minhash.minima(x[125:])
    assert abs((a == b).mean() - 0.75) < 0.15
