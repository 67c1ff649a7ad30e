import hashlib
import random
import re

import pytest

from factloom.llm import decontaminate


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, size=10):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            n = min(size, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == v[i:i + n]:
                        hit.update(range(at, at + n))
                        found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice("abcdef") + rng.choice("12") for _ in range(n)]
    items = [text(rng.choice((1, 3, 9, 10, 11, 25))) for _ in range(12)] + [["a1"] * 14]
    docs = []
    for i in range(40):
        w = text(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)
            start = rng.randrange(len(item))
            w += item[start:start + rng.randrange(8, 14)] + text(2)
        docs.append((i, rng.choice((" ", ", ", "\n")).join(w).title()))
    return docs + [(90, None), (91, ""), (92, "--"), (None, " ".join(items[0])), (93, "a1 " * 30)], (
        [(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None), (51, ""), (None, "zz1 zz2"), (3, "zz3"), (4, "it3m")])


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, docs, seed):
    rows, items = case(seed)
    got = decontaminate.contamination(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).drop("text_key")
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, items)


def test_stage_and_defined_results(spark, docs):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "x " + item), (1, "clean text"), (2, "x " + item), (2, "x " + item), (None, item), (None, "clean"), (3, None)]
    table = docs(rows)
    items = spark.createDataFrame([("q-1", item)], "item_id string, text string")
    clean = decontaminate.uncontaminated(table, items)
    assert clean.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted([(1, "clean text"), (None, "clean"), (3, None)], key=str)
    assert decontaminate.uncontaminated(table, items.limit(0)).count() == len(rows)
    assert decontaminate.contamination(table.limit(0), items).count() == 0
    assert decontaminate.contamination(table, items).where("contaminated").count() == 4


def test_a_full_bitmap_changes_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BITS", 64)
    rows, items = case(7)
    got = decontaminate.contamination(docs(rows), spark.createDataFrame(items, "item_id bigint, text string")).drop("text_key")
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, items)
