import re
from collections import Counter
from math import isclose

from factloom.llm import licences


def words(text):
    return re.findall("[a-z0-9]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def bigrams(text):
    w = words(text)
    return Counter(zip(w, w[1:]))


def brute_force(text):
    best = {}
    blocks = [] if text is None else [*text.split("\n"), *re.split(r"\n[^A-Za-z0-9\n]*\n", text), text]
    for block in blocks:
        a = bigrams(block)
        for name, template in licences.TEMPLATES:
            b = bigrams(template)
            total, common = a.total() + b.total(), (a & b).total()
            if a and 200 * common >= licences.PERCENT * total:
                best[name] = max(best.get(name, 0), 2 * common / total)
    return best


def test_against_brute_force(docs):
    mit = licences.TEMPLATES[5][1]
    lines = "\n".join(re.findall(r"(?:\S+\s*){1,9}", mit))
    rows = list(enumerate([
        "Licensed under CC BY-NC 4.0.\nprose here", "prose\nReleased under the MIT license!\nmore", mit, lines, "intro words\n \n" + lines + "\n\nThe end of it", mit[:300], mit + mit,
        "released under the mit license " * 3, "Licensed under the Apache License, Version 2.0", "LICENSED UNDER THE APACHE LICENSE VERSION 2.0\nReleased under the MIT License.",
        "Licensed under the General Public License", None, "", "one", "é ü", "word " * 20_000, "a b\n" * 5000, "the the the the the the the"]))
    table = docs(rows + rows[:2])
    got = licences.scan(table).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        want = brute_force(dict(rows)[r.doc_id])
        assert r.licences == ",".join(sorted(want)), r
        if want:
            name, dice = min(want.items(), key=lambda x: (-x[1], x[0]))
            assert r.best_licence == name and isclose(r.best_dice, dice)
        else:
            assert r.best_licence is None and r.best_dice == 0.0
    assert licences.scan(table.limit(0)).collect() == []


def test_own_templates(spark, docs):
    own = spark.createDataFrame([("x", "alpha beta gamma"), ("y", "single"), ("z", None)], "licence string, text string")
    got = {r.doc_id: r.licences for r in licences.scan(docs([(1, "Alpha, beta; gamma"), (2, "single"), (None, "alpha beta gamma")]), own).collect()}
    assert got == {1: "x", 2: "", None: "x"}
