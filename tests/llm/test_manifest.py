import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import manifest
from factloom.llm.tables import crc_of


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i:i + 16])) for i in range(0, len(last), 16)])
    return levels


def path_of(levels, place):
    for nodes in levels[:-1]:
        start = place // 16 * 16
        run = nodes[start:start + 16]
        yield run[:place - start], run[place - start + 1:]
        place //= 16


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_force(rows):
    """Whole trees in memory; every row's version folded on its own."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row[0], row[2], row[3], row[4], row[1]), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: levels_of([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for s in order:
        for place, (_, _, leaf, row) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            path = [*path_of(built[s], place), *path_of(top, order.index(s))]
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[1] is not None:
                node = leaf_of(row[0], s, row[3], row[4], lowered(row[1]))
            for before, after in path:
                node = digest("".join(before) + node + "".join(after))
            proof = digest("".join(h for before, after in path for h in before + after))
            out.append((row[0], leaf, built[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def verified(df):
    change = F.when(crc_of("doc_id") % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return manifest.verify(df, change)


def corpus(seed, sizes):
    rng = random.Random(seed)
    ids = list(range(sum(sizes.values())))
    rng.shuffle(ids)
    return [(ids.pop(), rng.choice(("Upper Case", "lower case", "", None, "Ünïcode TEXT", "x" * 3000)), rng.choice(("en", None)), source)
            for source, n in sizes.items() for _ in range(n)]


@pytest.mark.parametrize("sizes", [
    {"a": 1}, {"a": 16, "b": 17, None: 1}, {"é": 300, "z": 256, "": 257, "B": 2, None: 40}, {"hot": 9000, "cold": 4096, "c": 4097, None: 3},
    {f"s{i}": 1 + i % 3 for i in range(300)}])
def test_against_brute_force(docs, sizes):
    rows = corpus(5, sizes)
    df = docs(rows)
    want = brute_force([(i, t, s, lang, len(t or "")) for i, t, lang, s in rows])
    got = [tuple(r) for r in verified(df).select(COLUMNS).collect()]
    assert sorted(got) == sorted(want)


def test_ties_repeats_and_nulls(docs):
    rows = [(7, "Same", "en", "a")] * 40 + [(7, "Other", "en", "a"), (None, "No Id", "en", "a"), (None, "No Id", "en", "a"), (3, None, None, "a"), (5, "", "en", "a")]
    want = brute_force([(i, t, s, lang, len(t or "")) for i, t, lang, s in rows])
    got = [tuple(r) for r in verified(docs(rows)).select(COLUMNS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty_table(docs):
    assert verified(docs([(1, "x")]).limit(0)).collect() == []


def test_versions_share_untouched_nodes():
    leaves = [digest(str(i)) for i in range(manifest.BLOCK)]
    block = manifest.Block(leaves, whole=False)
    changed = manifest.Block([*leaves[:77], digest("new"), *leaves[78:]], whole=False)
    version = block.version(77, digest("new"))
    assert version[-1] == changed.root != block.root and len(version) == manifest.LEVELS + 1
    assert block.version(77, leaves[77])[-1] == block.root
    assert block.root == levels_of(leaves)[-1][0]
    short = manifest.Block(leaves[:3], whole=False)
    assert short.root == digest(digest(digest("".join(leaves[:3]))))
    assert manifest.Block(leaves[:1], whole=True).root == leaves[0]
