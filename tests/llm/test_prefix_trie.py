import hashlib
import random
import zlib

import pytest

from factloom.llm import prefix_trie
from factloom.llm.prefix_trie import RadixTree

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_key(turn):
    _, role, text = turn
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role, text))
    for turns in own.values():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, turn_key(t)))
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - (conv % 100 if conv >= 0 else -(-conv % 100))
        out[conv] = [(r or "", t or "") for _, r, t in own.get(base, [])[:h] + turns[h:]]
    return out


def brute_force(convs):
    """Every prefix of every conversation, by dictionaries."""
    members, ends = {}, {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
        ends.setdefault(tuple(turns), []).append(conv)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[:len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaves = sum(not any(m[:len(n)] == n and len(m) == len(n) + 1 for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * (len(n[-1][1]) if n else 0) for n in below)
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), leaves, saved,
                    hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n, turns=3, length=6):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-50, 3 * n), n):
        for turn in range(rng.randrange(length + 1)):
            rows.append((conv, turn, rng.choice(("user", "assistant")), rng.choice(("hé", "b" * 5, "", "long " * 9)[:turns])))
    return rows


@pytest.fixture
def conversations(spark):
    return lambda rows, parts=3: spark.createDataFrame(
        [(*r, None, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, pos bigint, node string").repartition(parts)


def nodes(df, chunk=prefix_trie.CHUNK):
    return sorted(tuple(r) for r in prefix_trie.prefix_trie(df, chunk).select(COLUMNS).collect())


@pytest.mark.parametrize(("seed", "n", "chunk"), [(1, 60, 4096), (2, 200, 5), (3, 120, 4)])
def test_against_brute_force(conversations, seed, n, chunk):
    rows = corpus(seed, n)
    assert nodes(conversations(rows), chunk) == brute_force(rebuilt(rows))


def test_copies_of_one_conversation_over_many_chunks(conversations):
    same = [(0, "user", "hello"), (1, "assistant", "hi there")] * 6
    rows = [(conv, i, role, text) for conv in range(1000, 1150) for i, (_, role, text) in enumerate(same)]
    rows += [(conv, i, "user", f"own {conv}") for conv in range(5000, 5040) for i in range(8)]
    assert nodes(conversations(rows), 7) == brute_force(rebuilt(rows))


def test_nulls_ties_repeats_and_shared_beginnings(conversations):
    rows = [(7, None, None, None), (7, None, "user", "a"), (7, 1, "user", None), (7, 1, "user", None), (7, 1, "", ""), (7, 2, "tool", "z"), (7, 3, "u", "y"),
            (None, 1, "user", "lost"), (100, 0, "user", "only"), (107, 0, "a", "b"), (-1, 0, "x", "y"), (-100, 0, "user", "neg"), (-100, 1, "user", "neg2")]
    rows += [(200 + i, t, "user", "deep") for i in range(4) for t in range(40 + i)]
    assert nodes(conversations(rows), 4) == brute_force(rebuilt(rows))


def test_empty_table(conversations, spark):
    assert nodes(conversations([(None, 1, "user", "x")])) == []
    assert nodes(conversations([(1, 1, "user", "x")]).limit(0)) == []


def test_very_long_text_and_conversation(conversations):
    rows = [(3, i, "user", str(i % 5)) for i in range(3000)] + [(3 + 1, 0, "user", "w" * 1_000_000)]
    got = nodes(conversations(rows))
    assert len(got) == 1 + sum(len(t) for t in rebuilt(rows).values()) and got[0][3] == 2


def test_radix_tree_grows_and_keeps_every_key():
    rng = random.Random(4)
    keys = [bytes(rng.randrange(256) for _ in range(2)) * 8 for _ in range(3000)] + [b"", b"\x00" * 16, b"\x00" * 32, b"\x00" * 31 + b"\x01"]
    tree, kinds = RadixTree(), set()
    for i, key in enumerate(keys):
        tree.insert(key, (key, i))
    found = []
    for node, above, through, first, last in tree.upwards():
        kinds.add((type(node.branches).__name__, node.branches.room))
        found += [k for k, _ in node.rows]
        assert through == above + len(node.path)
        bytes_of = [c.path for c in node.branches.ordered()]
        assert len(bytes_of) <= node.branches.room
    assert sorted(found) == sorted(keys)
    assert {("Few", 4), ("Full", 256)} <= kinds
    grown = prefix_trie.Few(4)
    seen = []
    for byte in rng.sample(range(256), 256):
        grown = grown.put(byte, byte)
        seen.append(grown.room)
        assert grown.find(byte) == byte and grown.ordered() == sorted(grown.ordered())
    assert seen == [4] * 4 + [16] * 12 + [48] * 32 + [256] * 208
