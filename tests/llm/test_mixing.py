import hashlib
import random
import re

import pytest

from factloom.llm import mixing


def brute_force(rows):
    """{(doc_id, text): (size, source_size, target, copies)} by sorting and walking."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    place = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}\n{t or ''}".encode()).hexdigest()[:15], 16)
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s))
    total = {s: sum(size(t) for _, t, own in rows if own == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, rest, left = {}, list(sources), 1.5 * sum(total.values())
    while rest:  # those above their limit get it, the others share again
        over = [s for s in rest if left * weight[s] / sum(weight[r] for r in rest) > 2 * total[s]]
        if not over:
            target.update({s: left * weight[s] / sum(weight[r] for r in rest) for s in rest})
            break
        for s in over:
            target[s] = 2.0 * total[s]
        left -= sum(target[s] for s in over)
        rest = [s for s in rest if s not in over]
    out = {}
    for s in sources:
        own = sorted((place(i, t), i, t) for i, t, o in rows if o == s) if all(i is not None for i, *_ in rows) else sorted(
            ((place(i, t), i, t) for i, t, o in rows if o == s), key=lambda x: x[0])
        times = int(target[s] // total[s]) if total[s] else 0
        budget, chosen = int(target[s] - times * total[s]), set()
        for n in range(mixing.PASSES):
            spent, taken, most = 0, set(), budget
            for p in sorted({p for p, *_ in own}):
                tied = [(i, t) for q, i, t in own if q == p and (i, t) not in chosen and (n == 0 or 0 < size(t) <= most)]
                if spent + sum(size(t) for _, t in tied) > budget:
                    break
                spent += sum(size(t) for _, t in tied)
                taken.update(tied)
            chosen |= taken
            budget -= spent
        last = [(abs(size(t) - budget), p, i, t) for p, i, t in own if (i, t) not in chosen and 0 < size(t) < 2 * budget]
        if last:
            chosen.add(min(last, key=lambda x: x[:2])[2:])
        for _, i, t in own:
            out[i, t, s] = (size(t), total[s], target[s], times + ((i, t) in chosen and times < 2))
    return out


def corpus(seed, sources):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * (1 + rng.randrange(3)) for _ in range(rng.choice((0, 1, 5, 30, 200)))), rng.choice(sources)) for i in range(300)]
    return rows + [rows[0], (None, "no id", sources[0]), (None, "no id", sources[0]), (5000, None, sources[-1])]


@pytest.mark.parametrize(("seed", "sources"), [(1, ["a"] * 6 + ["b", "é", None]), (2, ["x", "y"]), (3, ["only"]), (4, [f"s{i}" for i in range(40)])])
def test_against_brute_force(docs, seed, sources):
    rows = corpus(seed, sources)
    table = docs([(i, t, "en", s) for i, t, s in rows])
    want = brute_force(rows)
    kept = {(r.doc_id, r.text, r.source): r.copies for r in mixing.mixed(table).collect()}
    assert kept == {k: v[3] for k, v in want.items() if v[3]}
    got = sorted((r.doc_id or -1, r.size, r.source_size, round(r.target, 6), r.copies, r.taken) for r in mixing.mix(table).collect())
    assert got == sorted((i or -1, *want[i, t, s][:2], round(want[i, t, s][2], 6), want[i, t, s][3], want[i, t, s][3] * want[i, t, s][0]) for i, t, s in rows)
    for source in set(sources):
        own = [(i, t, s) for i, t, s in rows if s == source]
        target = want[own[0]][2]
        assert abs(target - sum(want[k][0] * want[k][3] for k in own)) <= 101


def test_defined_results(docs):
    table = docs([(1, None), (2, ""), (3, "  ")])
    assert {(r.size, r.target, r.taken) for r in mixing.mix(table).collect()} == {(0, 0.0, 0)}
    assert mixing.mix(table.limit(0)).collect() == [] and mixing.mixed(table.limit(0)).collect() == []
    one = {(r.size, r.target, r.taken) for r in mixing.mix(docs([(1, "a b c d")])).collect()}
    assert one == {(4, 6.0, 4)}
    assert mixing.mixed(table).columns == [*table.columns, "copies"]
