import random

from factloom.operators.ordering import number_rows


def test_numbers_are_whole_however_heavy_one_group_is(rows):
    rng = random.Random(2)
    data = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 20)}", rng.randint(0, 10_000), i) for i in range(3_000)]
    numbered = number_rows(rows("k string, v int, id int", data), ["k"], ["v", "id"], "n").collect()
    want = {}
    for k, v, i in sorted(data):
        want[(k, v, i)] = sum(1 for key in want if key[0] == k) + 1
    assert {(r["k"], r["v"], r["id"]): r["n"] for r in numbered} == want
