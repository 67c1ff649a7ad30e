import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import activities, graph

BY = ["p"]


def pick_first_ready(names, deps):
    pending, done, out = list(names), set(), []
    while True:
        ready = next((n for n in pending if all(d not in names or d in done for d in deps.get(n, ()))), None)
        if ready is None:
            return out + pending
        pending.remove(ready)
        done.add(ready)
        out.append(ready)


@pytest.mark.parametrize("limit", [0, 14, 50_000])
def test_order_equals_picking_the_first_ready_activity(rows, limit):
    rng, books = random.Random(3), {}
    for p in range(80):
        names = [f"a{i}" for i in range(rng.randint(1, 9))]
        rng.shuffle(names)
        rank = {n: i for i, n in enumerate(rng.sample(names, len(names)))}
        pairs = [(x, y) for x, y in itertools.permutations(names, 2) if rng.random() < 0.25 and (rank[y] < rank[x] or rng.random() < 0.04)]
        pairs += [(rng.choice(names), "missing")] + ([(names[0], names[0])] if rng.random() < 0.1 else [])
        books[p] = (names, pairs)
    books[99] = (["A", "B", "C", "D"], [("B", "C")])
    act = rows("p int, idx int, name string", [(p, i, n) for p, (names, _) in books.items() for i, n in enumerate(names)])
    deps = rows("p int, name string, depends_on string", [(p, a, b) for p, (_, pairs) in books.items() for a, b in pairs])
    found = activities.order_activities(act, deps, BY, limit).collect()
    for p, (names, pairs) in books.items():
        waits = {}
        for a, b in pairs:
            waits.setdefault(a, []).append(b)
        mine = [r["name"] for r in sorted((r for r in found if r["p"] == p), key=lambda r: r["position"])]
        assert mine == pick_first_ready(names, waits), (p, names, pairs)
    assert [r["name"] for r in sorted((r for r in found if r["p"] == 99), key=lambda r: r["position"])] == ["A", "C", "B", "D"]


def test_a_long_chain_listed_backwards(rows):
    n = 10_000
    act = rows("p int, idx int, name string", [(1, n - i, f"a{i}") for i in range(n)])
    deps = rows("p int, name string, depends_on string", [(1, f"a{i}", f"a{i - 1}") for i in range(1, n)])
    found = {r["name"]: r["position"] for r in activities.order_activities(act, deps, BY).collect()}
    assert found == {f"a{i}": i + 1 for i in range(n)}
    waves = activities.activity_waves(act.withColumn("type", F.lit("Wait")), deps, BY)
    assert waves.filter(F.concat(F.lit("a"), (F.col("wave") - 1).cast("string")) == F.col("name")).count() == n


@pytest.mark.parametrize("limit", [0, 6, 50_000])
def test_levels_in_one_pass_equal_levels_in_rounds(rows, got, limit):
    rng = random.Random(6)
    edges = [(p, f"n{i}", f"n{j}") for p in range(15) for i, j in itertools.permutations(range(6), 2) if rng.random() < 0.12]
    table = rows("p int, src string, dst string", edges)
    levels, plain = graph._levels(table, BY, limit), graph._peeled(table, BY)
    behind = set(got(plain.blocked, "p", "dst"))
    assert [r for r in got(levels.depth, "p", "id", "depth") if r[:2] not in behind] == [r for r in got(plain.depth, "p", "id", "depth") if r[:2] not in behind]
    assert got(levels.blocked, "p", "src", "dst") == got(plain.blocked, "p", "src", "dst")


def test_depth_on_random_acyclic_graphs(rows):
    rng = random.Random(5)
    edges = [(p, f"n{i}", f"n{j}") for p in range(20) for i, j in itertools.combinations(range(8), 2) if rng.random() < 0.3]
    nodes = [(p, f"n{i}") for p in range(20) for i in range(8)]
    found = graph.longest_path_depth(rows("p int, id string", nodes), rows("p int, src string, dst string", edges), BY).collect()
    want = {n: 0 for n in nodes}
    for p, i, j in sorted(edges, key=lambda e: e[2]):
        want[(p, j)] = max(want[(p, j)], want[(p, i)] + 1)
    assert {(r["p"], r["id"]): r["depth"] for r in found} == want


def test_a_cycle_loses_its_back_edge_only(rows):
    edges = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d"), (1, "x", "y"), (1, "y", "z"), (1, "q", "q"), (1, "out", "a")]
    nodes = [(1, n) for n in "abcdxyzq"]
    found = graph.longest_path_depth(rows("p int, id string", nodes), rows("p int, src string, dst string", edges), BY).collect()
    assert {r["id"]: r["depth"] for r in found} == {"a": 1, "b": 2, "c": 3, "d": 4, "x": 0, "y": 1, "z": 2, "q": 0}


ACT = "workspace_id string, pipeline_id string, seq int, name string, type string, child_workspace_id string, child_pipeline_id string"
DEP = "workspace_id string, pipeline_id string, name string, depends_on string"


def splice(pid, act, deps, seen=frozenset(), depth=0, prefix="", limit=5):
    """(name, waits for) of a pipeline with its children in place."""
    level = [(prefix + a[3], {prefix + d[3] for d in deps if d[1] == pid and d[2] == a[3]}, a[6]) for a in act if a[1] == pid]
    kids, ends = {}, {}
    for name, _, child in level:
        kids[name], ends[name] = [], {name}
        if child and depth < limit and child.lower() not in seen:
            below = splice(child.lower(), act, deps, seen | {child.lower()}, depth + 1, f"{name} / ", limit)
            below = [(n, w or {name}) for n, w in below]
            if below:
                waited = set().union(*[w for _, w in below])
                kids[name] = below
                ends[name] = {n for n, _ in below if n not in waited} or {name}
    out = []
    for name, waits, _ in level:
        out.append((name, set().union(*[ends.get(w, {w}) for w in waits])))
        out += kids[name]
    return out


def test_nested_pipelines_are_spliced_in(rows):
    act = [
        ("w", "top", 0, "start", "Wait", None, None), ("w", "top", 1, "call mid", "ExecutePipeline", None, "MID"), ("w", "top", 2, "end", "Wait", None, None),
        ("w", "top", 3, "lost", "ExecutePipeline", None, "nowhere"),
        ("w", "mid", 0, "m1", "Copy", None, None), ("w", "mid", 1, "call low", "ExecutePipeline", "W", "low"), ("w", "mid", 2, "m3", "Copy", None, None),
        ("w", "low", 0, "l1", "Copy", None, None), ("w", "low", 1, "l2", "Copy", None, None),
        ("w", "self", 0, "again", "ExecutePipeline", None, "self"), ("w", "self", 1, "after", "Wait", None, None),
        ("w", "ring", 0, "r1", "Copy", None, None), ("w", "ring", 1, "r2", "Copy", None, None),
        ("w", "rings", 0, "go", "ExecutePipeline", None, "ring"), ("w", "rings", 1, "then", "Wait", None, None),
    ]
    deps = [("w", "top", "call mid", "start"), ("w", "top", "end", "call mid"), ("w", "top", "end", "ghost"), ("w", "mid", "call low", "m1"), ("w", "mid", "m3", "m1"),
            ("w", "low", "l2", "l1"), ("w", "self", "after", "again"), ("w", "ring", "r1", "r2"), ("w", "ring", "r2", "r1"), ("w", "rings", "then", "go")]
    flat, links = activities.expand_activities(rows(ACT, act), rows(DEP, deps))
    flat, links = flat.collect(), links.collect()
    for pid in ("top", "mid", "low", "self", "ring", "rings"):
        want = splice(pid, act, deps)
        mine = [r["name"] for r in sorted((r for r in flat if r["pipeline_id"] == pid), key=lambda r: r["path"])]
        assert mine == [n for n, _ in want], pid
        waits = {(r["name"], r["depends_on"]) for r in links if r["pipeline_id"] == pid}
        assert waits == {(n, w) for n, ws in want for w in ws}, pid


def test_depth_limit_stops_a_long_chain(rows):
    act = [("w", f"p{i}", 0, "next", "ExecutePipeline", None, f"p{i+1}") for i in range(9)] + [("w", "p9", 0, "leaf", "Copy", None, None)]
    flat, _ = activities.expand_activities(rows(ACT, act), rows(DEP, []))
    names = [r["name"] for r in flat.filter("pipeline_id = 'p0'").collect()]
    assert sorted(n.count(" / ") for n in names) == [0, 1, 2, 3, 4, 5]


def test_only_long_column_runs_are_cut(rows, got):
    data = [("card", "", i, f"c{i}") for i in range(10)] + [("card", "t", i, f"d{i}") for i in range(5)]
    cut = graph.truncate_rows(rows("node string, group string, pos int, label string", data), ["node"])
    labels = [r["label"] for r in cut.filter("group = ''").orderBy("place").collect()]
    assert labels == [f"c{i}" for i in range(8)] + ["+2 more"]
    assert cut.filter("group = 't'").count() == 5


def test_steps_take_the_stage_they_write(rows, got):
    access = rows("run_id int, seq int, mode string, ref string", [
        (1, 1, "read", "w/bronze/a"), (1, 2, "write", "w/other/b"), (1, 3, "write", "w/silver/c"), (1, 4, "write", "w/gold/a"), (2, 1, "read", "w/gold/x"), (3, 1, "write", "w/none/y")])
    staged = graph.stage_of(access, ["run_id"])
    assert got(staged.filter("kind = 'step'"), "run_id", "rank") == [(1, 4), (2, 5), (3, -1)]
    owners = graph.owner_of(access.filter("run_id = 1"), rows("run_id int, workspace string", [(1, "")]), ["run_id"])
    assert got(owners.filter("kind = 'step'"), "owner") == [("lh:other",)]
    placed = graph.medallion_bands(staged.filter("run_id = 1").unionByName(rows("run_id int, kind string, id string, rank int, at int", [(1, "table", "a first", 4, 1)])), ["run_id"])
    assert got(placed.filter("stage = 'Silver'"), "position", "id") == [(1, "step"), (2, "a first"), (3, "w/silver/c")]


def test_type_labels(rows, got):
    df = rows("t string", [("TridentNotebook",), ("Odd",)])
    assert got(df.select(activities.activity_type_label(F.col("t")))) == [("Notebook",), ("Odd",)]
