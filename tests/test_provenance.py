import random

from factloom.operators import provenance as prov

FRAME = "notebook int, frame string, pos int, col_name string, src_ref string, src_column string, transform string"
OP = "notebook int, seq int, out_frame string, verb string, left_frame string, right_frame string"
ARG = "notebook int, seq int, pos int, out_name string, input_cols array<string>, transform string, role string"


def by_hand(ops, args, base):
    """What each frame must hold: {frame: [(column, sources, transform)]}, read one operation at a time."""
    frames = {}
    for _, frame, pos, name, ref, column, transform in sorted(base, key=lambda r: (r[1], r[2])):
        frames.setdefault(frame, {}).setdefault(name, [set(), transform])[0].add((ref, column))
    for _, seq, out, verb, left_name, right_name in sorted(ops, key=lambda o: o[1]):
        mine = sorted(a[2:] for a in args if a[1] == seq)
        left, right = frames.get(left_name), frames.get(right_name)
        if left is None or (right_name and right is None):
            continue
        result = {n: [set(s), t] for n, (s, t) in left.items()}
        if any(a[4] == "star" or (a[4] == "key" and a[1] is None) for a in mine):
            continue
        if verb in ("select", "groupBy", "withColumns"):
            if verb != "withColumns":
                result = {}
            for _, name, inputs, transform, role in mine:
                strict = role in ("expr", "dict")
                if name is None or (strict and not any(i in left for i in inputs)):
                    continue
                sources = set().union(*[left[i][0] for i in inputs or [] if i in left])
                new = [sources, None if strict or role == "key" else transform]
                if name in result:
                    result[name][:] = new
                else:
                    result[name] = new
        elif verb == "drop":
            result = {n: v for n, v in result.items() if n not in {a[1] for a in mine}}
        elif verb == "withColumnRenamed":
            (_, new, (old,), _, _), = mine
            if old not in left:
                continue
            result = {new if n == old else n: v for n, v in result.items() if n == old or n != new}
        elif verb in ("join", "unionByName"):
            for n, (s, _) in right.items():
                if n in result:
                    result[n][0] |= s
                elif verb == "join":
                    result[n] = [set(s), None]
        elif verb == "union":
            if len(left) != len(right):
                continue
            for n, (s, _) in zip(result, right.values()):
                result[n][0] |= s
        elif verb == "toDF":
            if len(mine) != len(left):
                continue
            result = {a[1]: v for a, v in zip(mine, result.values())}
        elif verb != "filter":
            continue
        if result:
            frames[out] = result
    return frames


def as_frames(found):
    frames = {}
    for r in sorted(found, key=lambda r: (r["frame"], r["pos"])):
        entry = frames.setdefault(r["frame"], {}).setdefault(r["col_name"], [set(), r["transform"]])
        if r["src_column"] is not None:
            entry[0].add((r["src_ref"], r["src_column"]))
    return frames


def random_notebook(notebook, rng):
    base, ops, args = [], [], []
    for frame in ("b0", "b1"):
        for pos, name in enumerate(rng.sample(["a", "b", "c", "d"], rng.randint(1, 4)), 1):
            for k in range(rng.randint(1, 2)):
                base.append((notebook, frame, pos, name, f"t{frame}{k}", name, None if pos % 2 else f"f({name})"))
    known = ["b0", "b1"]
    for seq in range(1, 13):
        verb = rng.choice(["filter", "select", "groupBy", "withColumns", "drop", "withColumnRenamed", "join", "union", "unionByName", "toDF", "mystery"])
        binary = verb in ("join", "union", "unionByName")
        ops.append((notebook, seq, f"f{seq}", verb, rng.choice(known[-4:]), rng.choice(known) if binary else None))
        names = ["a", "b", "c", "d", "x"]
        if verb in ("select", "withColumns", "groupBy"):
            for pos in range(1, rng.randint(2, 4)):
                role = rng.choice({"select": ["col", "col", "expr", "star"], "groupBy": ["col", "col", "dict", "key"], "withColumns": ["col"]}[verb])
                inputs = rng.sample(names, 1 if role in ("expr", "dict") else rng.randint(0, 2))
                args.append((notebook, seq, pos, rng.choice(names + [None] * (role == "col")), inputs, f"g{seq}", role))
        elif verb == "drop":
            args.append((notebook, seq, 1, rng.choice(names), None, None, "col"))
        elif verb == "withColumnRenamed":
            args.append((notebook, seq, 1, rng.choice(names), [rng.choice(names)], None, "col"))
        elif verb == "toDF":
            args += [(notebook, seq, p, n, None, None, "col") for p, n in enumerate(rng.sample(names, rng.randint(1, 4)), 1)]
        known.append(f"f{seq}")
    return base, ops, args


def test_whole_op_logs_against_reading_them_by_hand(rows):
    rng, books = random.Random(11), {}
    for notebook in range(60):
        books[notebook] = random_notebook(notebook, rng)
    base, ops, args = ([row for book in books.values() for row in book[i]] for i in range(3))
    found = prov.resolve_frames(rows(OP, ops), rows(ARG, args), rows(FRAME, base)).collect()
    for notebook, (b, o, a) in books.items():
        want = by_hand(o, a, b)
        mine = as_frames([r for r in found if r["notebook"] == notebook])
        assert {f: list(c.items()) for f, c in mine.items()} == {f: list(c.items()) for f, c in want.items()}, notebook


def test_thousands_of_arguments_of_one_column(rows):
    n = 5_000
    base = [(1, "b", 1, "a", "t", "a", None), (1, "b", 2, "c", "t", "c", None)]
    args = [(1, 1, i + 1, f"x{i}", ["a"], f"f{i}(a)", "col") for i in range(n)]
    found = prov.apply_ops(rows(OP, [(1, 1, "o", "select", "b", None)]), rows(ARG, args), rows(FRAME, base)).collect()
    assert {(r["pos"], r["col_name"], r["src_column"], r["transform"]) for r in found} == {(i + 1, f"x{i}", "a", f"f{i}(a)") for i in range(n)}
    assert len(found) == n


def test_logs_longer_than_a_stretch(rows):
    rng, books = random.Random(12), {}
    for notebook in range(12):
        books[notebook] = random_notebook(notebook, rng)
    turns = ["withColumns", "filter", "withColumnRenamed", "join", "union", "drop"]
    base, ops, args = [(99, "b0", 1, "a", "t0", "a", None), (99, "b0", 2, "k", "t0", "k", "f(k)")], [], []
    for seq in range(1, 121):  # one chain, whose binary steps meet the frame two steps before
        verb = turns[seq % len(turns)]
        ops.append((99, seq, f"f{seq}", verb, f"f{seq - 1}" if seq > 1 else "b0", f"f{seq - 2}" if verb in ("join", "union") and seq > 2 else "b0" if verb in ("join", "union") else None))
        if verb == "withColumns":
            args.append((99, seq, 1, "x", ["a", "x"], f"g{seq}", "col"))
        elif verb == "withColumnRenamed":
            args.append((99, seq, 1, "y", ["x"], None, "col"))
        elif verb == "drop":
            args.append((99, seq, 1, "y", None, None, "col"))
    books[99] = (base, ops, args)
    base, ops, args = ([row for book in books.values() for row in book[i]] for i in range(3))
    found = prov.resolve_frames(rows(OP, ops), rows(ARG, args), rows(FRAME, base), stretch=5).collect()
    for notebook, (b, o, a) in books.items():
        want = by_hand(o, a, b)
        mine = as_frames([r for r in found if r["notebook"] == notebook])
        assert mine == want, notebook
        if notebook == 99:  # a rename onto an existing column, which the random logs have, takes the first of both places
            assert {f: list(c) for f, c in mine.items()} == {f: list(c) for f, c in want.items()}


def test_a_view_on_views_ends_at_tables_and_a_cycle_ends_nowhere(rows, got):
    view = "notebook int, view_name string, col_name string, src_kind string, src_name string, src_column string, transform string"
    data = [(1, "v0", "c", "table", "t", "c", "f(c)")] + [(1, f"v{i}", "c", "view", f"v{i-1}", "c", None) for i in range(1, 9)]
    data += [(1, "v9", "c", "view", "v8", "c", "g(c)"), (2, "a", "c", "view", "b", "c", None), (2, "b", "c", "view", "a", "c", None), (2, "d", "c", "view", "nope", "c", None)]
    flat = prov.flatten_views(rows(view, data))
    found = got(flat)
    assert len(found) == 10 and {r[0] for r in found} == {1}
    assert (1, "v8", "c", "t", "c", "f(c)") in found and (1, "v9", "c", "t", "c", "g(c)") in found


def test_a_known_view_shadows_a_table_and_an_unknown_one_hides_it(rows, got):
    reads = rows("notebook int, out_frame string, raw string, ref string", [(1, "f", "Orders", "w/l/orders"), (1, "g", "hidden", "w/l/hidden"), (1, "h", "t", "w/l/t")])
    views = rows("notebook int, view_name string, pos int, col_name string, src_ref string, src_column string, transform string",
                 [(1, "orders", 1, "v", "w/l/base", "b", None), (1, "hidden", None, None, None, None, None)])
    schema = rows("ref string, pos int, name string", [(r, 1, "id") for r in ("w/l/orders", "w/l/hidden", "w/l/t")])
    assert got(prov.source_frames(reads, views, schema), "frame", "col_name", "src_ref") == [("f", "v", "w/l/base"), ("h", "id", "w/l/t")]


FLOW = "run_id int, seq int, to_table string, to_column string, from_table string, from_column string, transform string"


def test_dedupe_keeps_the_first_and_is_idempotent(rows, got):
    flow = rows(FLOW, [(1, 2, "t", "a", None, "x", "late"), (1, 1, "t", "a", None, "x", "first"), (1, 3, "t", "a", "s", "x", None)])
    once = prov.dedupe_flows(flow, ["run_id"], ["seq"])
    assert got(once, "seq", "transform") == [(1, "first"), (3, None)]
    assert got(prov.dedupe_flows(once, ["run_id"], ["seq"])) == got(once)


def test_an_unowned_column_needs_exactly_one_reader(rows, got):
    flow = rows(FLOW, [(1, 1, "t", "a", None, "x", None), (1, 2, "t", "b", None, "y", None), (1, 3, "t", "c", None, "z", None), (1, 4, "t", "d", "s", "d", None)])
    schema = rows("run_id int, ref string, name string", [(1, "s", "x"), (1, "s", "y"), (1, "r", "y"), (1, "t", "z")])
    access = rows("run_id int, ref string, mode string", [(1, "s", "read"), (1, "r", "read"), (1, "t", "write")])
    assert got(prov.resolve_unowned(flow, schema, access, ["run_id"]), "seq", "from_table") == [(1, "s"), (4, "s")]


def test_carried_schemas_fill_gaps_only(rows, got):
    steps = rows("run_id int, ref string, step_seq int", [(1, "t", 1), (1, "t", 2), (1, "t", 3), (1, "t", 4), (1, "u", 2)])
    sets = rows("run_id int, ref string, step_seq int, columns string", [(1, "t", 1, "a"), (1, "t", 3, "a,b")])
    assert got(prov.carry_schemas(steps, sets, ["run_id"]), "ref", "step_seq", "columns", "origin") == [
        ("t", 1, "a", "fetched"), ("t", 2, "a", "carried"), ("t", 3, "a,b", "fetched"), ("t", 4, "a,b", "carried"), ("u", 2, None, "unknown")]
