from factloom.operators import model, reports

SCHEMA = "run_id int, ref string, name string"
FLOW = "run_id int, seq int, to_table string, to_column string, from_table string, from_column string, transform string"
ACCESS = "run_id int, ref string, mode string"


def test_column_flows_become_transitions_and_leave_no_table_edge(rows, got):
    schema = rows(SCHEMA, [(1, "w/l/src", "id"), (1, "w/l/src", "amount"), (1, "w/l/dst", "id")])
    flow = rows(FLOW, [(1, 1, "w/l/dst", "id", "w/l/src", "id", None), (1, 2, "w/l/dst", "total", "w/l/src", "amount", "sum(amount)")])
    access = rows(ACCESS, [(1, "w/l/src", "read"), (1, "w/l/dst", "write")])
    assert got(model.column_transitions(flow), "source", "target", "transform") == [
        ("col:w/l/src:amount", "col:w/l/dst:total", "sum(amount)"), ("col:w/l/src:id", "col:w/l/dst:id", "")]
    assert got(model.table_transitions(flow, access)) == []
    children = got(model.entity_children(schema, flow), "parent", "child")
    assert ("table:w/l/dst", "col:w/l/dst:total") in children and len(children) == 4
    entity = model.entities(schema, flow, access)
    assert got(model.roots(entity), "id") == [("table:w/l/dst",), ("table:w/l/src",)]
    ids = {r[0] for r in got(entity, "id")}
    for row in model.column_transitions(flow).collect():
        assert row["source"] in ids and row["target"] in ids


def test_an_unresolved_write_falls_back_to_table_edges(rows, got):
    flow = rows(FLOW, [])
    access = rows(ACCESS, [(1, "a", "read"), (1, "b", "read"), (1, "out", "write"), (2, "c", "read")])
    assert got(model.table_transitions(flow, access), "source", "target", "resolution") == [
        ("table:a", "table:out", "table-level"), ("table:b", "table:out", "table-level")]


def test_an_unowned_flow_still_makes_its_target(rows, got):
    flow = rows(FLOW, [(1, 1, "t", "c", None, "x", None)])
    assert got(model.entities(rows(SCHEMA, []), flow, rows(ACCESS, [])), "id", "kind") == [("col:t:c", "column"), ("table:t", "table")]
    assert got(model.column_transitions(flow)) == []


def test_a_repeated_pair_keeps_the_last_transform(rows, got):
    flow = rows(FLOW, [(1, 1, "t", "c", "s", "c", "f(c)"), (1, 2, "t", "c", "s", "c", None), (1, 3, "t", "d", "s", "c", "g(c)")])
    assert got(model.column_transitions(flow), "target", "transform") == [("col:t:c", ""), ("col:t:d", "g(c)")]
