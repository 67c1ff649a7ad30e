"""What may not grow on the driver or in one task when the tables grow."""

import ast

import pytest
from pyspark.sql import functions as F

from factloom.functions import refs
from factloom.operators import graph, provenance, scan
from factloom.plans import fixtures, registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.fixture
def no_broadcast(spark):
    """A broadcast of more than one byte ends the query."""
    before = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    yield
    spark.conf.set("spark.sql.maxBroadcastTableSize", before)


def run(spark, name):
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["f06_activity_after", "g01_longest_path_depth", "f06_activity_waves", "f05_order_activities", "f05_order_shuffled"])
def test_activities_are_not_broadcast(spark, no_broadcast, name):
    run(spark, name)


def test_merge_sources_are_not_broadcast(spark, no_broadcast):
    run(spark, "e20_merge_star_flows")


def test_views_are_not_broadcast(rows, no_broadcast):
    views = rows("notebook int, view_name string, col_name string, src_kind string, src_name string, src_column string, transform string",
                 [(n, f"v{k}", "c", "view" if k else "table", f"v{k - 1}" if k else "t", "c", None) for n in range(3) for k in range(4)])
    writes = rows("notebook int, seq bigint, frame string, target string", [(n, 1, "v3", "ws/lh/out") for n in range(3)])
    frames = provenance.flatten_views(views).withColumnRenamed("view_name", "frame")
    assert provenance.write_flows(writes, frames, views).count() == 3


def test_frames_are_not_broadcast(spark, rows, no_broadcast):
    ops = rows("notebook int, seq bigint, out_frame string, verb string, left_frame string, right_frame string",
               [(n, i, f"f{i}", "select" if i % 2 else "join", f"f{i - 1}", None if i % 2 else "f0") for n in range(3) for i in range(1, 5)])
    args = rows("notebook int, seq bigint, pos int, out_name string, input_cols array<string>, transform string, role string",
                [(n, i, 1, "a", ["a"], None, "col") for n in range(3) for i in (1, 3)])
    base = rows("notebook int, frame string, pos bigint, col_name string, src_ref string, src_column string, transform string",
                [(n, "f0", p, c, "t", c, None) for n in range(3) for p, c in ((1, "a"), (2, "b"))])
    assert provenance.resolve_frames(ops, args, base).count() == 3 * (2 + 1 + 2 + 1 + 2)


def test_tasks_follow_the_frames(rows, monkeypatch):
    monkeypatch.setattr(provenance, "ROWS", 10)
    frames = rows("notebook int, frame string, pos bigint, col_name string, src_ref string, src_column string, transform string",
                  [(n, "L", 1, "a", "t", "a", None) for n in range(400)])
    ops = rows("notebook int, seq bigint, out_frame string, verb string, left_frame string, right_frame string", [(n, 1, "O", "filter", "L", None) for n in range(400)])
    args = rows("notebook int, seq bigint, pos int, out_name string, input_cols array<string>, transform string, role string", [])
    made = provenance.apply_ops(ops, args, frames).withColumn("task", F.spark_partition_id())
    assert made.count() == 400
    assert made.select("task").distinct().count() > 20


def plan(df, physical=False):
    run = df._jdf.queryExecution()
    return (run.executedPlan() if physical else run.optimizedPlan()).toString()


CELLS = ("run_id int, cell_index int, source string", [(1, 0, "df.write.saveAsTable('a')"), (1, 1, "spark.table('b')")])


def test_names_are_sent_once_and_definitions_read_once(spark):
    made = plan(QUERIES["f01_copy_access"](spark, SF), physical=True)
    assert "explode(" not in made.replace("posexplode(", "")  # of names, for places that rows which stay where they are do not have
    assert made.count("BroadcastHashJoin") == 4 and made.count("from_json(") == 1 and made.count("get_json_object(_text") == 1


GUIDS = [("AA", None), ("bb", "aa"), (None, " "), ("", "cc"), ("zz", "AA"), ("aa", "Aa")] * 20
NAMES = [("aa", "Sales"), ("BB", "Finance/EU"), ("cc", None), ("dd", "x"), ("dd", "y"), ("", "blank"), (" ", "space"), (None, "none")]


def test_large_name_maps_are_not_broadcast(rows, got, no_broadcast):
    df, names = rows("id int, w string, l string", [(i, *g) for i, g in enumerate(GUIDS)]), rows("guid string, name string", NAMES)
    want = {"AA": "Sales", "aa": "Sales", "Aa": "Sales", "bb": "Finance/EU"}
    found = got(refs.resolve_ids(df, names, ["w", "l"], held=0))
    assert found == sorted([(i, *[want.get(x, x) for x in g]) for i, g in enumerate(GUIDS)], key=repr)


def test_both_ways_to_resolve_ids_give_the_same_rows(rows, got):
    df, names = rows("id int, w string, l string", [(i, *g) for i, g in enumerate([*GUIDS, ("dd", "DD")])]), rows("guid string, name string", NAMES)
    found = got(refs.resolve_ids(df, names, ["w", "l"]))
    assert len(found) == len(GUIDS) + 4 and found == got(refs.resolve_ids(df, names, ["w", "l"], held=0))


def test_small_files_of_many_names_are_counted(spark, tmp_path):
    """A map is small by what it takes in memory, not by its compressed file."""
    spark.range(20_000).selectExpr("lpad(id, 36, '0') AS guid", "concat('n', id) AS name").coalesce(1).write.parquet(str(tmp_path / "names"))
    names, df = spark.read.parquet(str(tmp_path / "names")), spark.range(9).selectExpr("lpad(id, 36, '0') AS w")
    assert "BroadcastHashJoin" in plan(refs.resolve_ids(df, names, ["w"], held=5 << 20), physical=True)
    assert "Broadcast" not in plan(refs.resolve_ids(df, names, ["w"], held=3 << 20), physical=True)


def test_writes_of_a_cell_are_matched_once(rows):
    assert plan(scan.scan_writes(rows(*CELLS))).count("saveAsTable") == 1


def test_accesses_of_a_cell_are_matched_once(rows):
    assert plan(scan.cell_access(rows(*CELLS))).count("saveAsTable") == 1


def test_calls_of_a_cell_are_found_in_the_order_of_a_walk():
    tree = ast.parse("a(b(c), *[d(e) for f in g()])\n@h(1)\ndef i(j=k()):\n    return f'{l(m):{n()}}'\nclass o(p()): q = lambda: r()")
    assert scan._calls(tree) == [node for node in ast.walk(tree) if isinstance(node, ast.Call)]


def test_stages_read_the_accesses_once(rows):
    access = rows("run_id int, mode string, ref string, seq bigint", [(1, "read", "w/bronze/t", 1), (1, "write", "w/gold/t", 2), (1, "write", "w/silver/t", 3)])
    staged = graph.stage_of(access, ["run_id"])
    assert "parquet" in plan(staged) and "RDD" not in plan(staged)
    assert {(r["id"], r["rank"], r["at"]) for r in staged.collect()} == {("step", 5, -1), ("w/bronze/t", 3, 1), ("w/gold/t", 5, 2), ("w/silver/t", 4, 3)}


def test_touches_are_written_once(spark):
    assert "md5" not in plan(fixtures.Facts(spark, SF)("fx_touch"))


def test_flows_are_grouped_in_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "ROWS", 1000)
    facts = fixtures.Facts(spark, SF)
    made = plan(facts.sql(fixtures.SQL["fx_column_flow"]), physical=True)
    assert made.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in made


def test_depth_reads_written_touches(spark, monkeypatch):
    """Nodes and edges of the owners' graph come from one grouping of the touches."""
    given = []
    depth = graph.longest_path_depth
    monkeypatch.setattr(graph, "longest_path_depth", lambda nodes, edges, by: given.append(edges) or depth(nodes, edges, by))
    QUERIES["g12_owner_order"](spark, SF)
    assert "Aggregate" not in plan(given[0])
