import pytest

from factloom.operators import provenance, reports
from factloom.plans import fixtures, registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark, monkeypatch):
    """Plan of a query over facts in several buckets, with joins as they are on large tables where ``large``."""
    monkeypatch.setattr(fixtures, "ROWS", 1000)
    monkeypatch.setattr(fixtures, "_TASKS", {})
    monkeypatch.setattr(fixtures, "_WRITTEN", {})
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def of(name, large=True):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1" if large else threshold)
        return registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()

    yield of
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def moved(plan):
    """Shuffles by run, or by the order that a run is made from."""
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(run" in line]


@pytest.mark.parametrize("name", ["h01_table_coverage", "h04_lineage_gaps", "i1_entities", "e25_schema_resolution"])
def test_facts_of_runs_are_not_shuffled_by_run(plan, name):
    assert not moved(plan(name))


def test_answers_keep_accesses_in_their_tasks(plan):
    assert not moved(plan("h14_answers", large=False))


@pytest.mark.parametrize("name", ["fx_access", "fx_table_schema", "fx_touch"])
def test_facts_are_made_of_placed_rows_without_another_shuffle(spark, monkeypatch, name):
    for table, value in (("ROWS", 1000), ("_TASKS", {}), ("_WRITTEN", {})):
        monkeypatch.setattr(fixtures, table, value)
    assert not moved(fixtures.Facts(spark, DATA)._derived(name)._jdf.queryExecution().executedPlan().toString())


def test_flows_count_only_where_their_run_wrote(rows, got):
    flow = rows("run_id int, seq int, to_table string, from_table string", [(1, 1, "t", "a"), (1, 2, "u", "a"), (2, 1, "t", "b"), (1, 3, None, "a"), (1, 1, "t", "a")])
    access = rows("run_id int, ref string, mode string", [(1, "t", "write"), (1, "u", "read"), (2, "u", "write"), (1, None, "write"), (1, "t", "write")])
    assert got(reports._to_written(flow, access)) == [(1, 1, "t", "a"), (1, 1, "t", "a")]


def test_null_refs_meet_no_schema(rows, got):
    key = "run_id int, ref string"
    state = provenance.schema_resolution(
        rows(key, [(1, None), (1, "t"), (1, "u"), (1, "t")]), rows(key, [(1, None), (1, "t")]), rows(key, [(1, None), (1, "u"), (1, "t"), (2, "t")]),
        rows(f"{key}, failure string", [(1, None, "x"), (1, "u", "z"), (1, "u", "y"), (3, "t", "x")]), ["run_id"])
    assert got(state) == [(1, "t", "resolved", None), (1, "u", "carried", "y"), (1, None, "unresolved", None)]


def test_report_lines_are_made_where_the_run_lies(plan):
    made = plan("h21_run_markdown")
    assert "Exchange" not in made and "Join" not in made
