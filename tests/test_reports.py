import datetime
import random

import pytest

from pyspark.sql import functions as F

from factloom.operators import answers, reports

RUNS = "run_id int, at timestamp, name string, engine string, ok boolean, workspace string"
FLOW = "run_id int, seq int, to_table string, to_column string, from_table string, from_column string, transform string"
SCHEMA = "run_id int, ref string, name string"
ACCESS = "run_id int, ref string, mode string"


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def run(run_id, minute, name="nb", engine="stub"):
    return (run_id, at(minute), name, engine, True, "w")


def test_sources_come_from_the_newest_run_that_wrote_the_column(rows, got):
    runs = rows(RUNS, [run(1, 1), run(2, 2), run(3, 3, "other")])
    flow = rows(FLOW, [
        (1, 1, "t", "a", "old", "x", None), (1, 2, "t", "gone", "old", "y", None),
        (2, 1, "t", "a", "new", "x", None), (2, 2, "t", "a", "new", "x", "again"), (2, 3, "t", "a", None, "z", "f(z)"),
        (3, 1, "u", "a", "t", "a", None)])
    schema = rows(SCHEMA, [(1, "t", "a"), (2, "t", "a"), (2, "t", "bare"), (1, "t", "older")])
    access = rows(ACCESS, [(1, "t", "write"), (2, "t", "write"), (3, "t", "read"), (3, "u", "write")])
    assert got(reports.column_sources(flow, schema, access, runs)) == sorted([
        ("t", "a", "new", "x", None, "nb"), ("t", "a", None, "z", "f(z)", "nb"), ("t", "bare", None, None, None, None),
        ("t", "gone", "old", "y", None, "nb"), ("u", "a", "t", "a", None, "other")], key=repr)


def test_not_checked_is_not_the_same_as_no_consumer(rows, got):
    runs = rows(RUNS, [run(1, 1), run(2, 2), run(3, 3)])
    access = rows(ACCESS, [(1, "t", "write"), (2, "t", "write"), (3, "u", "write"), (2, "v", "write")])
    downstream = rows("run_id int, available boolean, consumer_name string, consumer_kind string",
                      [(1, True, "report", "report"), (2, False, None, None), (3, True, None, None)])
    assert got(reports.downstream_consumers(downstream, access, runs)) == [
        ("t", "report", "report", True), ("u", None, None, True), ("v", None, None, False)]


def test_a_name_in_two_lakehouses_is_ambiguous(rows, got):
    access = rows(ACCESS, [(1, "w/gold/T", "read"), (1, "w/silver/t", "write"), (2, "w/gold/T", "write")])
    questions = rows("table_name string, lakehouse string", [("t", None), ("T", "GOLD"), ("t", ""), ("x", None)])
    assert got(reports.table_match(questions, access)) == sorted([
        ("t", None, "w/gold/T", True, False), ("t", None, "w/silver/t", True, False), ("T", "GOLD", "w/gold/T", False, False),
        ("t", "", "w/gold/T", True, False), ("t", "", "w/silver/t", True, False), ("x", None, None, False, True)], key=repr)


def test_verdicts_merge_the_optimistic_way(rows, got):
    runs = rows(RUNS, [run(1, 1), run(2, 2), run(3, 3)])
    access = rows(ACCESS, [(1, "t", "read"), (2, "t", "write"), (1, "b", "read"), (3, "c", "write"), (1, "r", "read"), (2, "b", "read")])
    flow = rows(FLOW, [(2, 1, "t", "a", "b", "a", None)])
    schema = rows(SCHEMA, [(3, "c", "a"), (1, "r", "a")])
    requests = rows("run_id int, seq int, ref string, state string, failure string", [
        (2, 2, "a", "unresolved", "403 a"), (2, 1, "b", "unresolved", "403 b"), (1, 1, "x", "resolved", None)])
    coverage = rows("run_id int, dataframe_write_cells long, dynamic_sql_cells long, unparsable_cells long", [(1, 0, 0, 0), (2, 0, 0, 0)])
    verdicts = reports.table_coverage(access, flow, schema, requests, coverage, runs)
    found = {r["ref"]: (r["level"], r["reason"]) for r in verdicts.collect()}
    assert found["t"] == ("traced", "")
    assert found["b"] == ("bare", "No columns were resolved for this table.")
    assert found["c"] == ("columns-only", "This run predates coverage reporting, so why is not recorded.")
    assert found["r"] == ("columns-only", "Read but not written here, so this run had no derivation to record.")
    assert [r["ref"] for r in reports.lineage_gaps(verdicts).collect()] == ["b", "c"]
    summary = reports.coverage_summary(verdicts).first()
    assert tuple(summary) == (4, 1, 2, 1)


def diff_of(rows, got, access, flow, schema=(), previous=1):
    pairs = rows("name string, latest int, previous int", [("nb", 2, previous)])
    diff = reports.run_diff(pairs, rows(ACCESS, access), rows(SCHEMA, list(schema)), rows(FLOW, flow), ["name"])
    return got(diff, "ref", "change"), reports.diff_is_clean(pairs, diff, ["name"]).first()


def test_a_table_that_went_away_is_reported_once(rows, got):
    changes, verdict = diff_of(
        rows, got, [(1, "t", "write"), (1, "k", "write"), (2, "k", "write"), (2, "n", "read")],
        [(1, 1, "t", "a", "s", "a", None), (1, 2, "k", "a", "s", "a", None)], [(1, "k", "a"), (2, "k", "b")])
    assert changes == sorted([("t", "removed_table"), ("n", "added_table"), ("k", "lost_lineage"), ("k", "added_column"), ("k", "removed_column")], key=repr)
    assert not verdict["clean"] and verdict["changes"] == 5


def test_a_run_against_itself_is_clean(rows, got):
    same = [(r, ref, mode) for r in (1, 2) for ref, mode in (("t", "write"), ("s", "read"))]
    changes, verdict = diff_of(rows, got, same, [(r, 1, "t", "a", "s", "a", None) for r in (1, 2)])
    assert changes == [] and verdict["clean"] and not verdict["empty"]


def test_without_a_previous_run_there_is_nothing_to_compare(rows, got):
    changes, verdict = diff_of(rows, got, [(2, "t", "write")], [], previous=None)
    assert changes == [] and verdict["empty"]


def kept_by_saving_one_by_one(sizes, max_runs, max_bytes):
    kept = []
    for run_id, size in enumerate(sizes):
        if size > max_bytes:
            continue
        kept = ([(run_id, size)] + kept)[:max_runs]
        while len(kept) > 1 and sum(s for _, s in kept) + len(kept) + 1 > max_bytes:
            kept.pop()
    return sorted(r for r, _ in kept)


@pytest.mark.parametrize("sizes", [
    [100] * 6, [1001], [100, 1001, 200], [300, 300, 300, 300], [999], [500, 497], [500, 498], []])
def test_retention_equals_saving_one_by_one(rows, sizes):
    runs = rows("run_id int, at timestamp, size_bytes long, workspace string", [(i, at(i), s, "w") for i, s in enumerate(sizes)])
    kept = sorted(r["run_id"] for r in reports.retain_runs(runs, ["workspace"], max_bytes=1000).collect())
    assert kept == kept_by_saving_one_by_one(sizes, 5, 1000)


def test_retention_on_random_histories(rows):
    random.seed(7)
    histories = {f"w{i}": [random.choice([10, 200, 400, 999, 1001]) for _ in range(random.randint(1, 12))] for i in range(30)}
    data = [(i, at(i), s, w) for w, sizes in histories.items() for i, s in enumerate(sizes)]
    kept = reports.retain_runs(rows("run_id int, at timestamp, size_bytes long, workspace string", data), ["workspace"], max_bytes=1000).collect()
    for w, sizes in histories.items():
        assert sorted(r["run_id"] for r in kept if r["workspace"] == w) == kept_by_saving_one_by_one(sizes, 5, 1000)


def test_prediction_only_is_no_disagreement_when_the_code_is_newer(rows):
    observed = rows("entry_id int, run_id int, available boolean, state string, submitted_at timestamp, code_changed_at timestamp, submitter string, note string", [
        (1, 1, True, "Success", at(1), at(2), "ann", None), (2, 1, True, "Error", at(5), None, "bob", None), (3, 1, False, None, None, None, None, "no history"),
        (4, 2, False, None, None, None, None, "no history"), (5, 3, True, "Success", at(1), None, "cy", None)])
    comparison = rows("run_id int, mode string, ref string, side string", [
        (1, "read", "a", "agreed"), (1, "write", "a", "predicted_only"), (1, "read", "b", "predicted_only"), (2, "read", "a", "predicted_only"), (3, "read", "z", "observed_only")])
    summary = reports.observed_summary(observed, comparison)
    by_run = {r["run_id"]: r for r in summary.collect()}
    assert (by_run[1]["asked"], by_run[1]["available"], by_run[1]["agreed"], by_run[1]["predicted_only"]) == (3, 2, 1, 1)
    assert (by_run[1]["last_run_by"], by_run[1]["last_run_state"], by_run[1]["code_is_newer"]) == ("bob", "Error", True)
    lines = {r["run_id"]: (r["headline"], r["agrees"]) for r in reports.observed_headline(summary).collect()}
    assert lines[1] == ("1 of 2 predicted tables confirmed by the last real run · the notebook has been edited since that run", True)
    assert lines[2] == ("No readable run history for these notebooks.", False)
    assert lines[3] == ("Compared against the last real run · 1 table the run touched that this analysis did not predict", False)


def test_narrative_ends_with_the_failure(rows, got):
    runs = rows(RUNS, [run(1, 1), run(2, 1)])
    cells = rows("run_id int, cell_index int", [(1, 0), (1, 1)])
    access = rows(ACCESS, [(1, "a", "read"), (1, "b", "write")])
    bare = rows("run_id int, ref string", [(1, "b")])
    failures = rows("run_id int, kind string", [(1, "cell"), (1, "step"), (2, "step")])
    assert got(reports.run_narrative(runs, cells, access, bare, failures)) == [
        (1, "Ran 1 notebook, 2 cells — read 1 table, wrote 1, 1 without column lineage. — 1 cell failed"),
        (2, "Ran 1 notebook — touched no tables. — 1 step failed")]


def test_a_blank_note_deletes(rows, got):
    gaps = rows("ref string", [("a",), ("b",), ("c",)])
    notes = rows("ref string, note string, updated_at timestamp", [("a", "ask", at(1)), ("a", "  ", at(2)), ("b", "old", at(1)), ("b", " new ", at(2))])
    assert got(reports.gap_notes(gaps, notes), "ref", "note") == [("a", None), ("b", "new"), ("c", None)]


def test_answers_from_batches_in_any_order_equal_those_from_all_runs(spark, rows, tmp_path, got):
    rng = random.Random(8)
    tables, columns = ["w/l/T1", "w/l/t2", "w/m/t1", "x"], ["a", "b", "c"]
    runs, access, flow, schema = [], [], [], []
    for run in range(24):
        runs.append((run, at(rng.randrange(12)), f"nb{run % 5}"))
        for ref in rng.sample(tables, 2):
            access.append((run, ref, rng.choice(("write", "write", "read"))))
            schema += [(run, ref, c) for c in rng.sample(columns, rng.randrange(4))]
            for column in rng.sample(columns, rng.randrange(4)):
                flow += [(run, len(flow) + k, ref, column, rng.choice(("s", None)), rng.choice("xy"), rng.choice((None, "f"))) for k in range(2)]
    runs, flow = rows("run_id int, at timestamp, name string", runs), rows(FLOW, flow)
    access, schema = rows("run_id int, ref string, mode string", access), rows("run_id int, ref string, name string", schema)
    downstream = rows("run_id int, available boolean, consumer_name string, consumer_kind string", [
        (r, r % 3 != 0, f"c{r}" if r % 2 else None, "report") for r in range(24)] + [(4, True, "more", "model")])
    observed = rows("entry_id int, run_id int, available boolean, state string, submitted_at timestamp, code_changed_at timestamp, submitter string", [
        (e, e % 24, e % 5 != 0, "Success", at(e), at(2 * e % 50) if e % 2 else None, f"u{e}") for e in range(40)])
    facts = {"access": access, "runs": runs, "flow": flow, "schema": schema, "downstream": downstream, "observed": observed}
    store = answers.AnswerStore(spark, str(tmp_path))
    asked = lambda: [got(a) for a in (store.column_sources(), store.touched_by(), store.downstream_consumers(), store.last_real_run())]
    assert asked() == [[], [], [], []]
    for part in (2, 0, 1, 1):
        own = F.col("run_id") % 3 == part
        store.add(**{name: frame.filter(own) for name, frame in facts.items()})
    want = [got(reports.column_sources(flow, schema, access, runs)), got(reports.touched_by(access, runs)),
            got(reports.downstream_consumers(downstream, access, runs)), got(reports.last_real_run(observed, access, runs))]
    assert asked() == want
    before = {kind: set(table.files()) for kind, table in store.tables.items()}
    store.add(**{name: frame.limit(0) for name, frame in facts.items()})
    assert {kind: set(table.files()) for kind, table in store.tables.items()} == before and asked() == want


@pytest.fixture
def markdown(rows):
    """Facts of odd runs: a step twice, one without name or place, flows of no step, gaps of no run, a table touched twice."""
    steps = rows("run_id int, seq int, name string, status string, error string, engine string", [
        (1, 1, "a", "ok", None, "stub"), (1, 2, "b", "error", "bad", "spark"), (1, 2, "c", "ok", "", "stub"), (1, 3, None, "ok", None, ""),
        (2, 7, "z", "ok", None, None), (2, None, "n", "ok", None, "late"), (3, 1, "x", "ok", None, ""), (None, 1, "o", "ok", None, "stub")])
    access = rows("run_id int, seq int, mode string, ref string, touched int", [
        (1, 1, "read", "w/l/late", 3), (1, 1, "read", "w/l/t", 2), (1, 1, "read", "v/l/t", 1), (1, 1, "read", "w/l/late", 1), (1, 1, "write", None, 1),
        (1, 2, "write", "plain", 1), (2, None, "read", "w/l/lost", 1), (9, 1, "read", "w/l/lost", 1), (None, 1, "read", "w/l/lost", 1)])
    flow = rows("run_id int, seq int, pos int, to_table string, to_column string, from_table string, from_column string", [
        (1, 2, 1, "w/l/t", "c", "w/l/u", "d"), (1, 2, 2, "w/l/t", "e", None, "d"), (1, 3, 1, "w/l/t", "c", "", "d"),
        (2, 8, 1, "w/l/t", "c", None, "d"), (2, None, 1, "w/l/t", "c", None, "d"), (None, 1, 1, "w/l/t", "c", None, "d")])
    gaps = rows("run_id int, seq int, ref string, level string, reason string", [
        (1, 2, "w/l/t", "bare", ""), (1, None, "w/l/u", None, "why"), (8, 1, "w/l/t", "bare", "why"), (None, 1, "w/l/t", "bare", None)])
    return steps, access, flow, gaps


def test_report_of_odd_runs(markdown):
    lines = [tuple(r) for r in reports.run_markdown(*markdown).collect()]
    of = lambda run, section: [r[4] for r in sorted((r for r in lines if r[:2] == (run, section)), key=lambda r: (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0, r[4] or ""))]
    assert of(1, 0) == ["# Sandbox run", "", "Analysed 4 steps with the stub and spark engine.", ""]
    assert of(1, 1) == [
        "## Steps", "", "1. **a** — ok", "   - reads: late, t, t", "   - writes: none", "2. **b** — error: bad", "   - reads: none", "   - writes: plain",
        "3. **c** — ok", "   - reads: none", "   - writes: plain", None, "   - reads: none", "   - writes: none", ""]
    assert of(1, 2) == [
        "## Column lineage", "", "| to | from | via |", "| --- | --- | --- |",
        "| t.c | u.d | b |", "| t.c | u.d | c |", "| t.e | d | b |", "| t.e | d | c |", None, ""]
    assert of(1, 3) == ["## Gaps", "", "- **t** — no column lineage resolved", "- **u** — why", ""]
    assert of(2, 0)[2] == "Analysed 2 steps with the late engine." and of(None, 0)[2] == "Analysed 1 step."
    assert of(2, 1)[2:-1] == ["1. **n** — ok", "   - reads: none", "   - writes: none", "2. **z** — ok", "   - reads: none", "   - writes: none"]
    assert of(2, 2) == of(3, 2) == of(None, 2) == ["## Column lineage", "", "None resolved. See the gaps below for why.", ""]
    assert of(2, 3)[2] == of(3, 3)[2] == "Every table the run wrote has column-level lineage."
    assert of(8, 3) == ["- **t** — why"] and len([r for r in lines if r[0] in (8, 9)]) == 1
    assert of(None, 3)[2:4] == ["Every table the run wrote has column-level lineage.", "- **t** — no column lineage resolved"]


@pytest.mark.parametrize("long", [0, 1, 3, 6])
def test_long_reports_are_the_same(markdown, got, monkeypatch, long):
    short = got(reports.run_markdown(*markdown))
    monkeypatch.setattr(reports, "LONG", long)
    assert got(reports.run_markdown(*markdown)) == short


def test_lines_are_made_by_compiled_code(markdown):
    """A lambda in what is exploded would leave it."""
    above = reports.run_markdown(*markdown)._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert "inline(" in above and "lambdafunction" not in above
