"""Registered queries for reports and the entity model, each with its check."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom import fixed
from factloom.operators import answers, model, reports
from factloom.plans.registry import query
from factloom.session import scratch_path

RUN_ACCESS = "ra AS (SELECT run_id, ref, max(mode) AS mode FROM fx_access GROUP BY run_id, ref)"


def _access(f):
    return reports.run_access(f("fx_access"))


# Every run also has a flow to a table that it does not write.
_MORE_FLOWS = """SELECT run_id, seq, to_table, to_column, from_table, from_column, transform FROM fx_column_flow
 UNION ALL SELECT run_id, 1000, concat('ws0/lh_gold/t', run_id % 12), 'c1', 'ws0/lh_raw/unwritten', 'x', NULL FROM fx_step_run WHERE run_id % 12 % 3 <> 2"""


_COLUMN_SOURCES = f"""
WITH {RUN_ACCESS}, mf AS ({_MORE_FLOWS}),
obs AS (SELECT w.ref, w.run_id, s.at, row_number() OVER (PARTITION BY w.ref ORDER BY s.at DESC, w.run_id) AS age
 FROM ra w JOIN fx_step_run s ON s.run_id = w.run_id WHERE w.mode = 'write'),
fl AS (SELECT f.*, s.at, s.name AS via, dense_rank() OVER (PARTITION BY to_table, to_column ORDER BY s.at DESC, f.run_id) AS age
 FROM mf f JOIN fx_step_run s ON s.run_id = f.run_id WHERE EXISTS (SELECT 1 FROM ra w WHERE w.run_id = f.run_id AND w.ref = f.to_table AND w.mode = 'write')),
src AS (SELECT to_table AS ref, to_column AS col, from_table, from_column, transform, via FROM
 (SELECT *, row_number() OVER (PARTITION BY to_table, to_column, from_table, from_column ORDER BY seq) AS copy FROM fl WHERE age = 1) x WHERE copy = 1),
known AS (SELECT DISTINCT t.ref, t.name AS col FROM fx_table_schema t JOIN obs o ON o.ref = t.ref AND o.run_id = t.run_id WHERE o.age = 1)
SELECT ref, col AS "column", from_table, from_column, transform, via FROM src
UNION ALL SELECT k.ref, k.col, NULL, NULL, NULL, NULL FROM known k WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.ref = k.ref AND src.col = k.col)
"""


@query("h13_column_sources", _COLUMN_SOURCES)
def _(f):
    return reports.column_sources(f.sql(_MORE_FLOWS), f("fx_table_schema"), _access(f), f("fx_step_run"))


def _merged(f, kind, **facts):
    """A state to which the runs came in four batches."""
    store = answers.AnswerStore(f.spark, scratch_path(f.spark, "answers"), [kind])
    for part in (2, 0, 3, 1):
        own = F.col("run_id") % 4 == part
        store.add(_access(f).filter(own), f("fx_step_run").filter(own), **{name: frame.filter(own) for name, frame in facts.items()})
    return store


@query("h13_column_sources_merged", _COLUMN_SOURCES)
def _(f):
    return _merged(f, "columns", flow=f.sql(_MORE_FLOWS), schema=f("fx_table_schema")).column_sources()


_TOUCHED = f"""
WITH {RUN_ACCESS}
SELECT ref, mode, name, max(s.at) AS "at" FROM ra JOIN fx_step_run s ON s.run_id = ra.run_id GROUP BY ref, mode, name
"""


@query("h14_touched_by", _TOUCHED)
def _(f):
    return reports.touched_by(_access(f), f("fx_step_run"))


_CONSUMERS = f"""
WITH {RUN_ACCESS},
w AS (SELECT DISTINCT run_id, ref FROM ra WHERE mode = 'write'),
c AS (SELECT w.ref, d.consumer_name, d.consumer_kind, dense_rank() OVER (PARTITION BY w.ref ORDER BY s.at DESC, w.run_id) AS age
 FROM w JOIN fx_downstream d ON d.run_id = w.run_id JOIN fx_step_run s ON s.run_id = w.run_id WHERE d.available)
SELECT t.ref, c.consumer_name, c.consumer_kind, c.ref IS NOT NULL AS checked FROM (SELECT DISTINCT ref FROM w) t LEFT JOIN c ON c.ref = t.ref AND c.age = 1
"""


@query("h15_downstream_consumers", _CONSUMERS)
def _(f):
    return reports.downstream_consumers(f("fx_downstream"), _access(f), f("fx_step_run"))


_REAL_RUNS = f"""
WITH {RUN_ACCESS},
c AS (SELECT ra.ref, o.submitted_at, o.state, o.submitter, o.code_changed_at, s.name AS via,
 row_number() OVER (PARTITION BY ra.ref ORDER BY s.at DESC, ra.run_id, o.entry_id) AS age
 FROM ra JOIN fx_observed_run o ON o.run_id = ra.run_id JOIN fx_step_run s ON s.run_id = ra.run_id WHERE ra.mode = 'write' AND o.available)
SELECT ref, submitted_at, state, submitter, code_changed_at, via, coalesce(code_changed_at > submitted_at, false) AS code_changed_since_run FROM c WHERE age = 1
"""


@query("h16_last_real_run", _REAL_RUNS)
def _(f):
    return reports.last_real_run(f("fx_observed_run"), _access(f), f("fx_step_run"))


@query("h14_touched_by_merged", _TOUCHED)
def _(f):
    return _merged(f, "touches").touched_by()


@query("h15_consumers_merged", _CONSUMERS)
def _(f):
    return _merged(f, "consumers", downstream=f("fx_downstream")).downstream_consumers()


@query("h16_last_real_run_merged", _REAL_RUNS)
def _(f):
    return _merged(f, "real_runs", observed=f("fx_observed_run")).last_real_run()


# Questions by name and, for some, lakehouse; most names are those of tables in several lakehouses.
_NAMED = """seen AS (SELECT DISTINCT ref, lower(split_part(ref, '/', 3)) AS t, lower(split_part(ref, '/', 2)) AS l FROM fx_access),
nm AS (SELECT concat(q.table_name, '|', coalesce(q.lakehouse, '')) AS question, s.ref FROM fx_question q JOIN seen s ON lower(q.table_name) = s.t AND (q.lakehouse IS NULL OR lower(q.lakehouse) = s.l))"""
_ASKED = f"{RUN_ACCESS}, {_NAMED}, qa AS (SELECT DISTINCT run_id, mode, question AS ref FROM ra JOIN nm ON nm.ref = ra.ref), qw AS (SELECT DISTINCT run_id, ref FROM qa WHERE mode = 'write')"


def _ask(f, facts, column="ref"):
    found = reports.table_match(f("fx_question"), f("fx_access"))
    named = found.select(F.concat("table_name", F.lit("|"), F.coalesce("lakehouse", F.lit(""))).alias("question"), "ref")
    return reports.asked(facts, named, column)


@query("h13_answers", f"""
WITH {_ASKED}, mf AS ({_MORE_FLOWS}),
obs AS (SELECT w.ref, w.run_id, row_number() OVER (PARTITION BY w.ref ORDER BY s.at DESC, w.run_id) AS age FROM qw w JOIN fx_step_run s ON s.run_id = w.run_id),
fl AS (SELECT f.run_id, f.seq, f.to_table, nm.question AS ref, f.to_column, f.from_table, f.from_column, f.transform, s.name AS via, dense_rank() OVER (PARTITION BY nm.question, to_column ORDER BY s.at DESC, f.run_id) AS age
 FROM mf f JOIN nm ON nm.ref = f.to_table JOIN fx_step_run s ON s.run_id = f.run_id WHERE EXISTS (SELECT 1 FROM qw w WHERE w.run_id = f.run_id AND w.ref = nm.question)),
src AS (SELECT ref, to_column AS col, from_table, from_column, transform, via FROM
 (SELECT *, row_number() OVER (PARTITION BY ref, to_column, from_table, from_column ORDER BY seq, to_table) AS copy FROM fl WHERE age = 1) x WHERE copy = 1),
known AS (SELECT DISTINCT o.ref, t.name AS col FROM fx_table_schema t JOIN nm ON nm.ref = t.ref JOIN obs o ON o.ref = nm.question AND o.run_id = t.run_id WHERE o.age = 1)
SELECT ref, col AS "column", from_table, from_column, transform, via FROM src
UNION ALL SELECT k.ref, k.col, NULL, NULL, NULL, NULL FROM known k WHERE NOT EXISTS (SELECT 1 FROM src WHERE src.ref = k.ref AND src.col = k.col)""")
def _(f):
    """Two tables of one question may give the same source in the same place of a run: the first by name counts."""
    flow = f.sql(_MORE_FLOWS).withColumn("seq", F.struct("seq", F.col("to_table").alias("of")))
    return reports.column_sources(_ask(f, flow, "to_table"), _ask(f, f("fx_table_schema")), _ask(f, _access(f)), f("fx_step_run"))


@query("h14_answers", f"""
WITH {_ASKED} SELECT ref, mode, name, max(s.at) AS "at" FROM qa JOIN fx_step_run s ON s.run_id = qa.run_id GROUP BY ref, mode, name""")
def _(f):
    return reports.touched_by(_ask(f, _access(f)), f("fx_step_run"))


@query("h15_answers", f"""
WITH {_ASKED},
c AS (SELECT w.ref, d.consumer_name, d.consumer_kind, dense_rank() OVER (PARTITION BY w.ref ORDER BY s.at DESC, w.run_id) AS age
 FROM qw w JOIN fx_downstream d ON d.run_id = w.run_id JOIN fx_step_run s ON s.run_id = w.run_id WHERE d.available)
SELECT t.ref, c.consumer_name, c.consumer_kind, c.ref IS NOT NULL AS checked FROM (SELECT DISTINCT ref FROM qw) t LEFT JOIN c ON c.ref = t.ref AND c.age = 1""")
def _(f):
    return reports.downstream_consumers(f("fx_downstream"), _ask(f, _access(f)), f("fx_step_run"))


@query("h16_answers", f"""
WITH {_ASKED},
c AS (SELECT qw.ref, o.submitted_at, o.state, o.submitter, o.code_changed_at, s.name AS via,
 row_number() OVER (PARTITION BY qw.ref ORDER BY s.at DESC, qw.run_id, o.entry_id) AS age
 FROM qw JOIN fx_observed_run o ON o.run_id = qw.run_id JOIN fx_step_run s ON s.run_id = qw.run_id WHERE o.available)
SELECT ref, submitted_at, state, submitter, code_changed_at, via, coalesce(code_changed_at > submitted_at, false) AS code_changed_since_run FROM c WHERE age = 1""")
def _(f):
    return reports.last_real_run(f("fx_observed_run"), _ask(f, _access(f)), f("fx_step_run"))


@query("h17_table_match", """
WITH seen AS (SELECT DISTINCT ref, lower(split_part(ref, '/', 3)) AS t, lower(split_part(ref, '/', 2)) AS l FROM fx_access),
m AS (SELECT q.table_name, q.lakehouse, s.ref FROM fx_question q LEFT JOIN seen s ON lower(q.table_name) = s.t AND (q.lakehouse IS NULL OR lower(q.lakehouse) = s.l))
SELECT table_name, lakehouse, ref, count(ref) OVER (PARTITION BY table_name, lakehouse) > 1 AS ambiguous,
 count(ref) OVER (PARTITION BY table_name, lakehouse) = 0 AS unexamined FROM m
""")
def _(f):
    return reports.table_match(f("fx_question"), f("fx_access"))


_VERDICTS = f"""{RUN_ACCESS},
traced AS (SELECT DISTINCT run_id, to_table AS ref FROM fx_column_flow),
described AS (SELECT DISTINCT run_id, ref FROM fx_table_schema),
unresolved AS (SELECT DISTINCT run_id, ref FROM fx_schema_request WHERE state = 'unresolved'),
failure AS (SELECT run_id, arg_min(failure, seq) AS failure FROM fx_schema_request WHERE failure IS NOT NULL GROUP BY run_id),
facts AS (SELECT a.run_id, a.ref, a.mode, s.at AS "at", s.engine, t.ref IS NOT NULL AS is_traced, d.ref IS NOT NULL AS is_described,
  u.ref IS NOT NULL AS is_unresolved, f.failure, c.run_id IS NOT NULL AS has_coverage, c.dataframe_write_cells, c.dynamic_sql_cells, c.unparsable_cells
 FROM ra a JOIN fx_step_run s ON s.run_id = a.run_id
 LEFT JOIN traced t ON t.run_id = a.run_id AND t.ref = a.ref LEFT JOIN described d ON d.run_id = a.run_id AND d.ref = a.ref
 LEFT JOIN unresolved u ON u.run_id = a.run_id AND u.ref = a.ref LEFT JOIN failure f ON f.run_id = a.run_id
 LEFT JOIN fx_coverage c ON c.run_id = a.run_id),
verdict AS (SELECT ref, run_id, "at", mode, CASE WHEN is_traced THEN 2 WHEN NOT is_described THEN 0 ELSE 1 END AS rank,
 CASE WHEN is_traced THEN '' WHEN NOT is_described THEN
   CASE WHEN NOT is_unresolved THEN '{fixed.REASON_NO_COLUMNS}' WHEN failure IS NOT NULL THEN concat('Its schema could not be read: ', failure)
    ELSE '{fixed.REASON_UNRESOLVED}' END
  WHEN mode = 'read' THEN '{fixed.REASON_READ_ONLY}'
  WHEN NOT has_coverage THEN '{fixed.REASON_PREDATES}'
  WHEN dataframe_write_cells > 0 THEN replace('{fixed.REASON_DATAFRAME}', '%s', engine)
  WHEN dynamic_sql_cells > 0 THEN '{fixed.REASON_DYNAMIC}'
  WHEN unparsable_cells > 0 THEN '{fixed.REASON_UNPARSABLE}' ELSE '{fixed.REASON_NONE}' END AS reason FROM facts),
best AS (SELECT ref, CASE rank WHEN 2 THEN 'traced' WHEN 1 THEN 'columns-only' ELSE 'bare' END AS level, reason, written FROM
 (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY rank DESC, "at", run_id) AS n, bool_or(mode = 'write') OVER (PARTITION BY ref) AS written FROM verdict) v WHERE n = 1)"""


def _verdicts(f):
    return reports.table_coverage(
        _access(f), f("fx_column_flow"), f("fx_table_schema"), f("fx_schema_request"), f("fx_coverage"), f("fx_step_run"))


@query("h01_table_coverage", f"WITH {_VERDICTS} SELECT ref, level, reason, written FROM best")
def _(f):
    return _verdicts(f)


@query("h02_bare_write_reason", f"""
SELECT s.run_id, CASE WHEN c.run_id IS NULL THEN '{fixed.REASON_PREDATES}'
  WHEN dataframe_write_cells > 0 THEN replace('{fixed.REASON_DATAFRAME}', '%s', engine)
  WHEN dynamic_sql_cells > 0 THEN '{fixed.REASON_DYNAMIC}' WHEN unparsable_cells > 0 THEN '{fixed.REASON_UNPARSABLE}' ELSE '{fixed.REASON_NONE}' END AS reason
FROM fx_step_run s LEFT JOIN fx_coverage c ON c.run_id = s.run_id
""")
def _(f):
    joined = f("fx_step_run").join(f("fx_coverage").withColumn("known", F.lit(True)), "run_id", "left")
    return joined.select("run_id", reports.bare_write_reason(F.col("engine"), F.coalesce("known", F.lit(False))).alias("reason"))


@query("h03_coverage_summary", f"""
WITH {_VERDICTS}
SELECT count(*) AS tables, count(*) FILTER (level = 'traced') AS traced, count(*) FILTER (level = 'columns-only') AS columns_only,
 count(*) FILTER (level = 'bare') AS bare FROM best
""")
def _(f):
    return reports.coverage_summary(_verdicts(f))


@query("h04_lineage_gaps", f"""
WITH {_VERDICTS}
SELECT ref, level, reason FROM best WHERE level = 'bare' OR (level = 'columns-only' AND written)
""")
def _(f):
    return reports.lineage_gaps(_verdicts(f))


_PAIRS = """pairs AS (SELECT name, max(CASE WHEN n = 1 THEN run_id END) AS latest, max(CASE WHEN n = 2 THEN run_id END) AS previous FROM
 (SELECT name, run_id, row_number() OVER (PARTITION BY name ORDER BY "at" DESC, run_id) AS n FROM fx_step_run) r WHERE n <= 2 GROUP BY name)"""

_DIFF = f"""{_PAIRS},
tab AS (SELECT DISTINCT run_id, ref FROM fx_access), col AS (SELECT DISTINCT run_id, ref, name FROM fx_table_schema),
tr AS (SELECT DISTINCT run_id, to_table AS ref FROM fx_column_flow),
tn AS (SELECT p.name, t.ref FROM pairs p JOIN tab t ON t.run_id = p.latest WHERE p.previous IS NOT NULL),
tb AS (SELECT p.name, t.ref FROM pairs p JOIN tab t ON t.run_id = p.previous WHERE p.previous IS NOT NULL),
cn AS (SELECT p.name, t.ref, t.name AS c FROM pairs p JOIN col t ON t.run_id = p.latest WHERE p.previous IS NOT NULL),
cb AS (SELECT p.name, t.ref, t.name AS c FROM pairs p JOIN col t ON t.run_id = p.previous WHERE p.previous IS NOT NULL),
rn AS (SELECT p.name, t.ref FROM pairs p JOIN tr t ON t.run_id = p.latest WHERE p.previous IS NOT NULL),
rb AS (SELECT p.name, t.ref FROM pairs p JOIN tr t ON t.run_id = p.previous WHERE p.previous IS NOT NULL),
changes AS (
 SELECT name, ref, '' AS c, 'added_table' AS change FROM (SELECT * FROM tn EXCEPT SELECT * FROM tb) x
 UNION ALL SELECT name, ref, '', 'removed_table' FROM (SELECT * FROM tb EXCEPT SELECT * FROM tn) x
 UNION ALL SELECT name, ref, c, 'added_column' FROM (SELECT * FROM cn EXCEPT SELECT * FROM cb) x
 UNION ALL SELECT name, ref, c, 'removed_column' FROM (SELECT * FROM cb EXCEPT SELECT * FROM cn) x
 UNION ALL SELECT name, ref, '', 'lost_lineage' FROM ((SELECT * FROM rb EXCEPT SELECT * FROM rn) INTERSECT SELECT * FROM tn) x)"""


def _pairs(f):
    return reports.last_two_runs(f("fx_step_run"), ["name"])


def _diff(f):
    return reports.run_diff(_pairs(f), f("fx_access"), f("fx_table_schema"), f("fx_column_flow"), ["name"])


@query("h05_run_diff", f"""WITH {_DIFF} SELECT name, ref, c AS "column", change FROM changes""")
def _(f):
    return _diff(f)


@query("h06_diff_is_clean", f"""
WITH {_DIFF}
SELECT p.name, p.previous IS NULL AS empty, count(c.change) AS changes, count(c.change) = 0 AS clean FROM pairs p LEFT JOIN changes c ON c.name = p.name GROUP BY p.name, p.previous
""")
def _(f):
    return reports.diff_is_clean(_pairs(f), _diff(f), ["name"])


@query("h07_last_two_runs", f"WITH {_PAIRS} SELECT name, latest, previous FROM pairs")
def _(f):
    return _pairs(f)


@query("h08_retain_runs", """
WITH r AS (SELECT workspace, run_id, size_bytes, row_number() OVER (PARTITION BY workspace ORDER BY "at" DESC, run_id) AS position,
 sum(size_bytes) OVER (PARTITION BY workspace ORDER BY "at" DESC, run_id ROWS UNBOUNDED PRECEDING) AS total FROM fx_run WHERE size_bytes <= 1000000)
SELECT workspace, run_id, position FROM r WHERE position <= 5 AND (position = 1 OR total + position + 1 <= 1000000)
""")
def _(f):
    return reports.retain_runs(f("fx_run"), ["workspace"])


_OBSERVED_REFS = "SELECT DISTINCT run_id, mode, ref FROM fx_statement WHERE ref IS NOT NULL"
_SIDES = f"""{RUN_ACCESS}, ob AS ({_OBSERVED_REFS}),
sides AS (SELECT coalesce(p.run_id, o.run_id) AS run_id, coalesce(p.mode, o.mode) AS mode, coalesce(p.ref, o.ref) AS ref,
 CASE WHEN o.ref IS NULL THEN 'predicted_only' WHEN p.ref IS NULL THEN 'observed_only' ELSE 'agreed' END AS side
 FROM ra p FULL OUTER JOIN ob o ON p.run_id = o.run_id AND p.mode = o.mode AND p.ref = o.ref)"""


def _sides(f):
    return reports.compare_runs(_access(f), reports.observed_refs(f("fx_statement")))


@query("h09_compare_runs", f"WITH {_SIDES} SELECT run_id, mode, ref, side FROM sides")
def _(f):
    return _sides(f)


_SUMMARY = f"""{_SIDES},
per_run AS (SELECT run_id, count(*) AS asked, count(*) FILTER (available) AS available, count(DISTINCT CASE WHEN NOT available THEN note END) AS notes,
 coalesce(bool_or(available AND code_changed_at > submitted_at), false) AS code_is_newer FROM fx_observed_run GROUP BY run_id),
newest AS (SELECT run_id, submitted_at, submitter, state FROM
 (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY submitted_at DESC, entry_id) AS n FROM fx_observed_run WHERE available) x WHERE n = 1),
flags AS (SELECT run_id, ref, bool_or(side = 'agreed') AS a, bool_or(side = 'predicted_only') AS p, bool_or(side = 'observed_only') AS o FROM sides GROUP BY run_id, ref),
totals AS (SELECT run_id, count(*) FILTER (a) AS agreed, count(*) FILTER (p AND NOT a) AS predicted_only, count(*) FILTER (o) AS observed_only FROM flags GROUP BY run_id),
summary AS (SELECT r.run_id, r.asked, r.available, r.notes, n.submitted_at AS last_run_at, n.submitter AS last_run_by, n.state AS last_run_state, r.code_is_newer,
 CASE WHEN r.available > 0 THEN coalesce(t.agreed, 0) ELSE 0 END AS agreed, CASE WHEN r.available > 0 THEN coalesce(t.predicted_only, 0) ELSE 0 END AS predicted_only,
 CASE WHEN r.available > 0 THEN coalesce(t.observed_only, 0) ELSE 0 END AS observed_only
 FROM per_run r LEFT JOIN newest n ON n.run_id = r.run_id LEFT JOIN totals t ON t.run_id = r.run_id)"""


def _summary(f):
    return reports.observed_summary(f("fx_observed_run"), _sides(f))


@query("h10_observed_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def _(f):
    return _summary(f)


@query("h10_observed_tables", f"""
WITH {_SUMMARY}
SELECT f.run_id, ref, unnest(list_filter([CASE WHEN a THEN 'agreed' END, CASE WHEN p AND NOT a THEN 'predicted_only' END, CASE WHEN o THEN 'observed_only' END], lambda v: v IS NOT NULL)) AS verdict
FROM flags f JOIN per_run r ON r.run_id = f.run_id WHERE r.available > 0""")
def _(f):
    return reports.observed_tables(f("fx_observed_run"), _sides(f))


@query("h10_observed_notes", "SELECT DISTINCT run_id, note FROM fx_observed_run WHERE NOT available AND note IS NOT NULL")
def _(f):
    return reports.observed_notes(f("fx_observed_run"))


@query("h11_observed_headline", f"""
WITH {_SUMMARY}
SELECT run_id, CASE WHEN available = 0 THEN 'No readable run history for these notebooks.' ELSE concat(
  CASE WHEN agreed + predicted_only > 0 THEN concat(agreed, ' of ', agreed + predicted_only, ' predicted table', CASE WHEN agreed + predicted_only = 1 THEN '' ELSE 's' END, ' confirmed by the last real run')
   ELSE 'Compared against the last real run' END,
  CASE WHEN observed_only > 0 THEN concat(' · ', observed_only, ' table', CASE WHEN observed_only = 1 THEN '' ELSE 's' END, ' the run touched that this analysis did not predict') ELSE '' END,
  CASE WHEN code_is_newer THEN ' · the notebook has been edited since that run' ELSE '' END) END AS headline,
 available > 0 AND observed_only = 0 AND (predicted_only = 0 OR code_is_newer) AS agrees FROM summary
""")
def _(f):
    return reports.observed_headline(_summary(f))


@query("h12_observed_rollup", """
SELECT run_id, count(DISTINCT execution_id) AS statements, count(DISTINCT CASE WHEN ref IS NOT NULL THEN execution_id END) AS resolved,
 count(DISTINCT CASE WHEN mode = 'read' THEN ref END) AS reads, count(DISTINCT CASE WHEN mode = 'write' THEN ref END) AS writes FROM fx_statement GROUP BY run_id
""")
def _(f):
    return reports.observed_rollup(f("fx_statement"))


_ENTRY_ERRORS = "SELECT run_id, name, CASE WHEN NOT ok THEN 'activity failed' END AS error FROM fx_entry"
_CELLS = "SELECT c.run_id, s.name, c.cell_index, c.status, c.error FROM fx_cell_result c JOIN fx_step_run s ON s.run_id = c.run_id"
_FAILURES = f"""fails AS (SELECT run_id, 'step' AS kind, name, CAST(NULL AS BIGINT) AS cell, error FROM fx_step_error WHERE error IS NOT NULL
 UNION ALL SELECT run_id, 'entry', name, NULL, error FROM ({_ENTRY_ERRORS}) e WHERE error IS NOT NULL
 UNION ALL SELECT run_id, 'cell', name, cell_index + 1, error FROM ({_CELLS}) c WHERE status = 'error')"""


def _failures(f):
    return reports.run_failures(f("fx_step_error"), f.sql(_ENTRY_ERRORS), f.sql(_CELLS))


@query("h18_run_failures", f"WITH {_FAILURES} SELECT run_id, kind, name, cell, error FROM fails")
def _(f):
    return _failures(f)


_BARE = """bare AS (SELECT DISTINCT a.run_id, a.ref FROM ra a WHERE a.mode = 'write' AND NOT EXISTS
 (SELECT 1 FROM fx_column_flow f WHERE f.run_id = a.run_id AND f.to_table = a.ref))"""


def _bare(f):
    written = _access(f).filter("mode = 'write'").select("run_id", "ref")
    return written.join(f("fx_column_flow").select("run_id", F.col("to_table").alias("ref")), ["run_id", "ref"], "left_anti")


@query("h19_run_narrative", f"""
WITH {RUN_ACCESS}, {_BARE}, {_FAILURES},
n AS (SELECT s.run_id, count(*) AS nb FROM fx_step_run s GROUP BY s.run_id),
c AS (SELECT run_id, count(*) AS c FROM fx_cell_result GROUP BY run_id),
io AS (SELECT run_id, count(*) FILTER (mode = 'read') AS r, count(*) FILTER (mode = 'write') AS w FROM ra GROUP BY run_id),
b AS (SELECT run_id, count(*) AS b FROM bare GROUP BY run_id),
x AS (SELECT run_id, count(*) FILTER (kind = 'cell') AS fc, count(*) FILTER (kind <> 'cell') AS fs FROM fails GROUP BY run_id),
j AS (SELECT n.run_id, nb, coalesce(c.c, 0) AS c, coalesce(r, 0) AS r, coalesce(w, 0) AS w, coalesce(b, 0) AS b, coalesce(fc, 0) AS fc, coalesce(fs, 0) AS fs
 FROM n LEFT JOIN c ON c.run_id = n.run_id LEFT JOIN io ON io.run_id = n.run_id LEFT JOIN b ON b.run_id = n.run_id LEFT JOIN x ON x.run_id = n.run_id)
SELECT run_id, concat('Ran ', nb, ' notebook', CASE WHEN nb = 1 THEN '' ELSE 's' END, CASE WHEN c > 0 THEN concat(', ', c, ' cell', CASE WHEN c = 1 THEN '' ELSE 's' END) ELSE '' END, ' — ',
 CASE WHEN r > 0 OR w > 0 THEN concat('read ', r, ' table', CASE WHEN r = 1 THEN '' ELSE 's' END, ', wrote ', w) ELSE 'touched no tables' END,
 CASE WHEN b > 0 THEN concat(', ', b, ' without column lineage') ELSE '' END, '.',
 CASE WHEN fc > 0 THEN concat(' — ', fc, ' cell', CASE WHEN fc = 1 THEN '' ELSE 's' END, ' failed') WHEN fs > 0 THEN concat(' — ', fs, ' step', CASE WHEN fs = 1 THEN '' ELSE 's' END, ' failed') ELSE '' END) AS narrative FROM j
""")
def _(f):
    return reports.run_narrative(f("fx_step_run"), f("fx_cell_result"), _access(f), _bare(f), _failures(f))


_REPORT_RUN = "SELECT run_id, at, engine, run_id % 50 = 0 AS saw_credentials FROM fx_step_run"


@query("h20_run_report", f"""
WITH {_SUMMARY}, {_BARE},
rq AS (SELECT run_id, count(DISTINCT CASE WHEN state = 'resolved' THEN ref END) AS rs, count(DISTINCT ref) AS rr FROM fx_schema_request GROUP BY run_id),
io AS (SELECT run_id, count(*) FILTER (mode = 'read') AS r, count(*) FILTER (mode = 'write') AS w FROM ra GROUP BY run_id),
bb AS (SELECT run_id, count(*) AS b FROM bare GROUP BY run_id)
SELECT s.run_id, s.engine, CAST(1 AS BIGINT) AS notebooks, s.run_id % 50 = 0 AS breach, coalesce(r, 0) AS reads, coalesce(w, 0) AS writes,
 coalesce(w, 0) - coalesce(b, 0) AS covered_writes, coalesce(rs, 0) AS schemas_resolved, coalesce(rr, 0) AS schemas_requested,
 CASE WHEN c.run_id IS NOT NULL THEN concat_ws(',', CASE WHEN dataframe_write_cells > 0 THEN 'dataframe' END, CASE WHEN dynamic_sql_cells > 0 THEN 'dynamic-sql' END, CASE WHEN unparsable_cells > 0 THEN 'unparsable' END) END AS reasons,
 u.agreed AS confirmed, u.agreed + u.predicted_only AS comparable
FROM fx_step_run s LEFT JOIN io ON io.run_id = s.run_id LEFT JOIN bb ON bb.run_id = s.run_id LEFT JOIN rq ON rq.run_id = s.run_id
 LEFT JOIN fx_coverage c ON c.run_id = s.run_id LEFT JOIN summary u ON u.run_id = s.run_id
""")
def _(f):
    return reports.run_report(
        f.sql(_REPORT_RUN), _access(f), f("fx_schema_request"), f("fx_column_flow"), f("fx_coverage"), _summary(f))


# Runs of several steps; some have no flows, some no gaps.
_MD_STEPS = """SELECT run_id, seq, name, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CASE WHEN NOT ok THEN concat('step ', seq, ' failed') END AS error,
 CASE seq % 3 WHEN 0 THEN 'stub' WHEN 1 THEN 'spark' ELSE '' END AS engine FROM fx_entry"""
_MD_ACCESS = """SELECT run_id, seq, 'read' AS mode, reads_ref AS ref, 1 AS touched FROM fx_entry WHERE seq % 4 <> 0
 UNION ALL SELECT run_id, seq, 'write', writes_ref, 2 FROM fx_entry WHERE writes_ref IS NOT NULL UNION ALL SELECT run_id, seq, 'write', 'ws0/lh_gold/extra', 1 FROM fx_entry WHERE seq = 2"""
_MD_FLOW = """SELECT run_id, seq, 1 AS pos, writes_ref AS to_table, concat('c', seq) AS to_column, CASE WHEN seq % 2 = 0 THEN reads_ref END AS from_table, 'x' AS from_column
 FROM fx_entry WHERE writes_ref IS NOT NULL AND run_id % 3 <> 0"""
_MD_GAPS = """SELECT run_id, seq, writes_ref AS ref, CASE WHEN seq % 2 = 0 THEN 'bare' ELSE 'columns-only' END AS level, CASE WHEN seq % 3 = 0 THEN 'because' ELSE '' END AS reason
 FROM fx_entry WHERE writes_ref IS NOT NULL AND run_id % 5 = 0"""


@query("h21_run_markdown", f"""
WITH st AS ({_MD_STEPS}), ac AS ({_MD_ACCESS}), fl AS ({_MD_FLOW}), gp AS ({_MD_GAPS}), r AS (SELECT run_id, count(*) AS n FROM st GROUP BY run_id),
en AS (SELECT run_id, string_agg(engine, ' and ' ORDER BY at_, engine) AS engines FROM (SELECT run_id, engine, min(seq) AS at_ FROM st WHERE engine <> '' GROUP BY run_id, engine) e GROUP BY run_id),
li AS (SELECT run_id, seq, string_agg(split_part(ref, '/', 3), ', ' ORDER BY touched, split_part(ref, '/', 3)) FILTER (mode = 'read') AS reads,
 string_agg(split_part(ref, '/', 3), ', ' ORDER BY touched, split_part(ref, '/', 3)) FILTER (mode = 'write') AS writes FROM (SELECT run_id, seq, mode, ref, min(touched) AS touched FROM ac GROUP BY run_id, seq, mode, ref) a GROUP BY run_id, seq),
sn AS (SELECT st.*, row_number() OVER (PARTITION BY st.run_id ORDER BY st.seq, name) AS number, reads, writes FROM st LEFT JOIN li ON li.run_id = st.run_id AND li.seq = st.seq),
fx AS (SELECT * FROM (VALUES (0, -1099511627776, 0, '{fixed.REPORT_TITLE}'), (0, -1099511627776, 1, ''), (0, 1099511627776, 0, ''), (1, -1099511627776, 0, '{fixed.REPORT_STEPS}'), (1, -1099511627776, 1, ''), (1, 1099511627776, 0, ''),
 (2, -1099511627776, 0, '{fixed.REPORT_FLOWS}'), (2, -1099511627776, 1, ''), (2, 1099511627776, 0, ''), (3, -1099511627776, 0, '{fixed.REPORT_GAPS}'), (3, -1099511627776, 1, ''), (3, 1099511627776, 0, '')) v(section, k1, k2, line))
SELECT run_id, section, k1, k2, line FROM r, fx
UNION ALL SELECT r.run_id, 0, 0, 0, concat('Analysed ', n, ' step', CASE WHEN n = 1 THEN '' ELSE 's' END, CASE WHEN engines IS NULL THEN '.' ELSE concat(' with the ', engines, ' engine.') END) FROM r LEFT JOIN en ON en.run_id = r.run_id
UNION ALL SELECT run_id, 1, number, 0, concat(number, '. **', name, '** — ', status, CASE WHEN error IS NULL THEN '' ELSE concat(': ', error) END) FROM sn
UNION ALL SELECT run_id, 1, number, 1, concat('   - reads: ', coalesce(reads, 'none')) FROM sn UNION ALL SELECT run_id, 1, number, 2, concat('   - writes: ', coalesce(writes, 'none')) FROM sn
UNION ALL SELECT DISTINCT run_id, 2, -1099511627775, unnest([0, 1]), unnest(['{fixed.REPORT_FLOW_HEAD[0]}', '{fixed.REPORT_FLOW_HEAD[1]}']) FROM (SELECT DISTINCT run_id FROM fl) d
UNION ALL SELECT run_id, 2, 0, 0, '{fixed.REPORT_NO_FLOWS}' FROM r WHERE run_id NOT IN (SELECT run_id FROM fl)
UNION ALL SELECT fl.run_id, 2, fl.seq, pos, concat('| ', split_part(to_table, '/', 3), '.', to_column, ' | ', CASE WHEN from_table IS NULL THEN from_column ELSE concat(split_part(from_table, '/', 3), '.', from_column) END, ' | ', name, ' |')
 FROM fl JOIN st ON st.run_id = fl.run_id AND st.seq = fl.seq
UNION ALL SELECT run_id, 3, 0, 0, '{fixed.REPORT_NO_GAPS}' FROM r WHERE run_id NOT IN (SELECT run_id FROM gp)
UNION ALL SELECT run_id, 3, CASE level WHEN 'bare' THEN 0 ELSE 1 END, seq, concat('- **', split_part(ref, '/', 3), '** — ', CASE WHEN reason = '' THEN '{fixed.REPORT_NO_REASON}' ELSE reason END) FROM gp""")
def _(f):
    return reports.run_markdown(f.sql(_MD_STEPS), f.sql(_MD_ACCESS), f.sql(_MD_FLOW), f.sql(_MD_GAPS))


@query("h22_gap_notes", """
WITH n AS (SELECT ref, trim(note) AS note, updated_at, row_number() OVER (PARTITION BY ref ORDER BY updated_at DESC, trim(note) DESC) AS k FROM fx_gap_note)
SELECT g.ref, n.note, n.updated_at FROM fx_gap g LEFT JOIN n ON n.ref = g.ref AND n.k = 1 AND n.note <> ''
""")
def _(f):
    return reports.gap_notes(f("fx_gap"), f("fx_gap_note"))


@query("h23_schema_baseline", """
SELECT concat(workspace, '/', lakehouse, '/', name) AS ref, readable FROM fx_lakehouse_table t
WHERE EXISTS (SELECT 1 FROM fx_access a WHERE split_part(a.ref, '/', 1) = t.workspace AND split_part(a.ref, '/', 2) = t.lakehouse)
""")
def _(f):
    return reports.schema_baseline(f("fx_access"), f("fx_lakehouse_table"))


@query("h24_step_tables", "SELECT DISTINCT run_id, mode, ref FROM fx_access")
def _(f):
    return reports.step_tables(f("fx_access"), ["run_id"])


# -- entity model --------------------------------------------------------------

_COLUMNS = """cols AS (SELECT run_id, ref, name FROM fx_table_schema UNION SELECT run_id, to_table, to_column FROM fx_column_flow
 UNION SELECT run_id, from_table, from_column FROM fx_column_flow WHERE from_table IS NOT NULL)"""


def _model(f):
    return f("fx_table_schema"), f("fx_column_flow"), _access(f)


@query("i1_entities", f"""
WITH {_COLUMNS}
SELECT run_id, concat('col:', ref, ':', name) AS id, name, 'column' AS kind FROM cols
UNION ALL SELECT run_id, concat('table:', ref), ref, 'table' FROM (SELECT run_id, ref FROM cols UNION SELECT run_id, ref FROM fx_access) t
""")
def _(f):
    return model.entities(*_model(f))


@query("i2_entity_children", f"WITH {_COLUMNS} SELECT run_id, concat('table:', ref) AS parent, concat('col:', ref, ':', name) AS child FROM cols")
def _(f):
    return model.entity_children(f("fx_table_schema"), f("fx_column_flow"))


@query("i2_roots", f"WITH {_COLUMNS} SELECT run_id, concat('table:', ref) AS id FROM (SELECT run_id, ref FROM cols UNION SELECT run_id, ref FROM fx_access) t")
def _(f):
    return model.roots(model.entities(*_model(f)))


@query("i3_column_transitions", """
SELECT run_id, concat('col:', from_table, ':', from_column) AS source, concat('col:', to_table, ':', to_column) AS target,
 arg_max(coalesce(transform, ''), seq) AS transform FROM fx_column_flow WHERE from_table IS NOT NULL GROUP BY run_id, from_table, from_column, to_table, to_column
""")
def _(f):
    return model.column_transitions(f("fx_column_flow"))


@query("i4_table_transitions", f"""
WITH {RUN_ACCESS.replace("AS (", "AS MATERIALIZED (", 1)},
flowing AS MATERIALIZED (SELECT DISTINCT run_id, to_table FROM fx_column_flow),
bare AS MATERIALIZED (SELECT a.run_id, a.ref FROM ra a ANTI JOIN flowing f ON f.run_id = a.run_id AND f.to_table = a.ref WHERE a.mode = 'write')
SELECT b.run_id, concat('table:', r.ref) AS source, concat('table:', b.ref) AS target, 'table-level' AS resolution
FROM bare b JOIN ra r ON r.run_id = b.run_id AND r.mode = 'read'
""")
def _(f):
    return model.table_transitions(f("fx_column_flow"), _access(f))
