"""Registered queries for provenance rules, each with its check."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import provenance as prov
from factloom.operators import reports
from factloom.plans.registry import query
from factloom.session import growing

_ARG = "struct<pos:int,out_name:string,input_cols:array<string>,transform:string,role:string>"


def _apply(f, verb, *arguments, right=False):
    """One verb over frame L (and R) of every notebook."""
    ops = f("fx_notebook").select(
        "notebook", F.lit(1).alias("seq"), F.lit("O").alias("out_frame"), F.lit(verb).alias("verb"),
        F.lit("L").alias("left_frame"), F.lit("R" if right else None).cast("string").alias("right_frame"))
    rows = F.from_json(F.lit(_json(arguments)), f"array<{_ARG}>")
    args = ops.select("notebook", "seq", F.inline(rows))
    return prov.apply_ops(ops, args, f("fx_base_frame"))


def _json(arguments):
    import json

    keys = ("pos", "out_name", "input_cols", "transform", "role")
    return json.dumps([dict(zip(keys, (i + 1, *a))) for i, a in enumerate(arguments)])


_LR = "L AS (SELECT * FROM fx_base_frame WHERE frame = 'L'), R AS (SELECT * FROM fx_base_frame WHERE frame = 'R')"
# rows(notebook, col_name, src_ref, src_column, transform, slot) -> the frame they make
_FRAME = """SELECT DISTINCT notebook, 'O' AS frame, dense_rank() OVER (PARTITION BY notebook ORDER BY s, col_name) AS pos, col_name, src_ref, src_column, transform FROM
 (SELECT *, min(slot) OVER (PARTITION BY notebook, col_name) AS s, count(src_column) OVER (PARTITION BY notebook, col_name) AS n FROM rows) x WHERE src_column IS NOT NULL OR n = 0"""


def _projected(values, strict=False):
    join = "JOIN" if strict else "LEFT JOIN"
    return f"""a(slot, col_name, input, transform) AS (VALUES {values}),
rows AS (SELECT DISTINCT n.notebook, a.col_name, L.src_ref, L.src_column, a.transform, a.slot FROM (SELECT DISTINCT notebook FROM L) n CROSS JOIN a
 {join} L ON L.notebook = n.notebook AND L.col_name = a.input)"""


@query("e01_seed", """
SELECT o.notebook, o.out_frame AS frame, s.pos, s.name AS col_name, s.ref AS src_ref, s.name AS src_column, CAST(NULL AS VARCHAR) AS transform
FROM fx_frame_op o JOIN fx_ref_schema s ON s.ref = o.ref""")
def _(f):
    return prov.seed(f("fx_frame_op").filter("ref IS NOT NULL"), f("fx_ref_schema"))


@query("e03_passthrough", f"WITH {_LR} SELECT notebook, 'O' AS frame, pos, col_name, src_ref, src_column, transform FROM L")
def _(f):
    return _apply(f, "filter")


@query("e04_project", f"""WITH {_LR}, {_projected("(1, 'c0', 'c0', NULL), (2, 'x', 'c1', 'c1 + c2'), (2, 'x', 'c2', 'c1 + c2'), (4, 'one', NULL, '1')")} {_FRAME}""")
def _(f):
    return _apply(
        f, "select", ("c0", ["c0"], None, "col"), ("x", ["c1", "c2"], "c1 + c2", "col"), (None, ["c0"], "f(c0)", "col"), ("one", [], "1", "col"))


@query("e04_select_expr", f"""WITH {_LR}, {_projected("(1, 'c0', 'c0', CAST(NULL AS VARCHAR)), (2, 'z', 'c1', NULL), (3, 'q', 'nope', NULL)", strict=True)} {_FRAME}""")
def _(f):
    return _apply(f, "selectExpr", ("c0", ["c0"], None, "expr"), ("z", ["c1"], None, "expr"), ("q", ["nope"], None, "expr"))


@query("e05_with_columns", f"""WITH {_LR},
a(slot, col_name, input, transform) AS (VALUES (101, 'y', 'c0', 'c0 + c1'), (101, 'y', 'c1', 'c0 + c1'), (102, 'c0', 'c1', 'g(c1)')),
made AS (SELECT DISTINCT n.notebook, a.col_name, L.src_ref, L.src_column, a.transform, coalesce(o.pos, a.slot) AS slot FROM (SELECT DISTINCT notebook FROM L) n CROSS JOIN a
 LEFT JOIN L ON L.notebook = n.notebook AND L.col_name = a.input LEFT JOIN L o ON o.notebook = n.notebook AND o.col_name = a.col_name),
rows AS (SELECT notebook, col_name, src_ref, src_column, transform, pos AS slot FROM L WHERE col_name <> 'c0' UNION ALL SELECT * FROM made) {_FRAME}""")
def _(f):
    return _apply(f, "withColumns", ("y", ["c0", "c1"], "c0 + c1", "col"), ("c0", ["c1"], "g(c1)", "col"))


@query("e06_rename", f"""WITH {_LR}
SELECT notebook, 'O' AS frame, pos, CASE WHEN col_name = 'c1' THEN 'z' ELSE col_name END AS col_name, src_ref, src_column, transform FROM L
WHERE notebook IN (SELECT notebook FROM L WHERE col_name = 'c1')""")
def _(f):
    return _apply(f, "withColumnRenamed", ("z", ["c1"], None, "col"))


@query("e07_drop_columns", f"WITH {_LR}, rows AS (SELECT notebook, col_name, src_ref, src_column, transform, pos AS slot FROM L WHERE col_name <> 'c1') {_FRAME}")
def _(f):
    return _apply(f, "drop", ("c1", ["c1"], None, "col"))


_BOTH = "both_known AS (SELECT DISTINCT notebook FROM L WHERE notebook IN (SELECT notebook FROM R))"


@query("e08_join_frames", f"""WITH {_LR}, {_BOTH},
rows AS (SELECT notebook, col_name, src_ref, src_column, transform, pos AS slot FROM L WHERE notebook IN (SELECT notebook FROM both_known)
 UNION ALL SELECT DISTINCT R.notebook, R.col_name, R.src_ref, R.src_column, L.transform, CASE WHEN L.pos IS NULL THEN 100 + R.pos ELSE L.pos END FROM R
 LEFT JOIN L ON L.notebook = R.notebook AND L.col_name = R.col_name WHERE R.notebook IN (SELECT notebook FROM both_known)) {_FRAME}""")
def _(f):
    return _apply(f, "join", right=True)


@query("e09_union_frames", f"""WITH {_LR},
fit AS (SELECT l.notebook FROM (SELECT notebook, max(pos) AS w FROM L GROUP BY notebook) l JOIN (SELECT notebook, max(pos) AS w FROM R GROUP BY notebook) r ON r.notebook = l.notebook AND r.w = l.w),
rows AS (SELECT notebook, col_name, src_ref, src_column, transform, pos AS slot FROM L WHERE notebook IN (SELECT notebook FROM fit)
 UNION ALL SELECT DISTINCT R.notebook, L.col_name, R.src_ref, R.src_column, L.transform, L.pos FROM R JOIN L ON L.notebook = R.notebook AND L.pos = R.pos WHERE R.notebook IN (SELECT notebook FROM fit)) {_FRAME}""")
def _(f):
    return _apply(f, "union", right=True)


@query("e10_union_by_name", f"""WITH {_LR}, {_BOTH},
rows AS (SELECT notebook, col_name, src_ref, src_column, transform, pos AS slot FROM L WHERE notebook IN (SELECT notebook FROM both_known)
 UNION ALL SELECT DISTINCT R.notebook, L.col_name, R.src_ref, R.src_column, L.transform, L.pos FROM R JOIN L ON L.notebook = R.notebook AND L.col_name = R.col_name) {_FRAME}""")
def _(f):
    return _apply(f, "unionByName", right=True)


@query("e11_rename_all", f"""WITH {_LR}
SELECT notebook, 'O' AS frame, pos, CASE pos WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END AS col_name, src_ref, src_column, transform FROM L
WHERE notebook IN (SELECT notebook FROM L GROUP BY notebook HAVING max(pos) = 3)""")
def _(f):
    return _apply(f, "toDF", ("a", None, None, "col"), ("b", None, None, "col"), ("c", None, None, "col"))


@query("e12_group_agg", f"""WITH {_LR}, a(slot, col_name, input, transform, strict) AS (VALUES (1, 'c0', 'c0', NULL, false), (2, 'n', 'c1', 'count(c1)', false), (3, 'sum(c2)', 'c2', NULL, true)),
rows AS (SELECT DISTINCT n.notebook, a.col_name, L.src_ref, L.src_column, a.transform, a.slot FROM (SELECT DISTINCT notebook FROM L) n CROSS JOIN a
 LEFT JOIN L ON L.notebook = n.notebook AND L.col_name = a.input WHERE NOT a.strict OR L.notebook IS NOT NULL) {_FRAME}""")
def _(f):
    return _apply(f, "groupBy", ("c0", ["c0"], None, "key"), ("n", ["c1"], "count(c1)", "col"), ("sum(c2)", ["c2"], "sum(c2)", "dict"))


@query("e13_abstain", f"""WITH {_LR}, wl AS (SELECT notebook, max(pos) AS w FROM L GROUP BY notebook), wr AS (SELECT notebook, max(pos) AS w FROM R GROUP BY notebook)
SELECT notebook, 'known' AS verb FROM wl UNION ALL SELECT wl.notebook, 'union' FROM wl JOIN wr ON wr.notebook = wl.notebook AND wr.w = wl.w
UNION ALL SELECT notebook, 'toDF' FROM wl WHERE w = 2 UNION ALL SELECT DISTINCT notebook, 'rename' FROM L WHERE col_name = 'c1'""")
def _(f):
    outcomes = [
        _apply(f, "filter").withColumn("verb", F.lit("known")),
        _apply(f, "mystery").withColumn("verb", F.lit("mystery")),
        _apply(f, "select", ("c0", ["c0"], None, "star")).withColumn("verb", F.lit("star")),
        _apply(f, "groupBy", (None, ["c0"], None, "key")).withColumn("verb", F.lit("open key")),
        _apply(f, "union", right=True).withColumn("verb", F.lit("union")),
        _apply(f, "toDF", ("a", None, None, "col"), ("b", None, None, "col")).withColumn("verb", F.lit("toDF")),
        _apply(f, "withColumnRenamed", ("z", ["c1"], None, "col")).withColumn("verb", F.lit("rename")),
    ]
    known = outcomes[0]
    for outcome in outcomes[1:]:
        known = known.unionByName(outcome)
    return known.select("notebook", "verb").distinct()


_E13_STEP = """
{name}_l AS (SELECT o.notebook, o.seq, o.verb, f.pos, col_name, src_ref, src_column, transform FROM fx_frame_op o JOIN {left} f ON f.notebook = o.notebook AND f.seq = o.seq - 1 WHERE o.seq % 5 = {at}),
{name}_r AS (SELECT o.notebook, o.seq, o.verb, f.pos, col_name, src_ref, src_column FROM fx_frame_op o JOIN {right} f ON f.notebook = o.notebook AND f.seq = o.seq - 2 WHERE o.seq % 5 = {at} AND o.verb IN ('join', 'union', 'unionByName')),
{name}_w AS (SELECT l.notebook, l.seq, lw, rw FROM (SELECT notebook, seq, max(pos) AS lw FROM {name}_l GROUP BY notebook, seq) l
 LEFT JOIN (SELECT notebook, seq, max(pos) AS rw FROM {name}_r GROUP BY notebook, seq) r ON r.notebook = l.notebook AND r.seq = l.seq),
{name}_n AS (SELECT notebook, seq, col_name, min(pos) AS pos, max(transform) AS transform FROM {name}_l GROUP BY notebook, seq, col_name),
{name}_a AS (SELECT w.notebook, w.seq, o.verb, a.out_name, a.input, a.transform, a.slot FROM {name}_w w JOIN fx_frame_op o ON o.notebook = w.notebook AND o.seq = w.seq
 JOIN (VALUES ('groupBy', 'c0', 'c0', NULL, 1), ('groupBy', 'sum(c2)', 'c2', 'sum(c2)', 2), ('select', 'c0', 'c0', NULL, 1), ('select', 'x', 'c1', 'upper(c1)', 2),
  ('withColumn', 'y', 'c0', 'c0 + c1', 1001), ('withColumn', 'y', 'c1', 'c0 + c1', 1001)) a(verb, out_name, input, transform, slot) ON a.verb = o.verb),
{name}_rows AS (
 SELECT notebook, seq, col_name, src_ref, src_column, transform, pos AS slot FROM {name}_l WHERE verb = 'filter' OR (verb = 'drop' AND col_name <> 'c1') OR (verb = 'withColumn' AND col_name <> 'y')
 UNION ALL SELECT a.notebook, a.seq, out_name, src_ref, src_column, a.transform, coalesce(CASE WHEN a.verb = 'withColumn' THEN n.pos END, slot) FROM {name}_a a
  LEFT JOIN {name}_l l ON l.notebook = a.notebook AND l.seq = a.seq AND l.col_name = a.input LEFT JOIN {name}_n n ON n.notebook = a.notebook AND n.seq = a.seq AND n.col_name = out_name
 UNION ALL SELECT l.notebook, l.seq, CASE WHEN col_name = 'c0' THEN 'z' ELSE col_name END, src_ref, src_column, transform, pos FROM {name}_l l
  WHERE verb = 'withColumnRenamed' AND col_name <> 'z' AND EXISTS (SELECT 1 FROM {name}_n n WHERE n.notebook = l.notebook AND n.seq = l.seq AND n.col_name = 'c0')
 UNION ALL SELECT l.notebook, l.seq, CASE pos WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'c' END, src_ref, src_column, transform, pos FROM {name}_l l
  JOIN {name}_w w ON w.notebook = l.notebook AND w.seq = l.seq WHERE verb = 'toDF' AND lw = 3
 UNION ALL SELECT l.notebook, l.seq, col_name, src_ref, src_column, transform, pos FROM {name}_l l JOIN {name}_w w ON w.notebook = l.notebook AND w.seq = l.seq
  WHERE rw IS NOT NULL AND (verb IN ('join', 'unionByName') OR (verb = 'union' AND lw = rw))
 UNION ALL SELECT r.notebook, r.seq, r.col_name, src_ref, src_column, n.transform, coalesce(n.pos, 1000 + r.pos) FROM {name}_r r JOIN {name}_w w ON w.notebook = r.notebook AND w.seq = r.seq
  LEFT JOIN {name}_n n ON n.notebook = r.notebook AND n.seq = r.seq AND n.col_name = r.col_name WHERE verb = 'join' OR (verb = 'unionByName' AND n.pos IS NOT NULL)
 UNION ALL SELECT r.notebook, r.seq, n.col_name, src_ref, src_column, n.transform, n.pos FROM {name}_r r JOIN {name}_w w ON w.notebook = r.notebook AND w.seq = r.seq AND lw = rw
  JOIN {name}_n n ON n.notebook = r.notebook AND n.seq = r.seq AND n.pos = r.pos WHERE verb = 'union'),
{name} AS MATERIALIZED (SELECT DISTINCT notebook, seq, dense_rank() OVER (PARTITION BY notebook, seq ORDER BY s, col_name) AS pos, col_name, src_ref, src_column, transform
 FROM (SELECT *, min(slot) OVER (PARTITION BY notebook, seq, col_name) AS s, count(src_column) OVER (PARTITION BY notebook, seq, col_name) AS n FROM {name}_rows) x WHERE src_column IS NOT NULL OR n = 0)"""


def _e13_sql():
    """Four steps after every table; only the first of them may read a chain before, which then reads none itself: two passes."""
    ctes = ["t0 AS (SELECT notebook, o.seq, s.pos, s.name AS col_name, s.ref AS src_ref, s.name AS src_column, CAST(NULL AS VARCHAR) AS transform FROM fx_frame_op o JOIN fx_ref_schema s ON s.ref = o.ref)",
            "none AS (SELECT * FROM t0 WHERE false)"]
    last = "none"
    for turn in ("p", "q"):
        steps = ["t0"]
        for at in (2, 3, 4, 0):
            name = f"{turn}{at}"
            ctes.append(_E13_STEP.format(name=name, at=at, left=steps[-1], right=last if at == 2 else steps[-2]))
            steps.append(name)
        last = steps[-1]
    every = " UNION ALL ".join(f"SELECT * FROM {name}" for name in ("t0", "q2", "q3", "q4", "q0"))
    return f"WITH {', '.join(ctes)} SELECT notebook, concat('f', seq) AS frame, pos, col_name, src_ref, src_column, transform FROM ({every}) frames"


@query("e13_resolve_frames", _e13_sql())
def _(f):
    """Whole op logs: every frame of every notebook that can be known."""
    ops = f("fx_frame_op")
    role = F.when((F.col("verb") == "groupBy") & (F.col("pos") == 1), "key").otherwise("col")
    args = f("fx_frame_op_arg").join(growing(ops.select("notebook", "seq", "verb")), ["notebook", "seq"]).select(
        "notebook", "seq", "pos", "out_name", F.split("input_cols", ",").alias("input_cols"), "transform", role.alias("role"))
    base = prov.seed(ops.filter("ref IS NOT NULL"), f("fx_ref_schema"))
    return prov.resolve_frames(ops.select("notebook", "seq", "out_frame", "verb", "left_frame", "right_frame"), args, base)


_VIEWS = """SELECT notebook, lower(frame) AS view_name, pos, col_name, src_ref, src_column, transform FROM fx_base_frame
 UNION ALL SELECT notebook, 'hidden', NULL, NULL, NULL, NULL, NULL FROM fx_notebook"""
_READS = """SELECT o_custkey AS notebook, concat('f', o_orderkey) AS out_frame, CASE o_orderkey % 4 WHEN 0 THEN 'L' WHEN 1 THEN 'global_temp.r' WHEN 2 THEN 'hidden' ELSE concat('t', o_custkey % 12) END AS raw,
 concat('ws0/lh_bronze/t', o_custkey % 12) AS ref FROM orders"""


@query("e14_read_view", f"""
WITH v AS ({_VIEWS}), r AS (SELECT *, lower(replace(raw, 'global_temp.', '')) AS k FROM ({_READS}) x)
SELECT r.notebook, r.out_frame AS frame, v.pos, v.col_name, v.src_ref, v.src_column, v.transform FROM r JOIN v ON v.notebook = r.notebook AND v.view_name = r.k WHERE v.col_name IS NOT NULL
UNION ALL SELECT r.notebook, r.out_frame, s.pos, s.name, s.ref, s.name, NULL FROM r JOIN fx_ref_schema s ON s.ref = r.ref WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.notebook = r.notebook AND v.view_name = r.k)""")
def _(f):
    return prov.source_frames(f.sql(_READS), f.sql(_VIEWS), f("fx_ref_schema"))


_FLAT = """walk AS (SELECT notebook, view_name, col_name, src_kind, src_name, src_column, transform FROM fx_view_col
 UNION SELECT w.notebook, w.view_name, w.col_name, v.src_kind, v.src_name, v.src_column, coalesce(w.transform, v.transform) FROM walk w
 JOIN fx_view_col v ON v.notebook = w.notebook AND v.view_name = w.src_name AND v.col_name = w.src_column WHERE w.src_kind = 'view'),
flat AS (SELECT DISTINCT notebook, view_name, col_name, src_name AS src_ref, src_column, transform FROM walk WHERE src_kind = 'table')"""


@query("e02_view_base_refs", f"WITH RECURSIVE {_FLAT} SELECT DISTINCT notebook, view_name, src_ref FROM flat")
def _(f):
    return prov.view_base_refs(prov.flatten_views(f("fx_view_col")))


@query("e15_flatten_views", f"WITH RECURSIVE {_FLAT} SELECT * FROM flat")
def _(f):
    return prov.flatten_views(f("fx_view_col"))


@query("e16_write_flows", f"""WITH RECURSIVE {_FLAT}
SELECT w.notebook, w.seq, w.target AS to_table, f.col_name AS to_column, nullif(CASE WHEN f.src_column = 'c1' THEN '' ELSE f.src_ref END, '') AS from_table, f.src_column AS from_column, f.transform
FROM fx_view_write w JOIN flat f ON f.notebook = w.notebook AND f.view_name = w.frame
WHERE NOT EXISTS (SELECT 1 FROM fx_view_col v WHERE v.notebook = w.notebook AND v.view_name = w.target)""")
def _(f):
    frames = prov.flatten_views(f("fx_view_col")).withColumnRenamed("view_name", "frame")
    frames = frames.withColumn("src_ref", F.when(F.col("src_column") == "c1", "").otherwise(F.col("src_ref")))
    return prov.write_flows(f("fx_view_write"), frames, f("fx_view_col"))


_FLOW_LOG = """SELECT l_orderkey AS run_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity) AS BIGINT) AS seq,
 concat('t', l_partkey % 3) AS to_table, concat('c', l_linenumber % 2) AS to_column, CASE WHEN l_suppkey % 3 > 0 THEN concat('s', l_suppkey % 3) END AS from_table, concat('c', l_linenumber % 3) AS from_column,
 concat('f', l_linenumber) AS transform FROM lineitem"""


@query("e17_dedupe_flows", f"""
SELECT run_id, seq, to_table, to_column, from_table, from_column, transform FROM
 (SELECT *, row_number() OVER (PARTITION BY run_id, to_table, to_column, from_table, from_column ORDER BY seq) AS n FROM ({_FLOW_LOG}) l) x WHERE n = 1""")
def _(f):
    return prov.dedupe_flows(f.sql(_FLOW_LOG), ["run_id"], ["seq"])


@query("e18_prefer_sql_targets", """
WITH o AS (SELECT *, (run_id + seq) % 3 = 0 AS by_sql FROM fx_column_flow)
SELECT run_id, seq, to_table, to_column, from_table, from_column, transform FROM o
WHERE by_sql OR NOT EXISTS (SELECT 1 FROM o s WHERE s.by_sql AND s.run_id = o.run_id AND s.to_table = o.to_table)""")
def _(f):
    flow, by_sql = f("fx_column_flow"), (F.col("run_id") + F.col("seq")) % 3 == 0
    return prov.prefer_sql_targets(flow.filter(by_sql), flow.filter(~by_sql), ["run_id"])


_GIVEN = """SELECT run_id, ref, CAST(row_number() OVER (PARTITION BY run_id, ref ORDER BY name) AS INT) AS pos, name, 'string' AS type FROM
 (SELECT DISTINCT run_id, from_table AS ref, from_column AS name FROM fx_column_flow WHERE from_table IS NOT NULL) g"""


@query("e19_fill_written_schema", f"""
WITH g AS ({_GIVEN}), o AS (SELECT run_id, to_table AS ref, to_column AS name, min(seq) AS seq FROM fx_column_flow GROUP BY run_id, to_table, to_column)
SELECT run_id, ref, pos, name, type FROM g UNION ALL SELECT run_id, ref, row_number() OVER (PARTITION BY run_id, ref ORDER BY seq, name), name, NULL FROM o
WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.run_id = o.run_id AND g.ref = o.ref)""")
def _(f):
    outputs = f("fx_column_flow").selectExpr("run_id", "to_table AS ref", "seq", "to_column AS name")
    return prov.fill_written_schema(f.sql(_GIVEN), outputs, ["run_id"])


_MERGES = "SELECT DISTINCT run_id, to_table AS target, from_table AS source FROM fx_column_flow WHERE from_table IS NOT NULL"


@query("e20_merge_star_flows", f"""
WITH m AS ({_MERGES}), g AS ({_GIVEN})
SELECT DISTINCT m.run_id, m.target AS to_table, s.name AS to_column, m.source AS from_table, s.name AS from_column, CAST(NULL AS VARCHAR) AS transform FROM m JOIN g s ON s.run_id = m.run_id AND s.ref = m.source
WHERE NOT EXISTS (SELECT 1 FROM g t WHERE t.run_id = m.run_id AND t.ref = m.target) OR EXISTS (SELECT 1 FROM g t WHERE t.run_id = m.run_id AND t.ref = m.target AND t.name = s.name)""")
def _(f):
    return prov.merge_star_flows(f.sql(_MERGES), f.sql(_GIVEN), ["run_id"])


_ALIASES = "SELECT DISTINCT l_orderkey AS run_id, 's' AS alias, concat('ws0/lh/t', l_orderkey % 9) AS ref FROM lineitem"


@query("e21_merge_assign_flows", f"""
WITH a AS ({_ALIASES})
SELECT DISTINCT l.l_orderkey AS run_id, concat('g', l_partkey % 4) AS to_table, 'a' AS to_column, a.ref AS from_table, concat('c', l_suppkey % 5) AS from_column, CAST(NULL AS VARCHAR) AS transform FROM lineitem l JOIN a ON a.run_id = l.l_orderkey WHERE l_linenumber <> 7
UNION SELECT DISTINCT l_orderkey, concat('g', l_partkey % 4), 'b', NULL, concat('d', l_linenumber), concat('upper(d', l_linenumber, ')') FROM lineitem WHERE l_linenumber <> 7""")
def _(f):
    clauses = f("lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("g"), F.col("l_partkey") % 4).alias("target"),
        F.when(F.col("l_linenumber") == 7, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("columns"),
        F.array(
            F.named_struct(F.lit("alias"), F.lit("s"), F.lit("column"), F.concat(F.lit("c"), F.col("l_suppkey") % 5), F.lit("transform"), F.lit(None).cast("string")),
            F.named_struct(F.lit("alias"), F.lit(None).cast("string"), F.lit("column"), F.concat(F.lit("d"), F.col("l_linenumber")),
                           F.lit("transform"), F.concat(F.lit("upper(d"), F.col("l_linenumber"), F.lit(")"))),
        ).alias("values"),
    )
    return prov.merge_assign_flows(clauses, f.sql(_ALIASES), ["run_id"])


for _keep in (False, True):
    _else = "CASE WHEN from_column <> to_column THEN concat(from_column, ' AS ', to_column) END" if _keep else "NULL"

    @query(f"e22_{'keep_renames' if _keep else 'plain_or_transform'}", f"""
    SELECT run_id, seq, to_column, from_column, CASE WHEN (run_id + seq) % 2 = 0 THEN {_else} ELSE transform END AS transform FROM fx_column_flow""")
    def _(f, keep=_keep):
        flow = f("fx_column_flow").select("run_id", "seq", "to_column", "from_column", "transform")
        return prov.plain_or_transform(flow.withColumn("is_bare_column", (F.col("run_id") + F.col("seq")) % 2 == 0), keep)


@query("e23_resolve_unowned", """
WITH rd AS (SELECT run_id, ref FROM fx_access GROUP BY run_id, ref HAVING max(mode) = 'read'),
own AS (SELECT s.run_id, s.name, min(s.ref) AS ref FROM fx_table_schema s JOIN rd ON rd.run_id = s.run_id AND rd.ref = s.ref GROUP BY s.run_id, s.name HAVING count(*) = 1)
SELECT run_id, seq, to_table, to_column, from_table, from_column, transform FROM fx_column_flow WHERE from_table IS NOT NULL
UNION ALL SELECT f.run_id, f.seq, f.to_table, f.to_column, o.ref, f.from_column, f.transform FROM fx_column_flow f JOIN own o ON o.run_id = f.run_id AND o.name = f.from_column WHERE f.from_table IS NULL""")
def _(f):
    return prov.resolve_unowned(f("fx_column_flow"), f("fx_table_schema"), reports.run_access(f("fx_access")), ["run_id"])


_STEPS = "SELECT DISTINCT run_id, ref, step_seq FROM (SELECT run_id, reads_ref AS ref, seq AS step_seq FROM fx_entry UNION ALL SELECT run_id, writes_ref, seq FROM fx_entry WHERE writes_ref IS NOT NULL) s"
_SETS = "SELECT run_id, writes_ref AS ref, seq AS step_seq, concat('c', seq) AS columns FROM fx_entry WHERE writes_ref IS NOT NULL"


@query("e24_carry_schemas", f"""
WITH s AS ({_STEPS}), c AS ({_SETS}),
j AS (SELECT s.run_id, s.ref, s.step_seq, c.columns, (SELECT arg_max(e.columns, e.step_seq) FROM c e WHERE e.run_id = s.run_id AND e.ref = s.ref AND e.step_seq < s.step_seq) AS carried
 FROM s LEFT JOIN c ON c.run_id = s.run_id AND c.ref = s.ref AND c.step_seq = s.step_seq)
SELECT run_id, ref, step_seq, coalesce(columns, carried) AS columns, CASE WHEN columns IS NOT NULL THEN 'fetched' WHEN carried IS NOT NULL THEN 'carried' ELSE 'unknown' END AS origin FROM j""")
def _(f):
    return prov.carry_schemas(f.sql(_STEPS), f.sql(_SETS), ["run_id"])


@query("e25_schema_resolution", """
WITH q AS (SELECT run_id, ref FROM fx_access WHERE mode = 'read'),
fetched AS (SELECT DISTINCT run_id, ref FROM fx_schema_request WHERE state = 'resolved'), carried AS (SELECT DISTINCT run_id, to_table AS ref FROM fx_column_flow),
fail AS (SELECT run_id, ref, min(failure) AS failure FROM fx_schema_request WHERE failure IS NOT NULL GROUP BY run_id, ref)
SELECT q.run_id, q.ref, CASE WHEN f.ref IS NOT NULL THEN 'resolved' WHEN c.ref IS NOT NULL THEN 'carried' ELSE 'unresolved' END AS state, x.failure
FROM q LEFT JOIN fetched f ON f.run_id = q.run_id AND f.ref = q.ref LEFT JOIN carried c ON c.run_id = q.run_id AND c.ref = q.ref LEFT JOIN fail x ON x.run_id = q.run_id AND x.ref = q.ref""")
def _(f):
    requests = f("fx_schema_request")
    return prov.schema_resolution(
        f("fx_access").filter("mode = 'read'"), requests.filter("state = 'resolved'"),
        f("fx_column_flow").select("run_id", F.col("to_table").alias("ref")), requests.filter("failure IS NOT NULL"), ["run_id"])
