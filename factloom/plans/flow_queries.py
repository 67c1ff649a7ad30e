"""Registered queries for sources, activities and the flow graph, each with its check."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import refs
from factloom.operators import activities, graph, model, reports
from factloom.plans.registry import query
from factloom.session import cut_lineage, scratch_path
from factloom.sources import catalog, definitions, delta_log, notebooks, tables

RUN_ACCESS = "ra AS (SELECT run_id, ref, max(mode) AS mode FROM fx_access GROUP BY run_id, ref)"

# -- graph ---------------------------------------------------------------------

_DEPTH = """walk AS (SELECT pipeline_id, name, 0 AS d FROM fx_activity
 UNION SELECT e.pipeline_id, e.name, w.d + 1 FROM walk w JOIN fx_activity_dep e ON e.pipeline_id = w.pipeline_id AND e.depends_on = w.name),
deep AS (SELECT pipeline_id, name, max(d) AS depth FROM walk GROUP BY pipeline_id, name)"""


@query("g01_longest_path_depth", f"WITH RECURSIVE {_DEPTH} SELECT pipeline_id, name AS id, depth FROM deep")
def _(f):
    nodes = f("fx_activity").select("pipeline_id", F.col("name").alias("id"))
    edges = f("fx_activity_dep").select("pipeline_id", F.col("depends_on").alias("src"), F.col("name").alias("dst"))
    return graph.longest_path_depth(nodes, edges, ["pipeline_id"])


_TABLE_EDGES = "SELECT DISTINCT from_table AS src, to_table AS dst FROM fx_column_flow WHERE from_table IS NOT NULL"


@query("g01_table_depth", f"""
WITH RECURSIVE e AS ({_TABLE_EDGES}), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
walk AS (SELECT id, 0 AS d FROM n UNION SELECT e.dst, w.d + 1 FROM walk w JOIN e ON e.src = w.id)
SELECT id, max(d) AS depth FROM walk GROUP BY id""")
def _(f):
    edges = f.sql(_TABLE_EDGES)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return graph.longest_path_depth(nodes, edges, [])


@query("g02_collect_schemas", """
WITH o AS (SELECT t.ref, t.name, t.type, dense_rank() OVER (PARTITION BY t.ref ORDER BY s.at, t.run_id) AS k FROM fx_table_schema t JOIN fx_step_run s ON s.run_id = t.run_id)
SELECT DISTINCT ref, name, type FROM o WHERE k = 1""")
def _(f):
    return graph.collect_schemas(f("fx_table_schema"), f("fx_step_run"))


@query("g03_lakehouse_cards", """
SELECT concat('lh:', lower(split_part(ref, '/', 1)), '/', lower(split_part(ref, '/', 2))) AS card, count(DISTINCT ref) AS tables FROM fx_access GROUP BY 1""")
def _(f):
    return graph.lakehouse_cards(f("fx_access"))


@query("g04_access_edges", f"""
WITH {RUN_ACCESS}, c AS (SELECT *, concat('lh:', split_part(ref, '/', 1), '/', split_part(ref, '/', 2)) AS card, concat('s:', run_id) AS step FROM ra),
x AS (SELECT c.*, CAST(NULL AS VARCHAR) AS "column", 'table' AS kind FROM c UNION ALL SELECT c.*, t.name, 'column' FROM c JOIN fx_table_schema t ON t.run_id = c.run_id AND t.ref = c.ref)
SELECT run_id, CASE WHEN mode = 'read' THEN card ELSE step END AS source, CASE WHEN mode = 'read' THEN step ELSE card END AS target, mode AS tone, kind, "column", concat(mode, '|', step, '|', ref) AS "group" FROM x""")
def _(f):
    return graph.access_edges(reports.run_access(f("fx_access")), f("fx_table_schema"), ["run_id"])


@query("g05_hop_rows", f"""
WITH {RUN_ACCESS}, l AS (SELECT run_id, mode, ref, split_part(ref, '/', 3) AS label FROM ra),
u AS (SELECT run_id, mode, label, min(ref) AS ref FROM l GROUP BY run_id, mode, label),
h AS (SELECT r.run_id, r.t || ' → ' || w.t AS label FROM (SELECT run_id, string_agg(label, ', ' ORDER BY ref) AS t FROM u WHERE mode = 'read' GROUP BY run_id) r
 JOIN (SELECT run_id, string_agg(label, ', ' ORDER BY ref) AS t FROM u WHERE mode = 'write' GROUP BY run_id) w ON w.run_id = r.run_id)
SELECT run_id, 'hop' AS tone, label FROM h UNION ALL SELECT DISTINCT ra.run_id, 'col', t.name FROM ra JOIN fx_table_schema t ON t.run_id = ra.run_id AND t.ref = ra.ref WHERE ra.run_id IN (SELECT run_id FROM h)""")
def _(f):
    return graph.hop_rows(reports.run_access(f("fx_access")), f("fx_table_schema"), ["run_id"])


_UNITS = """u AS (SELECT run_id, concat('s:', run_id, ':a', seq - 1) AS id, replace(string_split(name, ' / ')[-1], 'run ', '') AS label, seq AS badge FROM fx_entry)"""


@query("g06_split_units", f"WITH {_UNITS} SELECT * FROM u")
def _(f):
    return graph.split_units(f("fx_entry"), ["run_id"])


@query("g07_order_edges", f"WITH {_UNITS} SELECT a.run_id, a.id AS source, b.id AS target FROM u a JOIN u b ON b.run_id = a.run_id AND b.badge = a.badge + 1")
def _(f):
    return graph.order_edges(graph.split_units(f("fx_entry"), ["run_id"]), ["run_id"])


@query("g08_cross_workspace_access", """
SELECT a.run_id, a.mode, a.ref, split_part(a.ref, '/', 1) AS workspace FROM fx_access a JOIN fx_step_run s ON s.run_id = a.run_id WHERE split_part(a.ref, '/', 1) <> s.workspace""")
def _(f):
    return graph.cross_workspace_access(f("fx_access"), f("fx_step_run"), ["run_id"])


_RANK = "CASE split_part(ref, '/', 2) WHEN 'lh_landing' THEN 0 WHEN 'lh_bronze' THEN 3 WHEN 'lh_silver' THEN 4 WHEN 'lh_gold' THEN 5 ELSE -1 END"
_STAGED = f"""rk AS (SELECT run_id, mode, ref, seq, {_RANK} AS rank FROM fx_touch),
st AS (SELECT run_id, 'table' AS kind, ref AS id, rank, min(seq) AS at_ FROM rk GROUP BY run_id, ref, rank UNION ALL
 SELECT run_id, 'step', 'step', coalesce(arg_min(rank, seq) FILTER (mode = 'write' AND rank >= 0), arg_min(rank, seq) FILTER (mode = 'read' AND rank >= 0), -1), -1 FROM rk GROUP BY run_id)"""


@query("g09_stage_of", f"WITH {_STAGED} SELECT run_id, kind, id, rank FROM st")
def _(f):
    return graph.stage_of(f("fx_touch"), ["run_id"]).drop("at")


@query("g10_medallion_bands", f"""
WITH {_STAGED}
SELECT run_id, kind, id, dense_rank() OVER (PARTITION BY run_id ORDER BY CASE WHEN rank < 0 THEN 99 ELSE rank END) AS band,
 CASE rank WHEN 0 THEN 'Landing' WHEN 3 THEN 'Bronze' WHEN 4 THEN 'Silver' WHEN 5 THEN 'Gold' ELSE 'Unstaged' END AS stage,
 row_number() OVER (PARTITION BY run_id, rank ORDER BY kind = 'table', at_, id) AS position FROM st""")
def _(f):
    return graph.medallion_bands(graph.stage_of(f("fx_touch"), ["run_id"]), ["run_id"])


_LOOSE = "SELECT run_id, seq, mode, CASE WHEN run_id % 3 = 0 THEN substr(ref, 4) WHEN run_id % 7 = 0 THEN concat('//', ref) ELSE ref END AS ref FROM fx_touch"
_OWN = "SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'wsX' ELSE '' END AS workspace FROM fx_step_run"
_OWNERS = f"""ac AS ({_LOOSE}), p AS (SELECT DISTINCT run_id, ref, split_part(ref, '/', 1) AS w, split_part(ref, '/', 2) AS l FROM ac),
fw AS (SELECT run_id, arg_min(ref, (seq, ref)) AS ref FROM ac WHERE mode = 'write' GROUP BY run_id),
ow AS (SELECT run_id, 'table' AS kind, ref AS id, CASE WHEN w <> '' THEN w WHEN l <> '' THEN concat('lh:', l) ELSE '' END AS owner FROM p
 UNION ALL SELECT o.run_id, 'step', 'step', CASE WHEN workspace <> '' THEN workspace WHEN split_part(fw.ref, '/', 2) <> '' THEN concat('lh:', split_part(fw.ref, '/', 2)) ELSE '' END FROM ({_OWN}) o LEFT JOIN fw ON fw.run_id = o.run_id)"""
# What a run reads only comes before its step, what it writes after it.
_TOUCHED = "SELECT run_id, ref, max(mode) AS mode, min(seq) AS seq FROM loose GROUP BY run_id, ref"


@query("g11_owner_of", f"WITH {_OWNERS} SELECT run_id, kind, id, owner FROM ow")
def _(f):
    return graph.owner_of(f.sql(_LOOSE), f.sql(_OWN), ["run_id"])


@query("g12_owner_order", f"""
WITH {_OWNERS}, loose AS ({_LOOSE}), tc AS ({_TOUCHED}), sd AS (SELECT run_id, max(CASE WHEN mode = 'read' THEN 1 ELSE 0 END) AS d FROM tc GROUP BY run_id),
pl AS (SELECT tc.run_id, 'table' AS kind, ref AS id, CASE WHEN mode = 'write' THEN d + 1 ELSE 0 END AS depth, seq AS at_ FROM tc JOIN sd ON sd.run_id = tc.run_id UNION ALL SELECT run_id, 'step', 'step', d, 0 FROM sd),
n AS (SELECT ow.run_id, owner, min(coalesce(depth, 0)) AS depth, min(coalesce(at_, 0)) AS at_, bool_or(ow.kind = 'step') AS runs, bool_or(ow.kind = 'table') AS tabs
 FROM ow LEFT JOIN pl ON pl.run_id = ow.run_id AND pl.kind = ow.kind AND pl.id = ow.id GROUP BY ow.run_id, owner),
a AS (SELECT *, count(*) OVER (PARTITION BY run_id) = 1 AS alone FROM n),
r AS (SELECT *, unnest(CASE WHEN alone AND runs AND tabs THEN ['runs', 'tables'] ELSE ['all'] END) AS role FROM a)
SELECT run_id, owner, role, row_number() OVER (PARTITION BY run_id ORDER BY runs DESC, owner = '', depth, at_, role) AS position FROM r""")
def _(f):
    """Owners placed by the depth of the run's own graph and by first touch."""
    loose = f.sql(_LOOSE)
    owned = graph.owner_of(loose, f.sql(_OWN), ["run_id"])
    touched = cut_lineage(loose.groupBy("run_id", "ref").agg(F.max("mode").alias("mode"), F.min("seq").alias("at")))
    table, step = F.concat(F.lit("t:"), F.col("ref")), F.lit("step")
    nodes = touched.select("run_id", table.alias("id"), "at").unionByName(
        f.sql(_OWN).select("run_id", step.alias("id"), F.lit(0).cast("bigint").alias("at")))
    reads = F.col("mode") == "read"
    edges = touched.select("run_id", F.when(reads, table).otherwise(step).alias("src"), F.when(reads, step).otherwise(table).alias("dst"))
    placed = graph.longest_path_depth(nodes, edges, ["run_id"])
    own = owned.withColumn("node", F.when(F.col("kind") == "table", F.concat(F.lit("t:"), F.col("id"))).otherwise(step))
    both = own.join(placed.withColumnRenamed("id", "node"), ["run_id", "node"], "left")
    return graph.owner_order(both.withColumns({"depth": F.coalesce("depth", F.lit(0)), "at": F.coalesce("at", F.lit(0))}), ["run_id"])


_ROWS = """SELECT o_custkey % 100 AS card, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('t', o_custkey % 3) END AS "group", o_orderkey AS pos, concat('c', o_orderkey) AS label FROM orders"""


@query("g13_truncate_rows", f"""
WITH r AS ({_ROWS}), n AS (SELECT *, row_number() OVER (PARTITION BY card, "group" ORDER BY pos) AS place, CASE WHEN "group" = '' THEN 8 ELSE 5 END AS cap, count(*) OVER (PARTITION BY card, "group") AS total FROM r)
SELECT card, "group", place, label FROM n WHERE place <= cap UNION ALL SELECT DISTINCT card, "group", cap + 1, concat('+', total - cap, ' more') FROM n WHERE total > cap""")
def _(f):
    return graph.truncate_rows(f.sql(_ROWS.replace('"group"', "`group`")), ["card"])


# -- activities ----------------------------------------------------------------


def _copies(f):
    """Definition parts, one document of three activities per row of lineitem."""
    def text(value):
        return value if not isinstance(value, str) else F.lit(value)

    def obj(**fields):
        return F.struct(*[text(v).alias(k) for k, v in fields.items()])

    line, part = F.col("l_linenumber"), F.col("l_partkey")
    guid = F.concat(F.lpad((F.col("l_suppkey") % 120).cast("string"), 8, "0"), F.lit("-00AA-0000-0000-"), F.lpad((F.col("l_suppkey") % 120).cast("string"), 12, "0"))
    service = obj(name="svc", properties=obj(typeProperties=obj(workspaceId=guid, artifactId=F.when(line % 2 == 0, guid))))
    source = obj(datasetSettings=obj(typeProperties=obj(table=F.when(line < 4, F.concat(F.lit("t"), part % 9)),
                                                        location=obj(fileName=F.when(line == 4, "in.csv"), folderPath=F.when(line == 5, " in ")))))
    sink = obj(datasetSettings=obj(typeProperties=obj(table=F.when(line != 7, F.concat(F.lit("s"), part % 5))), linkedService=service))
    mappings = F.array(
        obj(source=obj(name="id", path=F.lit(None).cast("string")), sink=obj(name="key", path=F.lit(None).cast("string"))),
        obj(source=obj(name=F.lit(None).cast("string"), path="$['customer']['city']"), sink=obj(name=" town ", path=F.lit(None).cast("string"))),
        obj(source=obj(name=F.lit(None).cast("string"), path=F.lit(None).cast("string")), sink=obj(name="x", path=F.lit(None).cast("string"))),
    )
    names = F.array(obj(referenceName="ds_in"))
    copy = obj(name="copy", type="Copy", typeProperties=obj(source=source, sink=sink, translator=obj(mappings=mappings)), inputs=names, outputs=F.array(obj(referenceName="ds_out")))
    note = obj(name="run nb", type="TridentNotebook", dependsOn=F.array(obj(activity="copy")), typeProperties=obj(notebookId=F.concat(F.lit("nb"), part % 7)))
    call = obj(name="call", dependsOn=F.array(F.lit("run nb"), F.lit("copy")), typeProperties=obj(pipeline=obj(referenceName=F.concat(F.lit("p"), part % 7)), workspaceId="W2"))
    listed = F.concat(F.lit("["), F.to_json(copy), F.lit(","), F.to_json(note), F.lit(","), F.to_json(call), F.lit(',{"type": "Wait"}]'))
    document = F.when(line == 6, F.concat(F.lit('{"activities": '), listed, F.lit("}"))).when(line == 7, F.lit("not json")).otherwise(
        F.concat(F.lit('{"properties": {"activities": '), listed, F.lit("}}")))
    keyed = f("lineitem").withColumn("document", document)
    return keyed.select(
        F.concat(F.lit("W"), F.col("l_orderkey") % 2).alias("workspace_id"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(15,2)").cast("string")).alias("pipeline_id"),
        F.lit("x/pipeline-content.json").alias("path"), F.base64(F.encode("document", "UTF-8")).alias("payload"))


_PID = "concat('W', l_orderkey % 2) AS workspace_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR)) AS pipeline_id"


@query("a03_read_definitions", f"""
WITH d AS (SELECT *, {_PID} FROM lineitem WHERE l_linenumber <> 7)
SELECT workspace_id, pipeline_id, 0 AS seq, 'copy' AS name, 'Copy' AS type, '' AS depends_on, CAST(NULL AS VARCHAR) AS notebook_id, CAST(NULL AS VARCHAR) AS child_pipeline_id, CAST(NULL AS VARCHAR) AS child_workspace_id FROM d
UNION ALL SELECT workspace_id, pipeline_id, 1, 'run nb', 'TridentNotebook', 'copy', concat('nb', l_partkey % 7), NULL, NULL FROM d
UNION ALL SELECT workspace_id, pipeline_id, 2, 'call', 'Unknown', 'run nb|copy', NULL, concat('p', l_partkey % 7), 'W2' FROM d""")
def _(f):
    read = definitions.read_definitions(_copies(f)).drop("properties", "inputs", "outputs")
    return read.withColumn("depends_on", F.array_join("depends_on", "|"))


_COPY_REFS = f"""d AS (SELECT *, {_PID}, concat(lpad(CAST(l_suppkey % 120 AS VARCHAR), 8, '0'), '-00AA-0000-0000-', lpad(CAST(l_suppkey % 120 AS VARCHAR), 12, '0')) AS guid FROM lineitem WHERE l_linenumber <> 7),
r AS (SELECT d.*, replace(coalesce(n.name, d.guid), '/', '%2F') AS known, CASE WHEN l_linenumber < 4 THEN concat('home//t', l_partkey % 9) WHEN l_linenumber = 4 THEN 'home//in.csv' WHEN l_linenumber = 5 THEN 'home//in' END AS source_ref
 FROM d LEFT JOIN fx_guid_name n ON n.guid = lower(d.guid)),
c AS (SELECT *, concat(known, '/', CASE WHEN l_linenumber % 2 = 0 THEN known ELSE 'svc' END, '/s', l_partkey % 5) AS sink_ref FROM r)"""


def _copy_refs(f):
    activity = definitions.read_definitions(_copies(f))
    return activities.dataset_refs(activity, f("fx_guid_name"), "home")


@query("f01_copy_lineage", f"""
WITH {_COPY_REFS}
SELECT workspace_id, pipeline_id, 'copy' AS name, 0 AS seq, sink_ref AS to_table, source_ref AS from_table, 'key' AS to_column, 'id' AS from_column, CAST(NULL AS VARCHAR) AS transform FROM c
UNION ALL SELECT workspace_id, pipeline_id, 'copy', 1, sink_ref, source_ref, 'town', 'city', NULL FROM c""")
def _(f):
    return activities.copy_lineage(_copy_refs(f))


@query("f01_copy_access", f"""
WITH {_COPY_REFS}
SELECT workspace_id, pipeline_id, 'copy' AS name, 'read' AS mode, coalesce(source_ref, 'home//ds_in') AS ref FROM c
UNION ALL SELECT workspace_id, pipeline_id, 'copy', 'write', sink_ref FROM c""")
def _(f):
    return activities.copy_access(_copy_refs(f), "home")


@query("f02_dataset_ref", f"WITH {_COPY_REFS} SELECT workspace_id, pipeline_id, source_ref, sink_ref FROM c")
def _(f):
    return _copy_refs(f).filter("name = 'copy'").select("workspace_id", "pipeline_id", "source_ref", "sink_ref")


@query("f03_declared_schema", """
WITH e AS (SELECT run_id, from_table AS ref, from_column AS name, seq * 2 AS k FROM fx_column_flow WHERE from_table IS NOT NULL UNION ALL SELECT run_id, to_table, to_column, seq * 2 + 1 FROM fx_column_flow),
m AS (SELECT run_id, ref, name, min(k) AS k FROM e GROUP BY run_id, ref, name)
SELECT run_id, ref, row_number() OVER (PARTITION BY run_id, ref ORDER BY k, name) AS pos, name FROM m""")
def _(f):
    return activities.declared_schema(f("fx_column_flow"), ["run_id"])


# Every customer owns one pipeline; each order is an activity and every third one
# invokes the pipeline of another customer, so that nesting, cycles and missing children occur.
_NESTED = """SELECT 'w' AS workspace_id, concat('p', pipeline_id) AS pipeline_id, CAST(idx AS INT) AS seq, name, type, CAST(NULL AS STRING) AS child_workspace_id,
 CASE WHEN type = 'ExecutePipeline' THEN concat('P', pipeline_id * 7 + idx) END AS child_pipeline_id FROM fx_activity"""
_NESTED_DEPS = "SELECT 'w' AS workspace_id, concat('p', pipeline_id) AS pipeline_id, name, depends_on FROM fx_activity_dep"


@query("f04_expand_activities", f"""
WITH RECURSIVE act AS ({_NESTED}),
walk AS (SELECT pipeline_id AS root, pipeline_id, name, type, child_pipeline_id, CAST([] AS VARCHAR[]) AS seen, 0 AS depth, [seq] AS path FROM act
 UNION ALL SELECT w.root, a.pipeline_id, w.name || ' / ' || a.name, a.type, a.child_pipeline_id, list_append(w.seen, lower(w.child_pipeline_id)), w.depth + 1, list_append(w.path, a.seq) FROM walk w
 JOIN act a ON lower(a.pipeline_id) = lower(w.child_pipeline_id) WHERE w.depth < 5 AND NOT list_contains(w.seen, lower(w.child_pipeline_id)))
SELECT 'w' AS workspace_id, root AS pipeline_id, array_to_string(path, '.') AS path, name, type FROM walk""")
def _(f):
    flat = activities.expand_activities(f.sql(_NESTED), f.sql(_NESTED_DEPS))[0]
    return flat.withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), "."))


def _nested_levels():
    """Dependencies level by level, from the deepest nesting (5) up, with the last activities of each instance."""
    invoke = "substr(prefix, 1, length(prefix) - 3)"
    for d in range(5, -1, -1):
        own = f"SELECT w.root, w.prefix, w.name_, w.prefix || e.depends_on AS dep FROM walk w JOIN dep e ON e.pipeline_id = w.pipeline_id AND e.name = w.name WHERE depth = {d}"
        yield f"raw{d} AS MATERIALIZED ({own})" if d == 5 else (
            f"raw{d} AS MATERIALIZED (SELECT r.root, r.prefix, r.name_, coalesce(t.leaf, r.dep) AS dep FROM ({own}) r LEFT JOIN tails{d + 1} t ON t.root = r.root AND t.invoke = r.dep)")
        yield f"here{d} AS MATERIALIZED (SELECT DISTINCT root, name_, dep FROM raw{d}" + (")" if not d else (
            f" UNION SELECT root, name_, {invoke} FROM walk w WHERE depth = {d} AND NOT EXISTS (SELECT 1 FROM raw{d} r WHERE r.root = w.root AND r.name_ = w.name_))"))
        if d:
            ends = f"SELECT root, prefix, name_ AS leaf FROM walk WHERE depth = {d}"
            waited = f"SELECT root, dep FROM here{d}"
            if d < 5:
                ends += f" UNION ALL SELECT t.root, w.prefix, t.leaf FROM tails{d + 1} t JOIN walk w ON w.depth = {d} AND w.root = t.root AND w.name_ = t.invoke"
                waited += f" UNION ALL SELECT root, dep FROM here{d + 1}"
            yield f"tails{d} AS MATERIALIZED (SELECT DISTINCT root, {invoke} AS invoke, leaf FROM ({ends}) c WHERE NOT EXISTS (SELECT 1 FROM ({waited}) h WHERE h.root = c.root AND h.dep = c.leaf))"


@query("f04_expand_dependencies", f"""
WITH RECURSIVE act AS ({_NESTED}), dep AS ({_NESTED_DEPS}),
walk AS (SELECT pipeline_id AS root, pipeline_id, name, name AS name_, '' AS prefix, child_pipeline_id, CAST([] AS VARCHAR[]) AS seen, 0 AS depth FROM act
 UNION ALL SELECT w.root, a.pipeline_id, a.name, w.name_ || ' / ' || a.name, w.name_ || ' / ', a.child_pipeline_id, list_append(w.seen, lower(w.child_pipeline_id)), w.depth + 1 FROM walk w
 JOIN act a ON lower(a.pipeline_id) = lower(w.child_pipeline_id) WHERE w.depth < 5 AND NOT list_contains(w.seen, lower(w.child_pipeline_id))),
{", ".join(_nested_levels())}
{" UNION ALL ".join(f"SELECT 'w' AS workspace_id, root AS pipeline_id, name_ AS name, dep AS depends_on FROM here{d}" for d in range(6))}""")
def _(f):
    return activities.expand_activities(f.sql(_NESTED), f.sql(_NESTED_DEPS))[1]


@query("f05_order_activities", "SELECT pipeline_id, name, idx, idx AS position FROM fx_activity")
def _(f):
    activity = f("fx_activity").select("pipeline_id", F.col("idx").cast("bigint").alias("idx"), "name")
    return activities.order_activities(activity, f("fx_activity_dep"), ["pipeline_id"])


_SHUFFLED = "SELECT pipeline_id, row_number() OVER (PARTITION BY pipeline_id ORDER BY md5(concat(name, pipeline_id))) AS idx, name FROM fx_activity"


@query("f05_order_shuffled", f"""
WITH RECURSIVE sh AS MATERIALIZED ({_SHUFFLED}),
need AS MATERIALIZED (SELECT s.pipeline_id, s.idx, s.name, list(d.idx) FILTER (d.idx IS NOT NULL) AS deps FROM sh s LEFT JOIN fx_activity_dep e ON e.pipeline_id = s.pipeline_id AND e.name = s.name
 LEFT JOIN sh d ON d.pipeline_id = e.pipeline_id AND d.name = e.depends_on GROUP BY s.pipeline_id, s.idx, s.name),
walk AS (SELECT DISTINCT pipeline_id, CAST([] AS BIGINT[]) AS done, CAST(0 AS BIGINT) AS position FROM sh
 UNION ALL SELECT w.pipeline_id, list_append(w.done, min(n.idx)), w.position + 1 FROM walk w JOIN need n ON n.pipeline_id = w.pipeline_id
 WHERE NOT list_contains(w.done, n.idx) AND list_has_all(w.done, coalesce(n.deps, [])) GROUP BY w.pipeline_id, w.done, w.position)
SELECT w.pipeline_id, n.name, n.idx, w.position FROM walk w JOIN need n ON n.pipeline_id = w.pipeline_id AND n.idx = w.done[-1] WHERE w.position > 0""")
def _(f):
    """The same activities listed in another order than they can run."""
    return activities.order_activities(f.sql(_SHUFFLED), f("fx_activity_dep"), ["pipeline_id"])


@query("f06_activity_after", "SELECT DISTINCT pipeline_id, name, depends_on AS after FROM fx_activity_dep")
def _(f):
    return activities.activity_after(f("fx_activity"), f("fx_activity_dep"), ["pipeline_id"])


@query("f06_activity_waves", f"""
WITH RECURSIVE {_DEPTH}, n AS (SELECT pipeline_id, name, count(*) AS n FROM fx_activity_dep GROUP BY pipeline_id, name)
SELECT a.pipeline_id, a.idx, a.name, a.type, d.depth + 1 AS wave, count(*) OVER (PARTITION BY a.pipeline_id, d.depth) > 1 AS concurrent, coalesce(n.n, 0) AS after
FROM fx_activity a JOIN deep d ON d.pipeline_id = a.pipeline_id AND d.name = a.name LEFT JOIN n ON n.pipeline_id = a.pipeline_id AND n.name = a.name""")
def _(f):
    return activities.activity_waves(f("fx_activity"), f("fx_activity_dep"), ["pipeline_id"])


@query("f07_activity_type_label", """
SELECT pipeline_id, idx, CASE type WHEN 'Copy' THEN 'Copy data' WHEN 'TridentNotebook' THEN 'Notebook' WHEN 'ExecutePipeline' THEN 'Pipeline' ELSE type END AS label FROM fx_activity""")
def _(f):
    return f("fx_activity").select("pipeline_id", "idx", activities.activity_type_label(F.col("type")).alias("label"))


_ENTRY_ACCESS = """SELECT run_id, seq, 'read' AS mode, reads_ref AS ref FROM fx_entry UNION ALL SELECT run_id, seq, 'write', writes_ref FROM fx_entry WHERE writes_ref IS NOT NULL"""
_ENTRY_SCHEMA = """SELECT run_id, seq, writes_ref AS ref, concat('c', seq) AS name FROM fx_entry WHERE writes_ref IS NOT NULL UNION ALL SELECT run_id, seq, writes_ref, 'id' FROM fx_entry WHERE writes_ref IS NOT NULL"""


@query("f08_combine_access", f"SELECT run_id, mode, ref, min(seq) AS first_seq FROM ({_ENTRY_ACCESS}) a GROUP BY run_id, mode, ref")
def _(f):
    return activities.combine_access(f.sql(_ENTRY_ACCESS), ["run_id"])


_ENTRY_FLOW = """SELECT e.run_id, e.seq, p.pos, e.writes_ref AS to_table, concat('c', p.pos) AS to_column, e.reads_ref AS from_table, concat('s', e.seq) AS from_column
 FROM fx_entry e CROSS JOIN (SELECT 1 AS pos UNION ALL SELECT 2) p WHERE e.writes_ref IS NOT NULL"""


@query("f08_combine_flows", f"SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq, pos) AS position FROM ({_ENTRY_FLOW}) x")
def _(f):
    return activities.combine_flows(f.sql(_ENTRY_FLOW), ["run_id"])


@query("f08_combine_schemas", f"""
SELECT run_id, ref, seq, name FROM (SELECT *, max(seq) OVER (PARTITION BY run_id, ref) AS last FROM ({_ENTRY_SCHEMA}) s) x WHERE seq = last""")
def _(f):
    return activities.combine_schemas(f.sql(_ENTRY_SCHEMA), ["run_id"])


@query("f09_combined_status", """
SELECT run_id, bool_and(ok) AS ok, CASE WHEN bool_and(ok) THEN 'ok' ELSE 'error' END AS status,
 CASE WHEN NOT bool_and(ok) THEN concat(count(*) FILTER (NOT ok), ' of ', count(*), ' notebook activities failed') END AS error FROM fx_entry GROUP BY run_id""")
def _(f):
    return activities.combine_status(f("fx_entry"), ["run_id"])


# -- sources and sinks -----------------------------------------------------------


def _notebook_files(f):
    """One notebook document per order: list and string sources, prose, magics, a bad one now and then."""
    k = F.col("o_orderkey")
    cells = F.to_json(F.array(
        F.struct(F.lit("code").alias("cell_type"), F.concat(F.lit("a = "), k).alias("source")),
        F.struct(F.lit("markdown").alias("cell_type"), F.lit("# prose").alias("source")),
        F.struct(F.lit("code").alias("cell_type"), F.concat(F.lit("%%sql\nSELECT "), k).alias("source")),
        F.struct(F.lit("code").alias("cell_type"), F.concat(F.lit("%%pyspark\nb = "), k, F.lit("\n")).alias("source")),
        F.struct(F.lit("code").alias("cell_type"), F.lit("%%configure\nx").alias("source")),
    ))
    listed = F.concat(F.lit('{"cell_type": "code", "metadata": {"language": "python"}, "source": ["c = 1\\n", "d = '), k, F.lit('"]}'))
    scala = F.lit('{"cell_type": "code", "metadata": {"language": "scala"}, "source": "val x = 1"}')
    content = (
        F.when(k % 10 == 7, F.lit("{ broken"))
        .when(k % 10 == 8, F.lit('{"metadata": {}}'))
        .when(k % 10 == 9, F.lit('{"cells": [{"cell_type": "markdown", "source": "only prose"}]}'))
        .otherwise(F.concat(F.lit('{"cells": ['), F.substr("_cells", F.lit(2)), F.lit(", "), listed, F.lit(", "), scala, F.lit("]}")))
    )
    # The generated array text loses its brackets to take two more cells.
    return f("orders").withColumn("_cells", F.regexp_replace(cells, r"\]$", "")).select(F.concat(F.lit("nb_"), k).alias("file"), content.alias("content"))


@query("a01_read_notebooks", """
WITH o AS (SELECT concat('nb_', o_orderkey) AS file, o_orderkey AS k FROM orders WHERE o_orderkey % 10 < 7)
SELECT file, 0 AS cell_index, concat('a = ', k) AS source FROM o UNION ALL SELECT file, 2, concat('%%sql', chr(10), 'SELECT ', k) FROM o
UNION ALL SELECT file, 3, concat('b = ', k) FROM o UNION ALL SELECT file, 5, concat('c = 1', chr(10), 'd = ', k) FROM o""")
def _(f):
    return notebooks.parse_notebooks(_notebook_files(f))


@query("a01b_notebook_errors", """
SELECT concat('nb_', o_orderkey) AS file, CASE o_orderkey % 10 WHEN 7 THEN 'not valid JSON' WHEN 8 THEN 'no cells array, so not a notebook' ELSE 'no code cells to analyse' END AS error FROM orders WHERE o_orderkey % 10 >= 7""")
def _(f):
    return notebooks.notebook_errors(_notebook_files(f))


def _log_lines(f):
    """Two commits per order's table; the second one changes the schema for some."""
    k = F.col("o_orderkey")
    base = F.lit('{"type":"struct","fields":[{"name":"id","type":"long"},{"name":"tags","type":{"type":"array","elementType":"string"}}]}')
    wide = F.lit('{"type":"struct","fields":[{"name":"id","type":"string"},{"name":"total","type":"double"}]}')

    def line(schema):
        return F.to_json(F.struct(F.struct(schema.alias("schemaString")).alias("metaData")))

    commits = F.array(
        F.struct(F.lit(0).alias("v"), F.lit('{"commitInfo":{}}').alias("value")),
        F.struct(F.lit(0).alias("v"), line(base).alias("value")),
        F.struct(F.lit(12).alias("v"), F.when(k % 3 == 0, line(wide)).otherwise('{"add":{}}').alias("value")),
    )
    return f("orders").select("o_orderkey", F.inline(commits)).select(
        F.format_string("/lake/Tables/t%d/_delta_log/%020d.json", "o_orderkey", F.col("v").cast("bigint")).alias("file"), "value")


_FIRST = "SELECT concat('/lake/Tables/t', o_orderkey) AS table_path, unnest([1, 2]) AS pos, unnest(['id', 'tags']) AS name, unnest(['long', 'array']) AS type FROM orders"


@query("a04_delta_schemas", f"""
{_FIRST} WHERE o_orderkey % 3 <> 0 UNION ALL SELECT concat('/lake/Tables/t', o_orderkey), unnest([1, 2]), unnest(['id', 'total']), unnest(['string', 'double']) FROM orders WHERE o_orderkey % 3 = 0""")
def _(f):
    return delta_log.table_schemas(_log_lines(f))


@query("a04_delta_schemas_first", _FIRST)
def _(f):
    return delta_log.table_schemas(_log_lines(f), latest=False)


@query("a04_delta_checkpoints", """
SELECT concat('/lake/Tables/t', o_orderkey) AS table_path, unnest([1, 2]) AS pos, unnest(['id', CASE WHEN o_orderkey % 3 = 0 THEN 'total' ELSE 'tags' END]) AS name,
 unnest([CASE WHEN o_orderkey % 3 = 0 THEN 'string' ELSE 'long' END, CASE WHEN o_orderkey % 3 = 0 THEN 'double' ELSE 'array' END]) AS type FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT concat('/lake/Tables/t', o_orderkey), 1, 'late', 'string' FROM orders WHERE o_orderkey % 4 = 1""")
def _(f):
    """Every second table has a checkpoint of version 12 and no commit before it, every fourth another schema in a commit after one."""
    lines, k = _log_lines(f), F.regexp_extract("file", r"/t(\d+)/", 1).cast("bigint")
    at, entry = F.regexp_extract("file", r"(\d+)\.json$", 1).cast("bigint"), F.contains("value", F.lit("metaData"))
    newest = lines.filter(entry).groupBy(F.regexp_replace("file", r"\d+\.json$", "").alias("log")).agg(F.max_by("value", at).alias("value"))
    held = newest.withColumn("file", F.concat("log", F.lit(f"{12:020d}.checkpoint.{1:010d}.{2:010d}.parquet"))).filter(k % 2 == 0)
    changed = F.lit('{"metaData":{"schemaString":"{\\"type\\":\\"struct\\",\\"fields\\":[{\\"name\\":\\"late\\",\\"type\\":\\"string\\"}]}"}}')
    later = newest.filter(F.regexp_extract("log", r"/t(\d+)/", 1).cast("bigint") % 4 == 1).select(
        F.concat("log", F.lit(f"{20:020d}.json")).alias("file"), changed.alias("value"))
    return delta_log.table_schemas(held.select("file", "value").unionByName(later))


_ITEMS = """SELECT p_partkey AS id, p_name AS displayName, CASE p_size % 4 WHEN 0 THEN 'Notebook' WHEN 1 THEN 'Lakehouse' WHEN 2 THEN 'DataPipeline' ELSE 'Report' END AS type,
 p_brand AS folderId, p_type AS description FROM part"""


@query("a05_catalog_items", f"""
SELECT id, displayName AS name, type, folderId AS folder_id, description, CASE type WHEN 'Notebook' THEN 'notebooks' WHEN 'Lakehouse' THEN 'lakehouses' ELSE 'others' END AS bucket FROM ({_ITEMS}) i""")
def _(f):
    return catalog.catalog_items(f.sql(_ITEMS))


_SPACES = "SELECT concat('ID-', s_suppkey) AS id, s_name AS name, s_suppkey AS written FROM supplier"
_NAMED = "SELECT concat('id-', o_custkey % 500) AS id, concat('item ', o_orderkey) AS name, o_orderkey AS written FROM orders"


@query("a06_name_map", f"""
SELECT lower(id) AS guid, arg_max(name, p * 1000000000 + written) AS name FROM (SELECT *, 0 AS p FROM ({_SPACES}) s UNION ALL SELECT *, 1 FROM ({_NAMED}) n) u GROUP BY lower(id)""")
def _(f):
    return catalog.name_map(f.sql(_SPACES), f.sql(_NAMED))


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"

for _format in ("parquet", "orc", "json", "csv", "xml"):

    @query(f"a07_read_{_format}", _CUSTOMER)
    def _(f, format=_format):
        options = {"rowTag": "row"} if format == "xml" else {}
        frame, path = f.sql(_CUSTOMER), scratch_path(f.spark, format)
        frame.write.format(format).options(**options).save(path)
        return tables.read_table(f.spark, path, format, schema=frame.schema, **options)


@query("a07_read_text", "SELECT c_name AS value FROM customer")
def _(f):
    path = scratch_path(f.spark, "text")
    f("customer").select("c_name").write.text(path)
    return tables.read_table(f.spark, path, "text")


_EXPORT = """SELECT s.name AS step, f.from_table, f.from_column, f.to_table, f.to_column, CASE WHEN f.transform IS NOT NULL THEN concat('concat(a, "', f.seq, '")') END AS transform
 FROM fx_column_flow f JOIN fx_step_run s ON s.run_id = f.run_id"""


@query("a08_column_lineage_csv", f"""
SELECT concat_ws(',', step, coalesce(from_table, ''), from_column, to_table, to_column, CASE WHEN transform IS NULL THEN '' ELSE concat('"', replace(transform, '"', '""'), '"') END) AS line, count(*) AS n FROM ({_EXPORT}) e GROUP BY 1""")
def _(f):
    path = scratch_path(f.spark, "csv")
    tables.write_column_lineage_csv(f.sql(_EXPORT), path)
    lines = f.spark.read.text(path).filter(F.col("value") != ",".join(tables.FLOW_COLUMNS))
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("a09_save_run", """
SELECT fact, f.run_id, f.name, detail, strftime(s.at, '%Y-%m') AS run_date FROM (SELECT 'access' AS fact, run_id, ref AS name, mode AS detail FROM fx_access
 UNION ALL SELECT 'table_schema', run_id, ref, name FROM fx_table_schema UNION ALL SELECT 'column_flow', run_id, to_table, to_column FROM fx_column_flow) f JOIN fx_step_run s ON s.run_id = f.run_id""")
def _(f):
    path = scratch_path(f.spark, "runs")
    dates = f("fx_step_run").select("run_id", F.date_format("at", "yyyy-MM").alias("run_date"))
    facts = {"access": ["run_id", "ref", "mode"], "table_schema": ["run_id", "ref", "name"], "column_flow": ["run_id", "to_table", "to_column"]}
    saved = {name: f(f"fx_{name}").join(dates, "run_id").select(*columns, "run_date") for name, columns in facts.items()}
    for half in (0, 1):
        tables.save_run({name: frame.filter(F.col("run_id") % 2 == half) for name, frame in saved.items()}, path, f"batch-{half}")
    parts = [tables.read_runs(f.spark, path, name, frame.schema).select(
        F.lit(name).alias("fact"), "run_id", F.col(facts[name][1]).alias("name"), F.col(facts[name][2]).alias("detail"), "run_date") for name, frame in saved.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a10_write_model", """
WITH t AS (SELECT run_id, ref FROM fx_access UNION SELECT run_id, ref FROM fx_table_schema UNION SELECT run_id, to_table FROM fx_column_flow UNION SELECT run_id, from_table FROM fx_column_flow WHERE from_table IS NOT NULL),
c AS (SELECT run_id, ref, name FROM fx_table_schema UNION SELECT run_id, to_table, to_column FROM fx_column_flow UNION SELECT run_id, from_table, from_column FROM fx_column_flow WHERE from_table IS NOT NULL)
SELECT 'root' AS part, run_id, concat('table:', ref) AS a, NULL AS b, NULL AS c FROM t
UNION ALL SELECT 'entity', run_id, concat('table:', ref), ref, 'table' FROM t UNION ALL SELECT 'entity', run_id, concat('col:', ref, ':', name), name, 'column' FROM c
UNION ALL SELECT 'entity_child', run_id, concat('table:', ref), concat('col:', ref, ':', name), NULL FROM c
UNION ALL SELECT 'transition', run_id, concat('col:', from_table, ':', from_column), concat('col:', to_table, ':', to_column), arg_max(coalesce(transform, ''), seq)
 FROM fx_column_flow WHERE from_table IS NOT NULL GROUP BY run_id, from_table, from_column, to_table, to_column""")
def _(f):
    """All four outputs, read back."""
    path = scratch_path(f.spark, "model")
    schema, flow, access = f("fx_table_schema"), f("fx_column_flow"), reports.run_access(f("fx_access"))
    entity = model.entities(schema, flow, access)
    parts = {
        "entity": (entity, ["id", "name", "kind"]), "entity_child": (model.entity_children(schema, flow), ["parent", "child", None]),
        "transition": (model.column_transitions(flow), ["source", "target", "transform"]), "root": (model.roots(entity), ["id", None, None])}
    tables.write_model(*(parts[p][0] for p in ("entity", "entity_child", "transition", "root")), path)
    out = None
    for part, (frame, columns) in parts.items():
        read = f.spark.read.schema(frame.schema).json(f"{path}/{part}")
        rows = read.select(F.lit(part).alias("part"), "run_id", *[
            (F.col(c) if c else F.lit(None).cast("string")).alias(name) for c, name in zip(columns, "abc")])
        out = rows if out is None else out.unionByName(rows)
    return out
