"""Pipeline activities: declared copy lineage, nested pipelines, run order, combined runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed
from factloom.functions import refs
from factloom.operators import graph, whole_graphs
from factloom.operators.ordering import number_rows
from factloom.session import Rounds, cut_lineage, growing

KEY = ["workspace_id", "pipeline_id"]

# -- copy lineage --------------------------------------------------------------


def _blank(value: Column) -> Column:
    return F.coalesce(F.btrim(value), F.lit(""))


def _side(side: str) -> tuple[Column, Column, Column, Column]:
    """Table, workspace id, lakehouse id and service name of a copy's source or sink."""
    settings = f"properties.{side}.datasetSettings"
    table = F.coalesce(
        F.nullif(_blank(F.col(f"{settings}.typeProperties.table")), F.lit("")),
        F.nullif(_blank(F.coalesce(F.nullif(f"{settings}.typeProperties.location.fileName", F.lit("")),
                                   F.col(f"{settings}.typeProperties.location.folderPath"))), F.lit("")),
    )
    service = f"{settings}.linkedService"
    return (
        table,
        _blank(F.col(f"{service}.properties.typeProperties.workspaceId")),
        _blank(F.col(f"{service}.properties.typeProperties.artifactId")),
        _blank(F.col(f"{service}.name")),
    )


def dataset_refs(activity: DataFrame, name_map: DataFrame, default_workspace="") -> DataFrame:
    """Adds ``source_ref`` and ``sink_ref``, null when a side cannot be named.

    GUIDs resolve through the name map, all four of an activity in one pass.
    """
    out = activity
    for side in ("source", "sink"):
        table, workspace, lakehouse, service = _side(side)
        out = out.withColumns({f"_{side}_t": table, f"_{side}_w": workspace, f"_{side}_l": lakehouse, f"_{side}_s": service})
    ids = [f"_{side}_{part}" for side in ("source", "sink") for part in ("w", "l")]
    out = refs.resolve_ids(out, name_map, ids)
    for side in ("source", "sink"):
        workspace = F.when(F.col(f"_{side}_w") != "", F.col(f"_{side}_w")).otherwise(F.lit(default_workspace))
        lakehouse = F.when(F.col(f"_{side}_l") != "", F.col(f"_{side}_l")).otherwise(F.col(f"_{side}_s"))
        out = out.withColumn(f"{side}_ref", F.when(F.col(f"_{side}_t").isNotNull(), refs.make_ref(F.col(f"_{side}_t"), lakehouse, workspace)))
    return out.select(*activity.columns, "source_ref", "sink_ref")


def copy_access(activity: DataFrame, default_workspace="") -> DataFrame:
    """Reads and writes of Copy activities, both in one pass; dataset names stand in for an unnamed side."""
    def side(ref, listed, mode):
        names = F.transform(F.filter(F.col(listed), lambda d: _blank(d["referenceName"]) != ""),
                            lambda d: refs.make_ref(F.btrim(d["referenceName"]), "", default_workspace))
        found = F.when(F.col(ref).isNotNull(), F.array(ref)).otherwise(F.coalesce(names, F.array().cast("array<string>")))
        return F.transform(found, lambda name: F.struct(F.lit(mode).alias("mode"), name.alias("ref")))

    copies = activity.filter(F.lower("type") == "copy")
    return copies.select(*KEY, "name", F.inline(F.concat(side("source_ref", "inputs", "read"), side("sink_ref", "outputs", "write"))))


def copy_lineage(activity: DataFrame) -> DataFrame:
    """Declared column flows of Copy activities; only where the sink is known."""
    mapped = activity.filter((F.lower("type") == "copy") & F.col("sink_ref").isNotNull()).select(
        *KEY, "name", "source_ref", "sink_ref", F.posexplode("properties.translator.mappings").alias("seq", "m"))
    columns = mapped.select(
        *KEY, "name", "seq", F.col("sink_ref").alias("to_table"), F.col("source_ref").alias("from_table"),
        refs.copy_column_name(F.col("m.sink.name"), F.col("m.sink.path")).alias("to_column"),
        refs.copy_column_name(F.col("m.source.name"), F.col("m.source.path")).alias("from_column"),
        F.lit(None).cast("string").alias("transform"))
    return columns.filter("to_column <> '' AND from_column <> ''")


def declared_schema(flow: DataFrame, by: list[str]) -> DataFrame:
    """The columns a mapping names are the columns of both its tables, in first-seen order."""
    def end(ref, column, place):
        return flow.select(*by, F.col(ref).alias("ref"), F.col(column).alias("name"), F.struct("seq", F.lit(place).alias("p")).alias("_at"))

    both = end("from_table", "from_column", 0).unionByName(end("to_table", "to_column", 1)).filter("ref IS NOT NULL")
    first = both.groupBy(*by, "ref", "name").agg(F.min("_at").alias("_at"))
    return number_rows(first, [*by, "ref"], ["_at", "name"], "pos").select(*by, "ref", "pos", "name")


# -- nested pipelines ----------------------------------------------------------


def expand_activities(activity: DataFrame, deps: DataFrame, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every pipeline with its child pipelines spliced in, as activities and dependencies.

    ``activity``: workspace_id, pipeline_id, seq, name, type, child_workspace_id,
    child_pipeline_id. ``deps``: workspace_id, pipeline_id, name, depends_on.

    Going down, each level joins the invoking activities of the level above to
    the child's activities, carrying the path of ids that stops cycles. Coming
    back, what waited for an invoke is pointed at the child's last activities.
    """
    act = activity.select(*KEY, "seq", "name", "type", "child_workspace_id", "child_pipeline_id")
    by_child = act.select(F.lower("workspace_id").alias("_w"), F.lower("pipeline_id").alias("_p"),
                          *[F.col(c).alias(f"k_{c}") for c in act.columns])
    spark = activity.sparkSession
    levels = [Rounds(spark).add(act.select(
        *[F.col(k).alias(f"root_{k}") for k in KEY], *KEY, F.lit("").alias("prefix"), F.col("name").alias("full"), "name", "type",
        F.array("seq").alias("path"), F.array().cast("array<string>").alias("seen"), "child_workspace_id", "child_pipeline_id"))]
    roots = [f"root_{k}" for k in KEY]
    for _ in range(max_depth):
        above = levels[-1]
        child_ws = F.coalesce(F.nullif("child_workspace_id", F.lit("")), "workspace_id")
        going = (
            above.filter("child_pipeline_id IS NOT NULL AND child_pipeline_id <> ''")
            .withColumns({"_w": F.lower(child_ws), "_p": F.lower("child_pipeline_id")})
            .withColumn("_key", F.concat_ws("/", "_w", "_p"))
            .filter(~F.array_contains("seen", F.col("_key")))
            .select(*roots, F.concat("full", F.lit(fixed.NAME_SEPARATOR)).alias("prefix"), F.col("path").alias("_path"),
                    F.array_append("seen", F.col("_key")).alias("seen"), "_w", "_p")
        )
        below = going.join(by_child, ["_w", "_p"]).select(
            *roots, F.col("k_workspace_id").alias("workspace_id"), F.col("k_pipeline_id").alias("pipeline_id"), "prefix",
            F.concat("prefix", "k_name").alias("full"), F.col("k_name").alias("name"), F.col("k_type").alias("type"),
            F.array_append("_path", F.col("k_seq")).alias("path"), "seen",
            F.col("k_child_workspace_id").alias("child_workspace_id"), F.col("k_child_pipeline_id").alias("child_pipeline_id"))
        below = Rounds(spark).add(below)
        if below.isEmpty():
            break
        levels.append(below)

    named = deps.select(*KEY, "name", "depends_on").filter("depends_on IS NOT NULL AND depends_on <> ''")
    edges, tails = [], None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        raw = level.join(named, [*KEY, "name"]).select(*roots, "prefix", "full", F.concat("prefix", "depends_on").alias("dep"))
        if tails is not None:
            raw = raw.join(tails.withColumnRenamed("invoke", "dep"), [*roots, "dep"], "left").select(
                *roots, "prefix", "full", F.coalesce("leaf", "dep").alias("dep"))
        if depth:
            invoke = F.expr(f"substring(prefix, 1, length(prefix) - {len(fixed.NAME_SEPARATOR)})")
            first = level.join(raw.select(*roots, "full").distinct(), [*roots, "full"], "left_anti")
            raw = raw.unionByName(first.select(*roots, "prefix", "full", invoke.alias("dep")))
        here = Rounds(spark).add(raw.distinct())
        edges.append(here)
        if not depth:
            break
        # Last activities of each instance: its own, and its children's last ones, that nothing waits for.
        candidates = level.select(*roots, "prefix", F.col("full").alias("leaf"))
        waited = here.select(*roots, F.col("dep").alias("leaf"))
        if tails is not None:
            inner = tails.join(level.select(*roots, "prefix", F.col("full").alias("invoke")), [*roots, "invoke"])
            candidates = candidates.unionByName(inner.select(*roots, "prefix", "leaf"))
            waited = waited.unionByName(edges[-2].select(*roots, F.col("dep").alias("leaf")))
        ends = candidates.join(waited.distinct(), [*roots, "leaf"], "left_anti").distinct()
        tails = Rounds(spark).add(ends.select(
            *roots, F.expr(f"substring(prefix, 1, length(prefix) - {len(fixed.NAME_SEPARATOR)})").alias("invoke"), "leaf"))

    flat = levels[0].select(*roots, "path", F.col("full").alias("name"), "type")
    for level in levels[1:]:
        flat = flat.unionByName(level.select(*roots, "path", F.col("full").alias("name"), "type"))
    links = edges[0].select(*roots, F.col("full").alias("name"), F.col("dep").alias("depends_on"))
    for part in edges[1:]:
        links = links.unionByName(part.select(*roots, F.col("full").alias("name"), F.col("dep").alias("depends_on")))
    back = {f"root_{k}": k for k in KEY}
    return flat.withColumnsRenamed(back), links.withColumnsRenamed(back)


# -- order ---------------------------------------------------------------------


def _known_deps(activity: DataFrame, deps: DataFrame, by: list[str]) -> DataFrame:
    """Dependencies whose both ends are activities of the pipeline."""
    names = activity.select(*by, "name")
    return (
        deps.select(*by, "name", "depends_on").distinct()
        .join(growing(names.withColumnRenamed("name", "depends_on")), [*by, "depends_on"], "left_semi")
        .join(growing(names), [*by, "name"], "left_semi")
    )


def order_activities(activity: DataFrame, deps: DataFrame, by: list[str], limit: int = whole_graphs.LIMIT) -> DataFrame:
    """Run order: always the first ready activity in definition order; ``activity``: keys, idx, name.

    Members of a cycle, and what waits for them, come last in definition order. A pipeline of up to ``limit`` activities and
    dependencies is walked in the task where its rows meet, a larger one is sorted by labels.
    """
    known = _known_deps(activity, deps, by)
    idx, none = activity.schema["idx"].dataType, F.lit(None)
    steps = cut_lineage(
        activity.select(*by, "idx", "name", none.cast("string").alias("above"))
        .unionByName(known.select(*by, none.cast(idx).alias("idx"), "name", F.col("depends_on").alias("above"))))
    small, large = whole_graphs.divide(steps, by, limit)
    walked = whole_graphs.solve(small, by, whole_graphs.first_ready, f"name string, idx {idx.simpleString()}, position bigint")
    if large is None:
        return walked
    large = cut_lineage(large)
    sorted_ = _order_by_labels(
        large.filter("idx IS NOT NULL").select(*by, "idx", "name"),
        large.filter("idx IS NULL").select(*by, "name", F.col("above").alias("depends_on")), by)
    return walked.unionByName(sorted_)


def _order_by_labels(activity: DataFrame, deps: DataFrame, by: list[str]) -> DataFrame:
    """The run order of pipelines of any size.

    That order is a sort. Give an activity the label (larger indexes above it,
    then its own): the greatest of its dependencies' labels, cut to the indexes
    larger than its own, with its own added. Labels compare as arrays do.
    An activity waits for the largest index above it before anything else, and
    the label lists exactly those waits.
    """
    known = _known_deps(activity, deps, by)
    edges = known.select(*by, F.col("depends_on").alias("src"), F.col("name").alias("dst"))
    loops = edges.filter("src = dst").select(*by, F.col("dst").alias("name"))
    levels = graph._levels(edges, by)
    blocked = loops
    if levels.blocked is not None:
        blocked = blocked.unionByName(levels.blocked.select(*by, F.col("dst").alias("name")))
    placed = activity.select(*by, "idx", "name").join(growing(levels.depth.withColumnRenamed("id", "name")), [*by, "name"], "left")
    placed = placed.withColumn("depth", F.coalesce("depth", F.lit(0)))
    blocked = _behind(blocked.distinct(), edges, by)
    if blocked is not None:
        placed = placed.join(growing(blocked), [*by, "name"], "left_anti")
    placed = cut_lineage(placed)
    labels = Rounds(activity.sparkSession)
    labels.add(placed.filter("depth = 0").select(*by, "name", F.array("idx").alias("label")))
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    for depth in range(1, deepest + 1):
        above = labels.table().select(*by, F.col("name").alias("depends_on"), "label")
        labels.add(
            placed.filter(F.col("depth") == depth).join(growing(known), [*by, "name"]).join(growing(above), [*by, "depends_on"])
            .groupBy(*by, "name", "idx").agg(F.max(F.filter("label", lambda i: i > F.col("idx"))).alias("above"))
            .select(*by, "name", F.array_append("above", F.col("idx")).alias("label"))
        )
    labelled = activity.select(*by, "name", "idx").join(growing(labels.table()), [*by, "name"], "left")
    return number_rows(labelled, by, [F.col("label").isNull(), "label", "idx"], "position").drop("label")


def _behind(names: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame | None:
    """``names`` and everything that waits for one of them; None when there are none."""
    found = Rounds(names.sparkSession)
    new = found.add(names)
    if new.isEmpty():
        return None
    while not new.isEmpty():
        reached = edges.join(growing(new.withColumnRenamed("name", "src")), [*by, "src"], "left_semi").select(*by, F.col("dst").alias("name")).distinct()
        new = found.add(reached.join(growing(found.table()), [*by, "name"], "left_anti"))
    return found.table()


def activity_waves(activity: DataFrame, deps: DataFrame, by: list[str]) -> DataFrame:
    """Wave of each activity (one past its deepest dependency) and whether others share it."""
    known = _known_deps(activity, deps, by)
    nodes = activity.select(*by, "idx", F.col("name").alias("id"), "type")
    edges = known.select(*by, F.col("depends_on").alias("src"), F.col("name").alias("dst"))
    waves = graph.longest_path_depth(nodes, edges, by)
    shared = waves.groupBy(*by, "depth").agg(F.count("*").alias("_n"))
    after = known.groupBy(*by, F.col("name").alias("id")).agg(F.count("*").alias("after"))
    return (
        waves.join(growing(shared), [*by, "depth"]).join(growing(after), [*by, "id"], "left")
        .select(*by, "idx", F.col("id").alias("name"), "type", (F.col("depth") + 1).alias("wave"), (F.col("_n") > 1).alias("concurrent"),
                F.coalesce("after", F.lit(0)).alias("after"))
    )


def activity_after(activity: DataFrame, deps: DataFrame, by: list[str]) -> DataFrame:
    """What each activity waits for, by name, one row each; only activities of the pipeline count."""
    return _known_deps(activity, deps, by).select(*by, "name", F.col("depends_on").alias("after"))


def activity_type_label(kind: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in fixed.ACTIVITY_LABELS.items() for x in pair])
    return F.coalesce(labels[kind], kind)


# -- runs of pipelines ---------------------------------------------------------


def combine_access(access: DataFrame, by: list[str]) -> DataFrame:
    """Reads and writes of all activities of a run, each where it was first touched."""
    return access.groupBy(*by, "mode", "ref").agg(F.min("seq").alias("first_seq"))


def combine_flows(flow: DataFrame, by: list[str]) -> DataFrame:
    """The column flows of all activities of a run, one after another as they ran: ``flow`` with a ``position``.

    ``flow``: keys, seq (of the activity), pos (within it), and what else a flow has.
    """
    return number_rows(flow, by, ["seq", "pos"], "position")


def combine_schemas(schema: DataFrame, by: list[str]) -> DataFrame:
    """The last activity to describe a table gives its columns."""
    last = schema.groupBy(*by, "ref").agg(F.max("seq").alias("seq"))
    return schema.join(last, [*by, "ref", "seq"], "left_semi")


def combine_status(entries: DataFrame, by: list[str]) -> DataFrame:
    """ok only when every activity is; else how many of how many failed."""
    counted = entries.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"))
    message = F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(" notebook activities failed"))
    return counted.select(
        *by, (F.col("failed") == 0).alias("ok"),
        F.when(F.col("failed") > 0, "error").otherwise("ok").alias("status"),
        F.when(F.col("failed") > 0, message).alias("error"))
