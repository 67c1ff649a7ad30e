"""The flow graph of runs: depth, cards, edges, stages, owners.

``by`` names the columns that separate one graph from the next (a run, a
pipeline); every operator handles all graphs in one job.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.functions import refs
from factloom.operators import whole_graphs
from factloom.operators.ordering import number_rows
from factloom.session import Rounds, cut_lineage, growing

# -- depth ---------------------------------------------------------------------


@dataclass
class Levels:
    """``depth``: keys, id, depth of every node with an input. ``blocked``: edges on or behind a cycle."""

    depth: DataFrame
    blocked: DataFrame | None


def _levels(edges: DataFrame, by: list[str], limit: int = whole_graphs.LIMIT) -> Levels:
    """Graphs of up to ``limit`` edges settle node by node in one pass, larger ones in rounds over all that are left."""
    edges = cut_lineage(edges.filter("src <> dst").select(*by, "src", "dst").distinct())
    small, large = whole_graphs.divide(edges, by, limit)
    kind = edges.schema["dst"].dataType.simpleString()
    source = edges.schema["src"].dataType.simpleString()
    solved = cut_lineage(whole_graphs.solve(small, by, whole_graphs.levels, f"id {kind}, depth bigint, src {source}, dst {kind}"))
    depth = solved.filter("id IS NOT NULL").select(*by, "id", F.col("depth").cast("int").alias("depth"))
    blocked = solved.filter("id IS NULL").select(*by, "src", "dst")
    if large is None:
        return Levels(depth, None if blocked.isEmpty() else blocked)
    rest = _peeled(large, by)
    if rest.blocked is not None:
        blocked = blocked.unionByName(rest.blocked.select(*by, "src", "dst"))
    return Levels(depth.unionByName(rest.depth), None if blocked.isEmpty() else blocked)


def _peeled(edges: DataFrame, by: list[str]) -> Levels:
    """Peel the graph: an edge stays as long as its source is still some edge's target.

    A node's depth is the number of rounds in which it was a target. Each round
    is one semi join of the edges that are left, so the work shrinks, and the
    number of rounds is the longest path. It ends when no edge is left, or when a
    round removes none, which only a cycle does.
    """
    kept = Rounds(edges.sparkSession)

    def keep(rest: DataFrame, number: int) -> tuple[DataFrame, int]:
        written = kept.add(rest.select(*by, "src", "dst").withColumn("round", F.lit(number)))
        return written, written.count()

    left, remaining = keep(edges.filter("src <> dst").distinct(), 0)
    blocked = None
    for number in itertools.count(1):
        if remaining == 0:
            break
        reached = left.select(*by, F.col("dst").alias("src")).distinct()
        rest, count = keep(left.join(growing(reached), [*by, "src"], "left_semi"), number)
        if count == remaining:
            blocked = left
            break
        left, remaining = rest, count
    depth = kept.table().groupBy(*by, F.col("dst").alias("id")).agg((F.max("round") + 1).alias("depth"))
    return Levels(depth, blocked)


def longest_path_depth(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """0 without input, else one more than the deepest input.

    Exact on acyclic graphs. Where there is a cycle, edges on or behind it whose
    target is not later in id order are dropped first.
    """
    linked = edges.join(growing(nodes.select(*by, F.col("id").alias("dst"))), [*by, "dst"], "left_semi")
    levels = _levels(linked, by)
    if levels.blocked is not None:
        back = levels.blocked.filter("dst <= src")
        levels = _levels(linked.join(growing(back), [*by, "src", "dst"], "left_anti"), by)
    return nodes.join(growing(levels.depth), [*by, "id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


# -- nodes and edges -----------------------------------------------------------


def collect_schemas(schema: DataFrame, runs: DataFrame) -> DataFrame:
    """The first non-empty schema of each ref in run order."""
    ordered = schema.join(runs.select("run_id", "at"), "run_id")
    first = ordered.groupBy("ref").agg(F.min_by("run_id", F.struct("at", "run_id")).alias("run_id"))
    return schema.join(first, ["run_id", "ref"], "left_semi").select("ref", "name", "type").distinct()


def card_key(ref: Column) -> Column:
    """A lakehouse is the card; a ref without one is a card of its own."""
    lake = refs.ref_lakehouse(ref)
    own = F.concat(F.lit("t:"), F.lower(ref))
    shared = F.concat(F.lit("lh:"), F.lower(refs.ref_workspace(ref)), F.lit("/"), F.lower(lake))
    return F.when(lake != "", shared).otherwise(own)


def lakehouse_cards(access: DataFrame) -> DataFrame:
    """Cards of the whole estate and how many tables each holds."""
    return access.select("ref").distinct().groupBy(card_key(F.col("ref")).alias("card")).agg(F.count("*").alias("tables"))


def access_edges(access: DataFrame, schema: DataFrame, by: list[str]) -> DataFrame:
    """read: table -> step, write: step -> table; one table edge and one per known column."""
    step = F.concat_ws(":", F.lit("s"), *[F.col(k).cast("string") for k in by])
    group = F.concat_ws("|", "mode", step, "ref")
    table = access.select(*by, "mode", "ref", F.lit(None).cast("string").alias("column"), F.lit("table").alias("kind"))
    columns = access.join(schema.select(*by, "ref", F.col("name").alias("column")), [*by, "ref"]).select(
        *by, "mode", "ref", "column", F.lit("column").alias("kind"))
    reads = F.col("mode") == "read"
    return table.unionByName(columns).select(
        *by,
        F.when(reads, card_key(F.col("ref"))).otherwise(step).alias("source"),
        F.when(reads, step).otherwise(card_key(F.col("ref"))).alias("target"),
        F.col("mode").alias("tone"), "kind", "column", group.alias("group"),
    )


def hop_rows(access: DataFrame, schema: DataFrame, by: list[str]) -> DataFrame:
    """A step that reads and writes becomes one hop, over the union of its columns by name.

    The label names the tables of ONE step, which come from one notebook; it is
    the only list put together per group.
    """
    named = access.select(*by, "mode", "ref", refs.ref_label(F.col("ref")).alias("label")).distinct()

    def side(mode):
        listed = F.array_sort(F.collect_list(F.when(F.col("mode") == mode, F.struct("ref", "label"))))
        return F.array_join(F.array_distinct(F.transform(listed, lambda r: r["label"])), ", ")

    hops = named.groupBy(*by).agg(side("read").alias("_r"), side("write").alias("_w")).filter("_r <> '' AND _w <> ''")
    columns = access.join(schema.select(*by, "ref", "name"), [*by, "ref"]).select(*by, "name").distinct()
    return (
        hops.select(*by, F.lit("hop").alias("tone"), F.concat("_r", F.lit(" → "), "_w").alias("label"))
        .unionByName(columns.join(hops.select(*by), by, "left_semi").select(*by, F.lit("col").alias("tone"), F.col("name").alias("label")))
    )


def split_units(entries: DataFrame, by: list[str]) -> DataFrame:
    """One unit per activity of a run, numbered in run order."""
    run = F.concat_ws(":", *[F.col(k).cast("string") for k in by])
    return number_rows(entries.select(*by, "seq", "name"), by, ["seq"], "badge").select(
        *by, F.concat(F.lit("s:"), run, F.lit(":a"), (F.col("badge") - 1).cast("string")).alias("id"),
        refs.activity_label(F.col("name")).alias("label"), "badge")


def order_edges(units: DataFrame, by: list[str]) -> DataFrame:
    """A link between consecutive units of a run, by their numbers."""
    after = units.select(*by, (F.col("badge") - 1).alias("badge"), F.col("id").alias("target"))
    return units.select(*by, "badge", F.col("id").alias("source")).join(after, [*by, "badge"]).select(*by, "source", "target")


def cross_workspace_access(access: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """Accesses whose workspace is known and is not the step's own."""
    return (
        access.withColumn("workspace", refs.ref_workspace(F.col("ref")))
        .join(steps.select(*by, F.col("workspace").alias("own")), by)
        .filter("own <> '' AND workspace <> '' AND workspace <> own")
        .select(*by, "mode", "ref", "workspace")
    )


# -- stages --------------------------------------------------------------------


def stage_of(access: DataFrame, by: list[str]) -> DataFrame:
    """Stage rank of every table and step: a step has the one it first WRITES, else first reads.

    ``access``: keys, mode, ref, seq. First is by ``seq``, the order of touch. ``at`` is where a table was first touched; the
    step itself comes before its tables.
    """
    def touch(mode):
        return F.min(F.when(F.col("mode") == mode, F.col("seq"))).alias(mode)

    def first(mode):
        known = F.col(mode).isNotNull() & (F.col("rank") >= 0)
        return F.min_by(F.when(known, F.col("rank")), F.when(known, F.struct(mode, "rank")))

    # Both kinds are made from one shuffle of the accesses.
    touched = access.groupBy(*by, "ref").agg(F.min("seq").alias("at"), touch("write"), touch("read")).withColumn(
        "rank", refs.stage_rank(refs.ref_lakehouse(F.col("ref"))))
    touched = cut_lineage(touched)
    steps = touched.groupBy(*by).agg(F.coalesce(first("write"), first("read"), F.lit(-1)).alias("rank"))
    tables = touched.select(*by, F.lit("table").alias("kind"), F.col("ref").alias("id"), "rank", "at")
    step = F.lit("step")
    return tables.unionByName(steps.select(*by, step.alias("kind"), step.alias("id"), "rank", F.lit(-1).cast(tables.schema["at"].dataType).alias("at")))


def medallion_bands(staged: DataFrame, by: list[str]) -> DataFrame:
    """Present stages as bands in order, unstaged last; in a band steps before tables, each in order of first touch."""
    staged = cut_lineage(staged)
    place = F.when(F.col("rank") < 0, 1_000).otherwise(F.col("rank"))
    # A graph has at most as many bands as there are stages, and one for the rest.
    present = staged.groupBy(*by).agg(F.array_sort(F.collect_set(place)).alias("_present"))
    kind_first = F.when(F.col("kind") == "step", 0).otherwise(1)
    return number_rows(staged, [*by, "rank"], [kind_first, "at", "id"], "position").join(present, by).select(
        *by, "kind", "id", F.array_position("_present", place).alias("band"), refs.stage_label(F.col("rank")).alias("stage"), "position")


# -- owners --------------------------------------------------------------------


def owner_of(access: DataFrame, steps: DataFrame, by: list[str]) -> DataFrame:
    """Workspace, else ``lh:`` and the lakehouse (its own, or the first written, by ``seq``), else blank."""
    def owner(workspace, lake):
        return F.when(workspace != "", workspace).when(lake != "", F.concat(F.lit("lh:"), lake)).otherwise("")

    ref = F.col("ref")
    tables = access.select(*by, F.lit("table").alias("kind"), ref.alias("id"), owner(refs.ref_workspace(ref), refs.ref_lakehouse(ref)).alias("owner")).distinct()
    first_write = access.filter("mode = 'write'").groupBy(*by).agg(F.min_by("ref", F.struct("seq", "ref")).alias("_ref"))
    runs = steps.join(first_write, by, "left").select(
        *by, F.lit("step").alias("kind"), F.lit("step").alias("id"),
        owner(F.coalesce("workspace", F.lit("")), F.coalesce(refs.ref_lakehouse(F.col("_ref")), F.lit(""))).alias("owner"))
    return tables.unionByName(runs)


def owner_order(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Owner columns from left to right.

    Owners that run something come first, then by least depth and first place;
    blank is last in its class. A lone owner with both kinds splits by role.
    ``nodes``: keys, id, kind, owner, depth, at.
    """
    owners = nodes.groupBy(*by, "owner").agg(
        F.min("depth").alias("depth"), F.min("at").alias("at"),
        F.bool_or(F.col("kind") == "step").alias("runs"), F.bool_or(F.col("kind") == "table").alias("tables"))
    both = F.col("_alone") & F.col("runs") & F.col("tables")
    roles = F.when(both, F.array(F.lit("runs"), F.lit("tables"))).otherwise(F.array(F.lit("all")))
    split = owners.withColumn("_alone", F.count("*").over(Window.partitionBy(*by)) == 1).withColumn("role", F.explode(roles))
    order = Window.partitionBy(*by).orderBy(F.col("runs").desc(), F.col("owner") == "", "depth", "at", "role")
    return split.select(*by, "owner", "role", F.row_number().over(order).cast("bigint").alias("position"))


def truncate_rows(rows: DataFrame, by: list[str], cap_table: int = 8, cap_nested: int = 5) -> DataFrame:
    """First rows of each column run and, where some are hidden, a ``+n more`` row.

    ``rows``: keys, group (blank for a table card), pos, label.
    """
    run = Window.partitionBy(*by, "group").orderBy("pos")
    cap = F.when(F.col("group") == "", cap_table).otherwise(cap_nested)
    shown = (
        rows.withColumn("place", F.row_number().over(run))
        .filter(F.col("place") <= max(cap_table, cap_nested)).filter(F.col("place") <= cap)
        .select(*by, "group", F.col("place").cast("bigint").alias("place"), "label")
    )
    hidden = rows.groupBy(*by, "group").agg((F.count("*") - cap).alias("n")).filter("n > 0").select(
        *by, "group", (cap + 1).cast("bigint").alias("place"), F.concat(F.lit("+"), F.col("n").cast("string"), F.lit(" more")).alias("label"))
    return shown.unionByName(hidden)
