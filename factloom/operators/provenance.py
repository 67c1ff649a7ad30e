"""Column provenance as rules over edge tables, every notebook of a corpus at once.

``frame_col``: notebook, frame, pos, col_name, src_ref, src_column, transform.
A column fed by several source columns has several rows; one without a source
has one row with nulls; a null ``src_ref`` next to a ``src_column`` means the
owner is not known. ``pos`` is dense from 1 within a frame.

``ops``: notebook, seq, out_frame, verb, left_frame, right_frame.
``args``: notebook, seq, pos, out_name, input_cols (array), transform, role, where
role is ``col``, ``key`` (grouping key), ``expr`` (SQL text naming one column),
``dict`` (``{"c": "sum"}``) or ``star``; the last four belong to projections and
aggregates only.

An operation that cannot be read exactly yields no rows: its frame stays unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom import fixed
from factloom.functions import refs
from factloom.operators.ordering import number_rows
from factloom.session import Rounds, cut_lineage, growing

FRAME_COL = ["notebook", "frame", "pos", "col_name", "src_ref", "src_column", "transform"]
_OP = ["notebook", "seq"]
_OUT = "struct<col_name:string,src_ref:string,src_column:string,transform:string,slot:struct<late:int,pos:bigint>,kept:boolean,renamed:boolean>"

WITH_COLUMN = ["withColumn", "withColumns"]
PROJECT = ["select", "selectExpr", "groupBy", "agg"]
BINARY = ["join", "crossJoin", "union", "unionAll", "unionByName"]
#: columns of frames whose operations one task works through
ROWS = 30_000
CARRY = fixed.PASSTHROUGH_VERBS + WITH_COLUMN + BINARY + ["drop", "withColumnRenamed", "toDF"]


def seed(reads: DataFrame, schema: DataFrame) -> DataFrame:
    """Base frames of tables: every schema column is its own source."""
    return reads.join(schema, "ref").select(
        "notebook", F.col("out_frame").alias("frame"), "pos", F.col("name").alias("col_name"),
        F.col("ref").alias("src_ref"), F.col("name").alias("src_column"), F.lit(None).cast("string").alias("transform"))


def source_frames(reads: DataFrame, views: DataFrame, schema: DataFrame) -> DataFrame:
    """Frames of read names: a temp view is looked up BEFORE a table of that name.

    ``reads``: notebook, out_frame, raw, ref. ``views``: notebook, view_name and
    frame_col columns; a view whose columns are unknown is one row with a null
    ``col_name``. Such a view gives no frame, and never the table's frame.
    """
    keyed = reads.withColumn("view_name", refs.normalise_view_name(F.col("raw")))
    key = ["notebook", "view_name"]
    from_view = (
        keyed.join(growing(views), key).filter("col_name IS NOT NULL")
        .select("notebook", F.col("out_frame").alias("frame"), *FRAME_COL[2:])
    )
    return from_view.unionByName(seed(keyed.join(growing(views.select(*key).distinct()), key, "left_anti"), schema))


def apply_ops(ops: DataFrame, args: DataFrame, frames: DataFrame) -> DataFrame:
    """One step of every operation whose input frames are in ``frames``.

    The rows of both input frames and the arguments are stacked and shuffled
    once, by operation. All matching (an argument with the columns it names, a
    replaced or renamed column, the two sides of a join or union) is then done
    by windows inside an operation, which reuse that partitioning. An operation
    sees the columns of two frames, so these windows are small. A task keeps its
    rows in memory for every window, so the number of tasks follows the frames.
    """
    head = [*_OP, "out_frame", "verb"]
    sides = ops.select(*head, F.inline(F.filter(
        F.array(
            F.struct(F.lit("l").alias("kind"), F.col("left_frame").alias("frame")),
            F.struct(F.lit("r").alias("kind"), F.col("right_frame").alias("frame")),
        ),
        lambda side: side["frame"].isNotNull(),
    )))
    columns = sides.join(growing(frames.withColumnRenamed("col_name", "name")), ["notebook", "frame"]).drop("frame")
    named = ops.select(*head).join(growing(args), _OP).select(
        *head, F.lit("a").alias("kind"), "pos", F.explode_outer("input_cols").alias("name"), "transform", "out_name", "role")
    rows = columns.unionByName(named, allowMissingColumns=True)
    tasks = frames.count() // ROWS
    if tasks > 1:
        rows = rows.repartition(max(tasks, frames.sparkSession.sparkContext.defaultParallelism), *_OP)

    verb, kind = F.col("verb"), F.col("kind")
    is_left, is_right, is_arg = kind == "l", kind == "r", kind == "a"
    is_carry, is_binary = verb.isin(CARRY), verb.isin(BINARY)
    is_with, is_rename, is_to_df = verb.isin(WITH_COLUMN), verb == "withColumnRenamed", verb == "toDF"
    positional = verb.isin("union", "unionAll")
    place = F.concat(F.lit("#"), F.col("pos").cast("string"))

    def over(*keys):
        return Window.partitionBy(*_OP, *keys)

    # Operations that must abstain as a whole.
    rows = rows.withColumns({
        "left_width": F.max(F.when(is_left, F.col("pos"))).over(over()),
        "right_width": F.max(F.when(is_right, F.col("pos"))).over(over()),
        "arity": F.count(F.when(is_arg, 1)).over(over()),
        "names": F.count(F.when(is_arg, F.col("out_name"))).over(over()),
        "starred": F.coalesce(F.bool_or(is_arg & (F.col("role") == "star")).over(over()), F.lit(False)),
        "open_key": F.coalesce(F.bool_or(is_arg & (F.col("role") == "key") & F.col("out_name").isNull()).over(over()), F.lit(False)),
    }).filter(
        F.col("left_width").isNotNull() & ~F.col("starred") & ~F.col("open_key")
        & (~is_binary | F.col("right_width").isNotNull())
        & (~positional | (F.col("left_width") == F.col("right_width")))
        & (~is_to_df | ((F.col("arity") == F.col("left_width")) & (F.col("names") == F.col("left_width"))))
    )

    # Whether the frame has the column an argument names; SQL text and dict entries need it.
    same_input = over(is_right, "name")
    strict = F.col("role").isin("expr", "dict")
    rows = rows.withColumn("has_column", F.max(is_left).over(same_input))
    counts = is_arg & F.col("out_name").isNotNull() & (~strict | F.col("has_column"))
    # Of two arguments that make the same column the last counts, in the first one's place.
    made = over("kind", "out_name")
    rows = rows.withColumns({
        "first_pos": F.min(F.when(counts, F.col("pos"))).over(made), "last_pos": F.max(F.when(counts, F.col("pos"))).over(made)})
    counts = counts & (F.col("pos") == F.col("last_pos"))
    argument = F.struct("out_name", "transform", "role", "first_pos")
    # Only the column itself gets the list of arguments that name it: to it they are the next in order, and nothing follows an argument.
    named_by = same_input.orderBy(F.when(is_arg, 1).otherwise(0)).rangeBetween(1, 1)
    rows = rows.withColumn("arguments", F.collect_list(F.when(counts, argument)).over(named_by))
    # The argument that replaces, drops or renames this column.
    rows = rows.withColumn("hit", F.when(is_to_df, place).when(is_arg & ~is_rename, F.col("out_name")).otherwise(F.col("name")))
    same_hit = over(is_right, "hit")
    rows = rows.withColumns({"new_name": F.max(F.when(is_arg, F.col("out_name"))).over(same_hit), "is_hit": F.max(is_arg).over(same_hit)})
    found = F.max(is_arg & F.col("has_column")).over(over())
    rows = rows.withColumn("found", found).filter(~is_rename | F.col("found"))
    # The left column that a right one meets.
    rows = rows.withColumn("meet", F.when(is_arg, F.lit(None)).when(positional, place).otherwise(F.col("name")))
    same_meet = over("meet")
    rows = rows.withColumns({
        f"left_{c}": F.max(F.when(is_left, F.col(c))).over(same_meet) for c in ("name", "pos", "transform")})

    def out(name, transform, slot, kept=None, renamed=None, sourced=True):
        none = F.lit(None).cast("string")
        return F.struct(
            name.alias("col_name"), (F.col("src_ref") if sourced else none).alias("src_ref"),
            (F.col("src_column") if sourced else none).alias("src_column"), transform.alias("transform"),
            slot.alias("slot"), (F.lit(True) if kept is None else kept).alias("kept"),
            (F.lit(False) if renamed is None else renamed).alias("renamed"))

    def place_of(late, pos):
        """Where a column goes: new ones of withColumn and of a right side after all that were there."""
        return F.struct(late.cast("int").alias("late"), pos.cast("bigint").alias("pos"))

    def computed(arg, sourced):
        plain = arg["role"].isin("key", "expr", "dict")
        slot = place_of(F.when(is_with, 1).otherwise(0), arg["first_pos"])
        return out(arg["out_name"], F.when(~plain, arg["transform"]), slot, sourced=sourced)

    carried = out(
        F.when(is_rename | is_to_df, F.coalesce("new_name", "name")).otherwise(F.col("name")),
        F.col("transform"), place_of(F.lit(0), F.col("pos")),
        # A replaced column keeps its place but not its sources; a dropped one neither.
        kept=~(F.col("is_hit") & (is_with | (verb == "drop"))),
        renamed=is_rename & F.col("is_hit"))
    met = out(F.coalesce("left_name", "name"), F.col("left_transform"), place_of(
        F.when(F.col("left_pos").isNull(), 1).otherwise(0), F.coalesce("left_pos", "pos")))
    makes = verb.isin(PROJECT) | is_with
    nothing = F.array().cast(f"array<{_OUT}>")
    results = F.concat(
        F.when(is_left & is_carry & ~((verb == "drop") & F.col("is_hit")), F.array(carried)).otherwise(nothing),
        F.when(is_left & makes, F.transform("arguments", lambda a: computed(a, True))).otherwise(nothing),
        F.when(counts & makes & ~F.col("has_column"), F.array(computed(argument, False))).otherwise(nothing),
        F.when(is_right & is_binary & (F.col("left_name").isNotNull() | verb.isin("join", "crossJoin")), F.array(met)).otherwise(nothing),
    )
    column = over("col_name")
    return (
        rows.select(*head, F.inline(results))
        .withColumns({
            "_slot": F.min("slot").over(column),
            "_taken": F.max("renamed").over(column),
            "_sourced": F.max(F.col("kept") & F.col("src_column").isNotNull()).over(column),
        })
        # A rename onto an existing name replaces that column.
        .filter(F.col("kept") & (F.col("renamed") | ~F.col("_taken")))
        .filter(F.col("src_column").isNotNull() | ~F.col("_sourced"))
        .withColumn("pos", F.dense_rank().over(over().orderBy("_slot", "col_name")).cast("bigint"))
        .select(*_OP, F.col("out_frame").alias("frame"), *FRAME_COL[2:])
        .distinct()
        .select(*FRAME_COL)
    )


#: operations of one notebook that one fold reads
STRETCH = 256
_MARK = "\u0001"
_SCHEMA = "array<struct<frame:string,names:array<string>>>"


def _names_after(op: Column, left: Column, right: Column) -> Column:
    """The column names of an operation's frame in order; null where it abstains. The rules are those of ``apply_ops``."""
    verb, args = op["verb"], op["args"]

    def has(name):
        return F.coalesce(F.array_contains(left, name), F.lit(False))

    def meets(arg):
        return F.coalesce(F.exists(arg["input_cols"], has), F.lit(False))

    def names_of(part):
        return F.transform(part, lambda a: a["out_name"])

    counted = names_of(F.filter(args, lambda a: a["out_name"].isNotNull() & (~a["role"].isin("expr", "dict") | meets(a))))
    closed = F.exists(args, lambda a: (a["role"] == "star") | ((a["role"] == "key") & a["out_name"].isNull()))

    def renamed(name):
        new = F.filter(args, lambda a: F.coalesce(F.array_contains(a["input_cols"], name), F.lit(False)))
        return F.coalesce(F.array_max(names_of(new)), name)

    def named_anew(name, i):
        return F.coalesce(F.get(names_of(F.filter(args, lambda a: a["pos"] == i + 1)), F.lit(0)), name)

    whole = (F.size(args) == F.size(left)) & F.forall(args, lambda a: a["out_name"].isNotNull())
    names = (
        F.when(F.coalesce(closed, F.lit(False)), None)
        .when(verb.isin(fixed.PASSTHROUGH_VERBS), left)
        .when(verb == "drop", F.filter(left, lambda n: ~F.coalesce(F.array_contains(names_of(args), n), F.lit(False))))
        .when(verb.isin(PROJECT), F.array_distinct(counted))
        .when(verb.isin(WITH_COLUMN), F.array_union(left, counted))
        .when(verb == "withColumnRenamed", F.when(F.exists(args, meets), F.array_distinct(F.transform(left, renamed))))
        .when(verb == "toDF", F.when(whole, F.array_distinct(F.transform(left, named_anew))))
        .when(verb.isin("join", "crossJoin"), F.array_union(left, right))
        .when(verb.isin("union", "unionAll"), F.when(F.size(left) == F.size(right), left))
        .when(verb == "unionByName", F.when(right.isNotNull(), left)))
    known = left.isNotNull() & (op["right_frame"].isNull() | right.isNotNull())
    return F.when(known & (F.size(names) > 0), names)


def frame_schemas(ops: DataFrame, args: DataFrame, base: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """notebook, frame, names: the ordered column names of every frame that can be known.

    A notebook's log is folded inside one expression, ``stretch`` operations at a time, over the schemas its operations
    name: no shuffle a step, and as many rounds as the longest log has stretches (one, as a rule). An
    operation sees frames that come before it by ``seq``; widths are those of tables.
    """
    spark = base.sparkSession
    known = Rounds(spark)
    known.add(base.groupBy("notebook", "frame").agg(F.array_sort(F.collect_set(F.struct("pos", "col_name"))).alias("c")).select(
        "notebook", "frame", F.array_distinct(F.col("c.col_name")).alias("names")))
    given = args.groupBy(*_OP).agg(F.array_sort(F.collect_list(F.struct("pos", "out_name", "input_cols", "role"))).alias("args"))
    log = ops.filter("left_frame IS NOT NULL")
    if log.groupBy("notebook").count().filter(F.col("count") > stretch).isEmpty():  # every log is one stretch, sorted where it is folded
        log, stretches = log.withColumns({"n": F.col("seq").cast("bigint"), "stretch": F.lit(0)}), 1
    else:
        log = cut_lineage(number_rows(log, ["notebook"], ["seq", "out_frame"], "n").withColumn("stretch", F.floor((F.col("n") - 1) / stretch).cast("int")))
        stretches = log.agg(F.max("stretch")).first()[0] + 1
    log = log.join(growing(given), _OP, "left").withColumn("args", F.coalesce("args", F.array().cast(given.schema["args"].dataType)))

    def step(state, op):
        def schema_of(frame):
            return F.get(F.filter(state, lambda s: s["frame"] == op[frame]), F.lit(0))["names"]

        inputs = F.array(F.struct(schema_of("left_frame").alias("l"), schema_of("right_frame").alias("r")))
        made = F.transform(inputs, lambda i: F.struct(op["out_frame"].alias("frame"), _names_after(op, i["l"], i["r"]).alias("names")))
        return F.concat(state, F.filter(made, lambda m: m["names"].isNotNull()).cast(_SCHEMA))

    for number in range(stretches):
        part = log.filter(F.col("stretch") == number)
        named = part.select("notebook", F.explode(F.array("left_frame", "right_frame")).alias("frame")).distinct()
        seen = known.table().join(growing(named), ["notebook", "frame"], "left_semi").groupBy("notebook").agg(F.collect_list(F.struct("frame", "names")).cast(_SCHEMA).alias("seen"))
        steps = part.groupBy("notebook").agg(F.array_sort(F.collect_list(F.struct("n", "out_frame", "verb", "left_frame", "right_frame", "args"))).alias("steps"))
        folded = steps.join(growing(seen), "notebook").select("notebook", F.size("seen").alias("old"), F.aggregate("steps", F.col("seen"), step).alias("state"))
        known.add(folded.select("notebook", F.inline(F.slice("state", F.col("old") + 1, F.size("state")))))
    return known.table()


def resolve_frames(ops: DataFrame, args: DataFrame, base: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """All frames that follow from ``base`` by ``ops``; a frame of an unknown one stays unknown.

    First the column names of all frames (``frame_schemas``). With these every operation is a map of its own, from its columns to those of
    the frames before it, and ``apply_ops`` makes all maps at once, reading each frame as its own source. Then maps are composed: a
    row that ends at a frame made by another operation goes on where that one's rows end, which have moved on
    as well, so a chain of n operations takes log2(n) joins. Transforms that come from elsewhere than the source (a right
    side's column that meets a left one) follow pointers of their own, composed in the same joins.
    """
    spark = base.sparkSession
    key, to = ["notebook", "frame", "col_name"], ["to_frame", "to_col"]
    base = base.withColumn("pos", F.col("pos").cast("bigint")).select(*FRAME_COL)
    schemas = frame_schemas(ops, args, base, stretch)
    marked = F.concat(F.lit(_MARK), "frame", F.lit(_MARK), "col_name")
    as_sources = schemas.select("notebook", "frame", F.posexplode("names").alias("pos", "col_name")).select(
        "notebook", "frame", (F.col("pos") + 1).cast("bigint").alias("pos"), "col_name",
        F.col("frame").alias("src_ref"), F.col("col_name").alias("src_column"), marked.alias("transform"))
    makes = ops.join(growing(schemas.select("notebook", F.col("frame").alias("out_frame"))), ["notebook", "out_frame"], "left_semi").filter("left_frame IS NOT NULL")
    maps = cut_lineage(apply_ops(makes, args, as_sources))

    # A row's transform is its source's (own), or a text, or that of another column (a pointer).
    parts = F.split("transform", _MARK)
    pointed = F.coalesce(F.startswith("transform", F.lit(_MARK)), F.lit(False))
    at_frame, at_col = F.when(pointed, parts[1]), F.when(pointed, parts[2])
    own = F.coalesce((at_frame == F.col("src_ref")) & (at_col == F.col("src_column")), F.lit(False))
    none = F.lit(None).cast("string")
    sources = maps.select(
        *key, "pos", F.col("src_ref").alias("to_frame"), F.col("src_column").alias("to_col"), F.col("src_column").isNull().alias("done"), own.alias("own"),
        F.when(~pointed, F.col("transform")).alias("text"), F.when(~own, at_frame).alias("ptr_frame"), F.when(~own, at_col).alias("ptr_col"))
    ends = base.select(
        *key, "pos", F.col("src_ref").alias("to_frame"), F.col("src_column").alias("to_col"), F.lit(True).alias("done"), F.lit(False).alias("own"),
        F.col("transform").alias("text"), none.alias("ptr_frame"), none.alias("ptr_col"))

    def compose(resolved: Rounds, waiting: DataFrame, at: list[str], passed: list[str]) -> DataFrame:
        """Rows that wait at another column go on where that column's rows end; ``passed`` is taken over from those."""
        while not waiting.isEmpty():
            inner = resolved.table().unionByName(waiting).select(
                "notebook", F.col("frame").alias(at[0]), F.col("col_name").alias(at[1]), F.struct("done", *{*at, *passed}).alias("i"))
            through = waiting.drop("done").join(growing(inner), ["notebook", *at])
            taken = F.col("own") if "own" in waiting.columns else F.lit(True)
            moved = cut_lineage(through.select(
                *key, *(F.when(taken, F.col(f"i.{c}")).otherwise(F.col(c)).alias(c) for c in passed), *(F.col(f"i.{c}") for c in ("done", *at) if c not in passed),
                *(c for c in waiting.columns if c not in {*key, "done", *at, *passed})).select(waiting.columns).distinct())
            resolved.add(moved.filter("done"))
            waiting = moved.filter("NOT done")
        return resolved.table()

    resolved = Rounds(spark)
    resolved.add(ends.unionByName(sources.filter("done")))
    found = compose(resolved, sources.filter("NOT done"), to, ["own", "text", "ptr_frame", "ptr_col"])
    sourced = F.max(F.col("to_col").isNotNull()).over(Window.partitionBy(*key))
    found = cut_lineage(found.withColumn("_sourced", sourced).filter(F.col("to_col").isNotNull() | ~F.col("_sourced")).drop("_sourced", "own", "done"))

    pointing = found.filter("ptr_frame IS NOT NULL")
    needed = pointing.select("notebook", "ptr_frame", "ptr_col").distinct()
    if not needed.isEmpty():
        texts, at = Rounds(spark), ["ptr_frame", "ptr_col"]
        texts.add(found.filter("ptr_frame IS NULL").join(
            growing(needed.withColumnsRenamed({"ptr_frame": "frame", "ptr_col": "col_name"})), key, "left_semi").groupBy(*key).agg(
            F.max("text").alias("text")).select(*key, F.lit(True).alias("done"), "text", none.alias("ptr_frame"), none.alias("ptr_col")))
        waiting = pointing.join(
            growing(needed.withColumnsRenamed({"ptr_frame": "frame", "ptr_col": "col_name"})), key, "left_semi").select(
            *key, F.lit(False).alias("done"), "text", *at).distinct()
        told = compose(texts, waiting, at, ["text", *at]).groupBy(
            "notebook", F.col("frame").alias("ptr_frame"), F.col("col_name").alias("ptr_col")).agg(F.max("text").alias("told"))
        pointing = pointing.join(growing(told), ["notebook", *at], "left").withColumn("text", F.col("told")).select(found.columns)
    whole = found.filter("ptr_frame IS NULL").unionByName(pointing)
    return whole.select(
        *key, "pos", F.col("to_frame").alias("src_ref"), F.col("to_col").alias("src_column"), F.col("text").alias("transform")
    ).select(*FRAME_COL).distinct()


# -- temp views ----------------------------------------------------------------

_VIEW_COL = ["notebook", "view_name", "col_name", "src_kind", "src_name", "src_column", "transform"]


def flatten_views(view_col: DataFrame) -> DataFrame:
    """View columns resolved to base tables through views on views.

    Each round sends every open row through the row it points at, which has moved
    on as well: the distance doubles, and a chain of n views needs about log2(n)
    joins. Only open rows are joined and written again. The number of views in a
    notebook bounds every chain; what is open after that goes round a cycle and
    has no base table. An inner transform is inherited where the outer column is
    a plain pass-through.
    """
    spark = view_col.sparkSession
    base = cut_lineage(view_col.select(*_VIEW_COL).distinct())
    longest = base.groupBy("notebook").agg(F.count_distinct("view_name").alias("n")).agg(F.max("n")).first()[0] or 1
    resolved, waiting, step = Rounds(spark), base.filter("src_kind = 'view'"), 1
    resolved.add(base.filter("src_kind = 'table'"))
    while step < longest and not waiting.isEmpty():
        inner = resolved.table().unionByName(waiting).select(
            "notebook", F.col("view_name").alias("src_name"), F.col("col_name").alias("src_column"),
            F.col("src_kind").alias("_k"), F.col("src_name").alias("_n"), F.col("src_column").alias("_c"), F.col("transform").alias("_t"))
        through = waiting.drop("src_kind").join(growing(inner), ["notebook", "src_name", "src_column"]).select(
            "notebook", "view_name", "col_name", F.col("_k").alias("src_kind"), F.col("_n").alias("src_name"),
            F.col("_c").alias("src_column"), F.coalesce("transform", "_t").alias("transform"))
        moved = cut_lineage(through.distinct())
        resolved.add(moved.filter("src_kind = 'table'"))
        waiting = moved.filter("src_kind = 'view'")
        step *= 2
    return resolved.table().distinct().select(
        "notebook", "view_name", "col_name", F.col("src_name").alias("src_ref"), "src_column", "transform")


def view_base_refs(flat: DataFrame) -> DataFrame:
    """The real tables each view reads."""
    return flat.filter("src_ref IS NOT NULL AND src_ref <> ''").select("notebook", "view_name", "src_ref").distinct()


# -- flows of writes -----------------------------------------------------------

_FLOW_KEY = ["to_table", "to_column", "from_table", "from_column"]


def write_flows(writes: DataFrame, frames: DataFrame, views: DataFrame) -> DataFrame:
    """Column flows of each write; writing into a temp view writes nothing.

    ``writes``: notebook, seq, frame, target. A column without a source gives no flow.
    """
    known = views.select("notebook", F.col("view_name").alias("_key")).distinct()
    return (
        writes.withColumn("_key", refs.normalise_view_name(F.col("target")))
        .join(growing(known), ["notebook", "_key"], "left_anti")
        .join(growing(frames.filter("src_column IS NOT NULL")), ["notebook", "frame"])
        .select(
            "notebook", "seq", F.col("target").alias("to_table"), F.col("col_name").alias("to_column"),
            F.nullif("src_ref", F.lit("")).alias("from_table"), F.col("src_column").alias("from_column"), "transform")
    )


def dedupe_flows(flow: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """One flow per (to, from) key, the first by ``order``; unknown owners are one key."""
    rest = [c for c in flow.columns if c not in by + _FLOW_KEY]
    return (
        flow.groupBy(*by, *_FLOW_KEY)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*by, *_FLOW_KEY, *[F.col(f"_r.{c}").alias(c) for c in rest])
        .select(flow.columns)
    )


def prefer_sql_targets(sql_flow: DataFrame, frame_flow: DataFrame, by: list[str]) -> DataFrame:
    """A target that a SQL statement resolved keeps only the SQL flows."""
    resolved = sql_flow.select(*by, "to_table").distinct()
    return sql_flow.unionByName(frame_flow.join(growing(resolved), [*by, "to_table"], "left_anti"))


def fill_written_schema(schema: DataFrame, outputs: DataFrame, by: list[str]) -> DataFrame:
    """Given schemas, plus the output columns of written tables that have none.

    ``outputs``: keys, ref, seq, name; types stay unknown and columns keep the
    order in which they were first seen.
    """
    given = schema.select(*by, "ref").distinct()
    first_seen = outputs.join(growing(given), [*by, "ref"], "left_anti").groupBy(*by, "ref", "name").agg(F.min("seq").alias("_seq"))
    filled = number_rows(first_seen, [*by, "ref"], ["_seq", "name"], "pos").withColumn("type", F.lit(None).cast("string"))
    columns = [*by, "ref", "pos", "name", "type"]
    return schema.select(*columns).unionByName(filled.select(*columns))


def merge_star_flows(merges: DataFrame, schema: DataFrame, by: list[str]) -> DataFrame:
    """``SET *`` / ``INSERT *``: source columns into their namesakes in the target.

    A target whose columns are not known takes every source column.
    """
    key = [*by, "target", "source"]
    source = merges.join(growing(schema.select(*by, F.col("ref").alias("source"), "name")), [*by, "source"]).select(*key, "name")
    target = schema.select(*by, F.col("ref").alias("target"), "name").distinct()
    known = target.select(*by, "target").distinct().withColumn("_known", F.lit(True))
    return (
        source.join(growing(known), [*by, "target"], "left")
        .join(growing(target.withColumn("_same", F.lit(True))), [*by, "target", "name"], "left")
        .filter("_known IS NULL OR _same")
        .select(*by, F.col("target").alias("to_table"), F.col("name").alias("to_column"),
                F.col("source").alias("from_table"), F.col("name").alias("from_column"), F.lit(None).cast("string").alias("transform"))
        .distinct()
    )


def merge_assign_flows(clauses: DataFrame, aliases: DataFrame, by: list[str]) -> DataFrame:
    """``SET a = x`` and ``INSERT (cols) VALUES (vals)``: columns and values pair by position.

    ``clauses``: keys, target, columns array<string>, values
    array<struct<alias, column, transform>>; differing lengths give nothing. An
    unqualified column, or an alias nothing defines, has no known owner.
    """
    pairs = (
        clauses.filter(F.size("columns") == F.size("values"))
        .select(*by, "target", F.explode(F.arrays_zip("columns", "values")).alias("z"))
        .select(*by, F.col("target").alias("to_table"), F.col("z.columns").alias("to_column"),
                F.col("z.values.alias").alias("alias"), F.col("z.values.column").alias("from_column"), F.col("z.values.transform").alias("transform"))
    )
    return (
        pairs.filter("to_column <> '' AND from_column IS NOT NULL")
        .join(growing(aliases.select(*by, "alias", F.col("ref").alias("from_table"))), [*by, "alias"], "left")
        .select(*by, *_FLOW_KEY, "transform")
        .distinct()
    )


def plain_or_transform(flow: DataFrame, keep_renames: bool = False) -> DataFrame:
    """Transform is null for a bare column; ``keep_renames`` notes a changed name instead."""
    bare = F.col("is_bare_column")
    rename = F.when(F.lit(keep_renames) & (F.col("from_column") != F.col("to_column")), F.concat(F.col("from_column"), F.lit(" AS "), F.col("to_column")))
    return flow.withColumn("transform", F.when(bare, rename).otherwise(F.col("transform"))).drop("is_bare_column")


def resolve_unowned(flow: DataFrame, schema: DataFrame, access: DataFrame, by: list[str]) -> DataFrame:
    """Give an unowned flow the one READ table of its run that has the column; a tie drops it.

    The candidates are reduced to (count, any) per column before they meet the
    flows, so a column that many tables share never multiplies rows.
    """
    read = access.filter("mode = 'read'").select(*by, "ref").distinct()
    owner = (
        schema.select(*by, "ref", F.col("name").alias("from_column")).join(growing(read), [*by, "ref"], "left_semi").distinct()
        .groupBy(*by, "from_column").agg(F.count("*").alias("_n"), F.min("ref").alias("_owner"))
    )
    owned = flow.filter("from_table IS NOT NULL")
    found = flow.filter("from_table IS NULL").join(growing(owner.filter("_n = 1")), [*by, "from_column"]).withColumn("from_table", F.col("_owner"))
    return owned.unionByName(found.select(flow.columns))


# -- schemas along a sequence --------------------------------------------------


def carry_schemas(steps: DataFrame, schema_sets: DataFrame, by: list[str]) -> DataFrame:
    """What each step knows of each ref: fetched columns, else the newest earlier ones.

    ``steps``: keys, ref, step_seq of every access; ``schema_sets``: keys, ref,
    step_seq, columns (non-empty). A later step's own answer is never overridden.
    """
    ordered = Window.partitionBy(*by, "ref").orderBy("step_seq")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return (
        steps.join(schema_sets, [*by, "ref", "step_seq"], "full_outer")
        .withColumn("carried", F.last("columns", ignorenulls=True).over(earlier))
        .select(
            *by, "ref", "step_seq",
            F.coalesce("columns", "carried").alias("columns"),
            F.when(F.col("columns").isNotNull(), "fetched").when(F.col("carried").isNotNull(), "carried").otherwise("unknown").alias("origin"))
    )


def schema_resolution(requested: DataFrame, fetched: DataFrame, carried: DataFrame, failures: DataFrame, by: list[str]) -> DataFrame:
    """State of each requested schema; carried is known, hence not unresolved."""
    key = [*by, "ref"]
    no = F.lit(False)

    def fact(df, requested=no, fetched=no, carried=no, failure=F.lit(None).cast("string")):
        return df.select(*key, requested.alias("_requested"), fetched.alias("_fetched"), carried.alias("_carried"), failure.alias("failure"))

    # One grouping of all four instead of three joins, each on its own shuffle; a key with a null meets nothing.
    yes = F.lit(True)
    stacked = (
        fact(requested, requested=yes)
        .unionByName(fact(fetched.dropna(subset=key), fetched=yes))
        .unionByName(fact(carried.dropna(subset=key), carried=yes))
        .unionByName(fact(failures.dropna(subset=key), failure=F.col("failure")))
    )
    flags = [F.bool_or(c).alias(c) for c in ("_requested", "_fetched", "_carried")]
    return (
        stacked.groupBy(*key).agg(*flags, F.min("failure").alias("failure")).filter("_requested")
        .select(*key, F.when(F.col("_fetched"), "resolved").when(F.col("_carried"), "carried").otherwise("unresolved").alias("state"), "failure")
    )
