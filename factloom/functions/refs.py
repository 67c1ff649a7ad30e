"""Table identity as Column expressions: ``workspace/lakehouse/table``.

Everything here is built-in Spark SQL, so it stays in the JVM and can be used in
a projection, a join key or inside a higher-order function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import fixed
from factloom.session import growing

#: bytes of a name map that each executor, and the driver that sends it, may hold
HELD = 100 << 20
_SPACE = " \t\n\r\f\x0b"


def _text(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def _escape(part: Column) -> Column:
    part = F.coalesce(part, F.lit(""))
    return F.replace(F.replace(part, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))


def _unescape(part: Column) -> Column:
    part = F.replace(F.replace(part, F.lit("%2F"), F.lit("/")), F.lit("%2f"), F.lit("/"))
    return F.replace(part, F.lit("%25"), F.lit("%"))


def make_ref(table, lakehouse="", workspace="") -> Column:
    """Canonical ref; a null or empty part means *unknown*."""
    return F.concat_ws("/", _escape(_text(workspace)), _escape(_text(lakehouse)), _escape(_text(table)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _record(**fields) -> Column:
    return F.named_struct(*[part for name, value in fields.items() for part in (F.lit(name), value)])


def _workspace(ref: Column) -> Column:
    return _unescape(F.when(_slashes(ref) >= 2, F.substring_index(ref, "/", 1)).otherwise(F.lit("")))


def _lakehouse(ref: Column) -> Column:
    second = F.substring_index(F.substring_index(ref, "/", 2), "/", -1)
    first = F.substring_index(ref, "/", 1)
    return _unescape(F.when(_slashes(ref) >= 2, second).when(_slashes(ref) == 1, first).otherwise(F.lit("")))


def _table(ref: Column) -> Column:
    two = F.substring_index(ref, "/", 2)
    rest = F.when(F.length(two) < F.length(ref), F.substr(ref, F.length(two) + 2)).otherwise(F.substring_index(ref, "/", -1))
    return _unescape(rest)


def _slashes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("/"), F.lit("")))


def parse_ref(ref: Column) -> Column:
    """``struct<workspace, lakehouse, table>``; one part is a table, two are lakehouse/table."""
    return _record(workspace=_workspace(ref), lakehouse=_lakehouse(ref), table=_table(ref))


def _names_file(table: Column) -> Column:
    return (table == "Files") | F.lower(table).startswith("files/")


def is_file_ref(ref: Column) -> Column:
    """Whether the ref names the raw file layer rather than a table."""
    return _names_file(_table(ref))


def ref_kind(ref: Column) -> Column:
    return F.when(is_file_ref(ref), F.lit("file")).otherwise(F.lit("table"))


def table_ref_parts(ref: Column) -> Column:
    """Parts plus ``resolved`` (the workspace is known) and ``kind``."""
    return _record(
        workspace=_workspace(ref),
        lakehouse=_lakehouse(ref),
        table=_table(ref),
        resolved=(_workspace(ref) != "") & (_table(ref) != ""),
        kind=ref_kind(ref),
    )


def is_qualified(ref: Column) -> Column:
    return (_workspace(ref) != "") & (_lakehouse(ref) != "") & (_table(ref) != "")


def ref_label(ref: Column) -> Column:
    """Display name: the table part, or the ref itself when that is empty."""
    return F.coalesce(F.nullif(_table(ref), F.lit("")), ref)


def ref_workspace(ref: Column) -> Column:
    """Workspace, blank unless the ref is resolved."""
    return F.when(_table(ref) != "", _workspace(ref)).otherwise(F.lit(""))


def ref_lakehouse(ref: Column) -> Column:
    """Lakehouse; known even when the workspace is not."""
    return _lakehouse(ref)


def strip_kind(segment: Column) -> Column:
    return F.regexp_replace(segment, fixed.KIND_SUFFIX, "")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/", -1), lambda s: s != "")


def _last(items: Column) -> Column:
    return F.coalesce(F.try_element_at(items, F.lit(-1)), F.lit(""))


def _path_leaf(path: Column) -> Column:
    """``Files/...`` keeps its whole path; a table path ends at the table folder."""
    def leaf(segments):
        at = F.array_position(F.transform(segments, F.lower), "files").cast("int")
        from_files = F.array_join(F.slice(segments, at, F.size(segments)), "/")
        table = F.filter(segments, lambda s: (F.lower(s) != "tables") & ~F.rlike(s, F.lit(fixed.STORAGE_LEAF)))
        return F.when(at > 0, from_files).otherwise(_last(table))

    return let(path, leaf)


def _drop_first(items: Column) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items), F.lit(1)))


def _clean(raw: Column) -> Column:
    raw = F.btrim(F.coalesce(raw, F.lit("")), F.lit(_SPACE))
    return F.rtrim(F.btrim(F.btrim(raw, F.lit("`")), F.lit("'\"")), F.lit("/"))


def qualify_parts(raw: Column, workspace="", lakehouse="") -> Column:
    """Raw source text -> ``struct<workspace, lakehouse, table, by_path>``.

    ``by_path`` marks the absolute path form, whose parts may be GUIDs that a
    name map can resolve (see ``qualify_refs``).
    """
    workspace, lakehouse = _text(workspace), _text(lakehouse)

    def parts(workspace, lakehouse, table, by_path=False):
        return _record(workspace=workspace, lakehouse=lakehouse, table=table, by_path=F.lit(by_path))

    def absolute(text):
        container = F.regexp_extract(text, fixed.ABFSS, 1)
        generic = F.lower(container) == fixed.GENERIC_CONTAINER
        rest = _segments(F.regexp_extract(text, fixed.ABFSS, 2))
        # The container is the workspace unless it is the generic one.
        path = F.when(generic, rest).otherwise(F.concat(F.array(container), rest))
        return let(path, lambda p: parts(
            F.coalesce(F.get(p, F.lit(0)), F.lit("")),
            strip_kind(F.coalesce(F.get(p, F.lit(1)), F.lit(""))),
            _path_leaf(_drop_first(_drop_first(p))),
            by_path=True,
        ))

    def dotted(text):
        names = F.filter(F.transform(F.split(text, "\\.", -1), lambda p: F.btrim(p, F.lit("`"))), lambda p: p != "")
        return let(names, lambda n: F.when(
            F.size(n) >= 2,
            parts(
                F.when(F.size(n) >= 3, F.try_element_at(n, F.lit(-3))).otherwise(workspace),
                strip_kind(F.try_element_at(n, F.lit(-2))),
                F.try_element_at(n, F.lit(-1)),
            ),
        ).otherwise(parts(workspace, lakehouse, text)))

    return let(_clean(raw), lambda text: (
        F.when(text == "", parts(F.lit(""), F.lit(""), F.lit("")))
        .when(F.rlike(text, F.lit(fixed.ABFSS)), absolute(text))
        .when(F.contains(text, F.lit("/")), parts(workspace, lakehouse, _path_leaf(_segments(text))))
        .when(~F.contains(text, F.lit(".")), parts(workspace, lakehouse, text))
        .otherwise(dotted(text))
    ))


def qualify(raw: Column, workspace="", lakehouse="") -> Column:
    """Raw table reference -> canonical ref, GUIDs kept as identity."""
    return let(
        qualify_parts(raw, workspace, lakehouse),
        lambda p: make_ref(p["table"], p["lakehouse"], p["workspace"]),
    )


def looks_like_ref(value: Column) -> Column:
    value = F.btrim(F.coalesce(value, F.lit("")), F.lit(_SPACE))
    return ~F.lower(value).startswith("abfss://") & (_slashes(value) >= 2)


def as_ref(value: Column, workspace="", lakehouse="") -> Column:
    """Idempotent ``qualify``: a canonical ref passes through."""
    return F.when(looks_like_ref(value), value).otherwise(qualify(value, workspace, lakehouse))


def resolve_ids(df: DataFrame, name_map: DataFrame, columns: list[str], salts: int = 16, held: int = HELD) -> DataFrame:
    """Replace GUIDs in the columns by display names; an unknown GUID stays.

    A map that takes up to ``held`` bytes goes to every executor, each name once, and no row is shuffled. A larger one never goes
    through the driver: it is shuffled with the rows. Rows of one GUID then meet in ``salts`` places instead of one, the map being repeated
    for each, and a value that is null or blank gets a key of its own that nothing matches, so that neither a busy workspace nor
    the rows without one make a heavy key. The size is counted: the optimizer goes by compressed files, which say little about texts made of numbers.
    """
    names = name_map.select(F.lower("guid").alias("_guid"), F.col("name").alias("_name")).filter("_guid IS NOT NULL")
    known = {column: F.coalesce(F.btrim(F.lower(F.col(column))), F.lit("")) != "" for column in columns}
    if _held_bytes(names) <= held:
        out, kept = df, F.broadcast(names)
        for column in columns:
            joined = out.join(kept, F.when(known[column], F.lower(F.col(column))) == F.col("_guid"), "left")
            out = joined.withColumn(column, F.coalesce("_name", column)).drop("_guid", "_name")
        return out
    placed = growing(names.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    out = df.withColumn("_spread", F.xxhash64(*_hashable(df)))  # once: what only this reads need not go through the joins
    for column in columns:
        keyed = out.withColumns({
            "_key": F.when(known[column], F.lower(F.col(column))).otherwise(F.concat(F.lit("\n"), F.col("_spread").cast("string"))),
            "_salt": F.pmod("_spread", F.lit(salts)).cast("int")})
        joined = keyed.join(placed, (F.col("_key") == F.col("_guid")) & (F.col("_salt") == F.col("_place")), "left")
        out = joined.withColumn(column, F.coalesce("_name", column)).drop("_key", "_salt", "_guid", "_name", "_place")
    return out.drop("_spread")


def _held_bytes(names: DataFrame) -> int:
    """What the hash table of the map takes: its texts, and room for two rows and a place for each."""
    text = F.octet_length("_guid") + F.coalesce(F.octet_length("_name"), F.lit(0))
    return names.agg(F.coalesce(F.sum(text + F.lit(150)), F.lit(0))).first()[0]


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed: no maps or variants."""
    return [f.name for f in df.schema if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]


def resolve_names(df: DataFrame, column: str, name_map: DataFrame) -> DataFrame:
    """Replace GUIDs in ``column`` by display names; an unknown GUID stays."""
    return resolve_ids(df, name_map, [column])


def qualify_refs(df: DataFrame, raw: str, name_map: DataFrame, workspace="", lakehouse="") -> DataFrame:
    """Adds ``ref``: ``qualify`` with the parts of absolute paths resolved by name."""
    parts = ("table", "lakehouse", "workspace")
    parsed = df.withColumn("_p", qualify_parts(F.col(raw), workspace, lakehouse))
    ids = parsed.withColumns({f"_id_{p}": F.when(F.col("_p.by_path"), F.col(f"_p.{p}")) for p in parts})
    resolved = resolve_ids(ids, name_map, [f"_id_{p}" for p in parts])
    return resolved.withColumn("ref", make_ref(*[F.coalesce(f"_id_{p}", f"_p.{p}") for p in parts])).select(*df.columns, "ref")


def referenced_workspace_ids(cells: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct workspace GUIDs named by absolute paths per ``keys``, first spelling kept."""
    found = cells.select(
        *keys,
        *order,
        F.posexplode(F.regexp_extract_all("source", F.lit(fixed.ABFSS_WORKSPACE), F.lit(1))).alias("_at", "guid"),
    )
    first = F.struct(*order, "_at")
    return (
        found.groupBy(*keys, F.lower("guid").alias("guid_key"))
        .agg(F.min_by("guid", first).alias("guid"))
        .select(*keys, "guid")
    )


def normalise_view_name(raw: Column) -> Column:
    """Registry key of a temp view, or null when the text cannot name one."""
    value = F.btrim(F.coalesce(raw, F.lit("")), F.lit(_SPACE))
    value = F.btrim(F.btrim(F.btrim(value, F.lit("`")), F.lit("'\"")), F.lit(_SPACE))
    value = F.regexp_replace(value, r"(?i)^global_temp\.", "")
    return F.when(F.rlike(value, F.lit(r"^[\p{L}_][\p{L}\p{N}_]*$")), F.lower(value))


def copy_column_name(name: Column, path: Column) -> Column:
    """Flat name of a mapping side, else the LAST segment of its JSON path."""
    flat = F.btrim(F.coalesce(name, F.lit("")), F.lit(_SPACE))
    path = F.coalesce(path, F.lit(""))
    bracket = F.regexp_extract_all(path, F.lit(fixed.JSON_PATH_LEAF), F.lit(1))
    dotted = F.regexp_extract_all(path, F.lit(fixed.JSON_PATH_LEAF), F.lit(2))
    leaf = F.concat(_last(bracket), _last(dotted))
    return F.when(flat != "", flat).otherwise(leaf)


def activity_label(name: Column) -> Column:
    leaf = F.element_at(F.split(name, fixed.NAME_SEPARATOR, -1), -1)
    return F.regexp_replace(leaf, r"^(?i:run|invoke|execute|call)\s+(?=\S)", "")


def activity_depth(name: Column) -> Column:
    return F.size(F.split(name, fixed.NAME_SEPARATOR, -1)) - 1


def stage_rank(lakehouse: Column) -> Column:
    """Medallion rank of a lakehouse name, -1 when it names no stage."""
    def ranked(low):
        rank = None
        for position, stage in enumerate(fixed.STAGES):
            hit = F.contains(low, F.lit(stage)) & F.rlike(low, F.lit(f"(^|[^a-z]){stage}([^a-z]|$)"))
            rank = F.when(hit, position) if rank is None else rank.when(hit, position)
        return rank.otherwise(-1)

    return let(F.lower(F.coalesce(lakehouse, F.lit(""))), ranked)


def stage_label(rank: Column) -> Column:
    names = F.array(*[F.lit(s.capitalize()) for s in fixed.STAGES])
    return F.coalesce(F.get(names, F.when(rank >= 0, rank)), F.lit("Unstaged"))
