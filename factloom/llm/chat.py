"""Chat formatting: heterogeneous layouts to canonical turns, and turns to text with a loss mask.

The nested field paths of a record, as far as any layout knows them, are hashed to a
fingerprint; the fingerprint selects a declarative mapping to canonical turns (role, text). Tables
have one fingerprint, that of their schema; JSON records each have their own.

A conversation is formatted as marked turns. Control strings inside texts are escaped, so
that the text reads back exactly: ``~`` becomes ``~0``, ``<|`` becomes ``~1`` and, in roles, a line feed ``~2``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.tables import save

START, END = "<|im_start|>", "<|im_end|>\n"
#: Layouts as declarations. ``rows``: one turn per row. ``list``: a list of turns under a field. ``fields``: one turn per
#: (role, fields), the fields that are there joined by an empty line, a turn without any left out.
LAYOUTS = {
    "rows": {"rows": ("conv_id", "turn", "role", "text")},
    "messages": {"list": ("messages", "role", "content")},
    "conversations": {"list": ("conversations", "from", "value")},
    "dialogue": {"list": ("dialogue", "speaker", "text")},
    "instruction": {"fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    "instruction_input": {"fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
    "instruction_system": {"fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    "prompt_completion": {"fields": (("user", ("prompt",)), ("assistant", ("completion",)))},
    "prompt_response": {"fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    "system_prompt_response": {"fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    "question_answer": {"fields": (("user", ("question",)), ("assistant", ("answer",)))},
}
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layout_paths(layout: dict) -> list[str]:
    """The nested field paths of a layout, sorted."""
    if "rows" in layout:
        return sorted(layout["rows"])
    if "list" in layout:
        field, role, text = layout["list"]
        return sorted([field, f"{field}[].{role}", f"{field}[].{text}"])
    return sorted({f for _, fields in layout["fields"] for f in fields})


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


KNOWN_PATHS = sorted({p for layout in LAYOUTS.values() for p in layout_paths(layout)})
FINGERPRINTS = {fingerprint(layout_paths(layout)): name for name, layout in LAYOUTS.items()}
_BY_SIZE = sorted(LAYOUTS, key=lambda name: -len(layout_paths(LAYOUTS[name])))


def schema_paths(schema: T.StructType) -> list[str]:
    """The nested field paths of a schema that some layout knows."""
    paths = []
    for field in schema:
        paths.append(field.name)
        kind = field.dataType
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            paths += [f"{field.name}[].{inner.name}" for inner in kind.elementType]
    return sorted(p for p in paths if p in KNOWN_PATHS)


def json_paths(record: Column) -> Column:
    """The same of a JSON object: its keys, and those of the first element of the lists that some layout knows."""
    none = F.array().cast("array<string>")
    lists = sorted({p.split("[]")[0] for p in KNOWN_PATHS if "[]" in p})

    def inner(name):
        keys = F.json_object_keys(F.get_json_object(record, f"$.{name}[0]"))
        return F.transform(F.coalesce(keys, none), lambda k: F.concat(F.lit(f"{name}[]."), k))

    nested = [inner(name) for name in lists]
    paths = F.concat(F.coalesce(F.json_object_keys(record), none), *nested)
    return F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, KNOWN_PATHS))))


def _role(role: Column) -> Column:
    named = role
    for other, canonical in ROLES.items():
        named = F.when(role == other, canonical).otherwise(named)
    return F.coalesce(named, F.lit(""))


def _turns(layout: dict, field, elements) -> Column:
    """Turns as array<struct<role, text>>; ``field`` gives a column, ``elements`` a list of maps or structs."""
    if "list" in layout:
        name, role, text = layout["list"]
        return F.transform(elements(name, role, text), lambda e: F.struct(
            _role(e[role].cast("string")).alias("role"), F.coalesce(e[text].cast("string"), F.lit("")).alias("text")))
    said = [F.when(F.coalesce(*map(field, fields)).isNotNull(), F.struct(
        F.lit(role).alias("role"), F.concat_ws("\n\n", *(F.when(field(f) != "", field(f)) for f in fields)).alias("text")))
        for role, fields in layout["fields"]]
    return F.filter(F.array(*said), lambda t: t.isNotNull())


def layout_of(paths: list[str]) -> str | None:
    """The layout of these fingerprinted paths; else, for records with further known fields, the largest layout they hold."""
    exact = FINGERPRINTS.get(fingerprint(paths))
    held = [name for name in _BY_SIZE if set(layout_paths(LAYOUTS[name])) <= set(paths)]
    return exact or (held[0] if held else None)


def table_turns(table: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table, by the layout whose fingerprint its schema has; other columns are ignored."""
    name = layout_of(schema_paths(table.schema))
    if name is None:
        raise ValueError(f"no layout with the fields {schema_paths(table.schema)}")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if name == "rows":
        return table.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    turns = _turns(LAYOUTS[name], lambda c: F.col(c).cast("string"), lambda c, *_: F.col(c))
    return table.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select(
        "conv_id", F.col("turn").cast("bigint"), "t.role", "t.text")


def record_turns(records: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turn, role, text) of JSON records, each by its own fingerprint.

    A record of no known layout, or no JSON object, is one row with null layout, turn, role and text.
    """
    body = F.col(record)
    field = lambda c: F.get_json_object(body, f"$.{c}")
    elements = lambda c, *_: F.from_json(F.get_json_object(body, f"$.{c}"), "array<map<string,string>>")
    marked = records.select(F.col(conv_id).cast("bigint").alias("conv_id"), record, json_paths(body).alias("paths")).withColumn(
        "fingerprint", F.sha2(F.array_join("paths", "\n").cast("binary"), 256))
    layout = F.lit(None).cast("string")
    for name in reversed(_BY_SIZE):
        held = F.size(F.array_except(F.array(*map(F.lit, layout_paths(LAYOUTS[name]))), "paths")) == 0
        layout = F.when(held, name).otherwise(layout)
    for mark, name in FINGERPRINTS.items():
        layout = F.when(F.col("fingerprint") == mark, name).otherwise(layout)
    marked = marked.withColumn("layout", layout)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name in LAYOUTS:
        if name == "rows":
            one = F.array(F.struct(_role(field("role")).alias("role"), F.coalesce(field("text"), F.lit("")).alias("text")))
            turns = F.when(F.col("layout") == name, one).otherwise(turns)
        else:
            turns = F.when(F.col("layout") == name, _turns(LAYOUTS[name], field, elements)).otherwise(turns)
    at = F.when(F.col("layout") == "rows", field("turn").cast("bigint")).otherwise(F.col("turn").cast("bigint"))
    return marked.select("conv_id", "layout", record, F.posexplode_outer(turns).alias("turn", "t")).select(
        "conv_id", "layout", at.alias("turn"), "t.role", "t.text")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("~1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("\n")), F.lit("~1"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, segments) of turns (conv_id, turn, role, text): array<struct<text, loss>>, the output being all texts joined.

    Turns are in order of turn, then role, then text, null first; rows that repeat a turn stay. The loss covers what assistants say.
    """
    said = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    segments = F.flatten(F.transform(said, lambda t: F.array(
        F.struct(F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("~2")), F.lit("\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))))
    return turns.groupBy("conv_id").agg(segments.alias("segments"))


def read_turns(output: Column) -> Column:
    """array<struct<role, text>> read back from formatted output."""
    pieces = F.split(output, START.replace("|", r"\|"))
    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(
        unescaped(F.substring_index(p, "\n", 1)).alias("role"),
        unescaped(F.substr(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p) - F.length(F.substring_index(p, "\n", 1)) - 1 - len(END))).alias("text")))


def digests(conversations: DataFrame) -> DataFrame:
    """Per conversation (conv_id, segments): n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    output = conversations.select(
        "conv_id", F.array_join("segments.text", "").alias("output"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "").alias("lost"))
    read = output.withColumn("turns", read_turns(F.col("output")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("bigint").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.length("output").cast("bigint").alias("formatted_chars"))


def format_table(table: DataFrame) -> DataFrame:
    """A table of conversations, whatever its layout, as formatted output, kept: (conv_id, segments).

    Null texts and roles are empty. Rows without conv_id are one conversation. An empty table gives an empty result.
    """
    return save(formatted(table_turns(table)), "formatted")
