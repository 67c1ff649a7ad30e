"""A Merkle manifest of a dataset: a tree of digests per source, and one over the sources.

Nodes are numbered within their tree and cut into aligned blocks of ``FANOUT ** LEVELS`` consecutive ones. A task
holds one block at a time and builds its levels; the roots of the blocks are the nodes of the next layer, which is cut
into blocks again, until every tree has one node. No task sees a whole tree: a source of any size is many blocks, and a
layer has a 4,096th of the nodes of the one below.

The tree is persistent. A changed leaf makes a version: its ancestors within the block are copied, all other nodes
are shared with the original. Above the block a version goes on with the siblings of the block's own root, which come
down through the layers once per block, as the first row of its stream.

Digests are lowercase hex SHA-256, inputs concatenated as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import save
from factloom.operators.ordering import number_rows

FANOUT = 16
LEVELS = 3
BLOCK = FANOUT ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_HEX = 64

_PATH = "array<struct<before:string,after:string>>"
_NODE = "tree binary, pos bigint, digest string"
#: what a stream of a block holds: its header (pos null: path, subroot, root), then its nodes
_STREAM = {"tree": "binary", "block": "bigint", "pos": "bigint", "digest": "string", "changed": "string", "doc_id": "bigint",
           "path": _PATH, "subroot": "string", "root": "string"}


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(values: dict[str, Column] | None = None) -> Column:
    """The digest of a row: each of ``FIELDS`` as its UTF-8 byte count, a colon and its text, or ``-`` if null."""
    def field(name):
        text = (values or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)).cast("binary"), 256)


class Block:
    """Consecutive nodes of a tree and the levels above them; ``whole`` if they are all nodes of the tree."""

    def __init__(self, digests: list[str], whole: bool):
        self.runs, nodes = [], digests
        while len(nodes) > 1 if whole else len(self.runs) < LEVELS:
            self.runs.append(["".join(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)])
            nodes = [digest(run) for run in self.runs[-1]]
        self.root = nodes[0]

    def siblings(self, place: int) -> list[tuple[str, str]]:
        """Per level, from the bottom, the digests before and after the node over ``place`` in its run."""
        path = []
        for runs in self.runs:
            place, own = divmod(place, FANOUT)
            path.append((runs[place][:_HEX * own], runs[place][_HEX * (own + 1):]))
        return path

    def version(self, place: int, changed: str) -> list[str]:
        """The copied nodes of the version in which the node at ``place`` is ``changed``, up to the block's root."""
        copied = [changed]
        for before, after in self.siblings(place):
            copied.append(digest(before + copied[-1] + after))
        return copied


def _blocks(batches) -> Iterator[tuple]:
    """(tree, block, header, rows) of a stream sorted by tree, block and pos."""
    key, header, rows = None, None, []
    for batch in batches:
        names = batch.schema.names
        for values in zip(*(column.to_pylist() for column in batch.columns)):
            row = dict(zip(names, values))
            if (row["tree"], row["block"]) != key:
                if key is not None:
                    yield *key, header, rows
                key, header, rows = (row["tree"], row["block"]), None, []
            if row["pos"] is None:
                header = row
            else:
                rows.append(row)
    if key is not None:
        yield *key, header, rows


def _built(block: int, rows: list[dict]) -> Block:
    return Block([r["digest"] for r in rows], whole=block == 0 and len(rows) < BLOCK)


def _batches(rows: Iterator[tuple], schema: pa.Schema):
    part = []
    for row in rows:
        part.append(row)
        if len(part) == BLOCK:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)
            part = []
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


_PA_NODE = pa.schema([("tree", pa.binary()), ("pos", pa.int64()), ("digest", pa.string())])
_PA_PATHS = pa.schema([("tree", pa.binary()), ("block", pa.int64()),
                       ("path", pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))])
_PA_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")),
                        ("verified", pa.bool_()), ("copied", pa.int64())])
_RESULT = ("doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
           "verified boolean, copied bigint")


def _roots(batches):
    return _batches(((tree, block, _built(block, rows).root) for tree, block, _, rows in _blocks(batches)), _PA_NODE)


def _lowered(batches):
    """The path of every node, as the header of the block it is the root of."""
    def paths():
        for tree, block, header, rows in _blocks(batches):
            built = _built(block, rows)
            for place, row in enumerate(rows):
                own = [{"before": b, "after": a} for b, a in built.siblings(place)]
                yield tree, row["pos"], own + header["path"]

    return _batches(paths(), _PA_PATHS)


def _fold(node: str, path: list[dict]) -> str:
    for step in path:
        node = digest(step["before"] + node + step["after"])
    return node


def _verified(batches):
    def results():
        for _, block, header, rows in _blocks(batches):
            built, path, root = _built(block, rows), header["path"], header["root"]
            upper = "".join(step["before"] + step["after"] for step in path)
            original = _fold(built.root, path)  # shared by all versions that change nothing
            for place, row in enumerate(rows):
                changed = row["changed"] or row["digest"]
                version = built.version(place, changed)
                folded = original if version[-1] == built.root else _fold(version[-1], path)
                proof = digest("".join(b + a for b, a in built.siblings(place)) + upper)
                copied = 0 if changed == row["digest"] else len(version) + len(path)
                yield row["doc_id"], row["digest"], header["subroot"], root, proof, folded, folded == root, copied

    return _batches(results(), _PA_RESULT)


def _streams(*tables: DataFrame) -> DataFrame:
    """Rows of blocks dealt to tasks, each block in one piece, header first."""
    rows = None
    for table in tables:
        full = table.select(*((F.col(c) if c in table.columns else F.lit(None)).cast(t).alias(c) for c, t in _STREAM.items()))
        rows = full if rows is None else rows.unionByName(full)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("bigint"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The layers over ``nodes`` (tree, pos from 0, digest), the given one first; the last has one node a tree."""
    layers = [nodes]
    while len(layers) == 1 or layers[-1].agg(F.max("pos")).first()[0]:
        layers.append(save(_streams(_in_blocks(layers[-1]).select("tree", "block", "pos", "digest")).mapInArrow(_roots, _NODE), "manifest-layer"))
    return layers


def descend(layers: list[DataFrame], headers: DataFrame) -> DataFrame:
    """Headers (tree, block, path) of the blocks of the lowest layer, from those of the highest layer's."""
    for nodes in reversed(layers[1:-1]):
        headers = save(_streams(_in_blocks(nodes), headers).mapInArrow(_lowered, f"tree binary, block bigint, path {_PATH}"), "manifest-paths")
    return headers


@dataclass
class Manifest:
    """``leaves``: tree, pos, digest, changed, doc_id. ``headers`` of their blocks: tree, block, path, subroot, root."""

    leaves: DataFrame
    headers: DataFrame


def build(docs: DataFrame, seen_text: Column) -> Manifest:
    """The manifest of ``docs``; ``seen_text`` is each text as it is found later, null where nothing changed."""
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0")).cast("binary")  # no source comes first
    hashed = save(docs.select(
        tree.alias("tree"), "doc_id", leaf().alias("digest"),
        F.when(seen_text.isNotNull(), leaf({"text": seen_text})).alias("changed")), "manifest-leaves")
    # Equal rows may swap places: the salt lets range partitions cut through many of them.
    hashed = hashed.withColumn("_salt", F.monotonically_increasing_id())
    leaves = save(number_rows(hashed, ["tree"], ["doc_id", "digest", "_salt"], "pos").drop("_salt").withColumn("pos", F.col("pos") - 1), "manifest-numbered")
    layers = climb(leaves.select("tree", "pos", "digest"))
    subroots = save(number_rows(
        layers[-1].select(F.col("tree").alias("own"), "digest", F.lit("").cast("binary").alias("tree")), ["tree"], ["own"], "pos"
    ).withColumn("pos", F.col("pos") - 1), "manifest-subroots")
    forest = climb(subroots.select("tree", "pos", "digest"))
    root = forest[-1].select("tree", F.col("pos").alias("block"), F.array().cast(_PATH).alias("path"))
    tops = _streams(_in_blocks(subroots), descend(forest, root)).mapInArrow(_lowered, f"tree binary, block bigint, path {_PATH}")
    found = forest[-1].select(F.col("digest").alias("root")).first()
    top_headers = save(subroots.join(tops.select(F.col("block").alias("pos"), "path"), "pos").select(
        F.col("own").alias("tree"), F.lit(0).cast("bigint").alias("block"), "path", F.col("digest").alias("subroot")), "manifest-tops")
    subroot = top_headers.select("tree", "subroot")
    headers = descend(layers, top_headers.drop("subroot")).join(subroot, "tree").withColumn("root", F.lit(found[0] if found else None).cast("string"))
    return Manifest(leaves, headers)


def verify(docs: DataFrame, seen_text: Column) -> DataFrame:
    """Per row of ``docs`` (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied.

    A source is a tree of leaves by doc_id (null first; rows of one doc_id by digest); subroots by source (null
    first, bytewise) are the leaves of the tree over all. ``proof_sha256`` is of the leaf's siblings, from the bottom up to the root.
    ``folded_root`` is the root of the version in which the row's text is ``seen_text``; ``verified`` says whether that is
    the root, ``copied`` how many nodes the version does not share. Nulls and empty texts have digests of their own;
    repeated rows are leaves of their own; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", "n_chars", "text", seen_text.cast("string").alias("_seen"))
    manifest = build(docs, F.col("_seen"))
    return _streams(_in_blocks(manifest.leaves), manifest.headers).mapInArrow(_verified, _RESULT)
