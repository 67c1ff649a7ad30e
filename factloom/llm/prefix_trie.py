"""A trie of the turns that conversations begin with.

Every turn has a fixed-width id, the first 16 bytes of a digest of its role and text, so a conversation is a
byte string, and the conversations are the keys of an adaptive radix tree: inner nodes grow from 4 to 16, 48 and 256
children, and a path without branches is one node. Only depths that are whole turns are nodes of the result.

The keys are dealt to tasks by range, so that each task holds a stretch of the sorted keys, and a
task builds one radix tree per ``CHUNK`` keys. What lies between the first and the last key of a chunk is whole there and leaves it
finished, subtree sums included. The nodes along those two keys may go on in the
neighbouring chunks: their sums so far are two rows, which are merged by the same trees in the next level,
a 2,000th as many rows, until one chunk is left. A turn or a conversation that a third of all conversations share is many
chunks of equal work. Lists of members are hashed from pieces of text, in order, in constant memory.

The turn ids of one conversation, 16 bytes each, travel as one row.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import crc_of, save
from factloom.operators.ordering import number_rows

#: bytes of a turn id
WIDTH = 16
#: keys of one radix tree, and bytes of keys beyond which it takes no more
CHUNK, CHUNK_BYTES = 4096, 8 << 20
#: keys that a tree takes however long they are: two paths stay open, so fewer would make no progress
LEAST = 8
#: the digest of no members
EMPTY = sha256(b"").hexdigest()


# -- the radix tree ------------------------------------------------------------


class Few:
    """Up to 4 or 16 children, sorted by their byte."""

    def __init__(self, room: int, keys=(), children=()):
        self.room, self.keys, self.children = room, bytearray(keys), list(children)

    def find(self, byte: int):
        at = bisect.bisect_left(self.keys, byte)
        return self.children[at] if at < len(self.keys) and self.keys[at] == byte else None

    def put(self, byte: int, child):
        if len(self.keys) == self.room:
            grown = Few(16, self.keys, self.children) if self.room == 4 else Indexed(self.keys, self.children)
            return grown.put(byte, child)
        at = bisect.bisect_left(self.keys, byte)
        self.keys.insert(at, byte)
        self.children.insert(at, child)
        return self

    def ordered(self) -> list:
        return self.children


class Indexed:
    """Up to 48 children, found through an index of all bytes."""

    room = 48

    def __init__(self, keys, children):
        self.index, self.children = bytearray(256), list(children)
        for at, byte in enumerate(keys):
            self.index[byte] = at + 1

    def find(self, byte: int):
        at = self.index[byte]
        return self.children[at - 1] if at else None

    def put(self, byte: int, child):
        if len(self.children) == self.room:
            return Full(self).put(byte, child)
        self.children.append(child)
        self.index[byte] = len(self.children)
        return self

    def ordered(self) -> list:
        return [self.children[at - 1] for at in self.index if at]


class Full:
    """A place for every byte."""

    room = 256

    def __init__(self, fewer: Indexed):
        self.children = [fewer.find(byte) for byte in range(256)]

    def find(self, byte: int):
        return self.children[byte]

    def put(self, byte: int, child):
        self.children[byte] = child
        return self

    def ordered(self) -> list:
        return [c for c in self.children if c is not None]


class Node:
    """``path``: the bytes below the parent's branch; ``rows``: those whose key ends here."""

    __slots__ = ("path", "rows", "branches")

    def __init__(self, path: bytes, rows: list, branches=None):
        self.path, self.rows, self.branches = path, rows, branches or Few(4)


def _shared(a: bytes, at: int, b: bytes) -> int:
    """How many bytes ``a`` from ``at`` on has in common with ``b``."""
    if a.startswith(b, at):
        return len(b)
    low, high = 0, min(len(a) - at, len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[at + low:at + middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class RadixTree:
    def __init__(self):
        self.root = None

    def insert(self, key: bytes, row) -> None:
        if self.root is None:
            self.root = Node(key, [row])
            return
        node, at = self.root, 0
        while True:
            common = _shared(key, at, node.path)
            if common < len(node.path):  # the path parts here
                below = Node(node.path[common + 1:], node.rows, node.branches)
                byte, node.path, node.rows = node.path[common], node.path[:common], []
                node.branches = Few(4).put(byte, below)
            at += common
            if at == len(key):
                node.rows.append(row)
                return
            child = node.branches.find(key[at])
            if child is None:
                node.branches = node.branches.put(key[at], Node(key[at + 1:], [row]))
                return
            node, at = child, at + 1

    def upwards(self) -> Iterator[tuple]:
        """Nodes after their children: node, bytes above its branch, bytes through its path, whether first and last in order."""
        stack = [(self.root, 0, True, True, False)]
        while stack:
            node, above, first, last, done = stack.pop()
            through = above + len(node.path)
            if done:
                yield node, above, through, first, last
                continue
            stack.append((node, above, first, last, True))
            children = node.branches.ordered()
            for at in range(len(children) - 1, -1, -1):
                leads = first and at == 0 and not node.rows
                stack.append((children[at], through + 1, leads, last and at == len(children) - 1, False))


# -- sums over subtrees --------------------------------------------------------


class Sums:
    """What is known of one node of the result: members, the smallest, and what its finished children add."""

    __slots__ = ("n", "low", "kids", "leaves", "saved", "waiting")

    def __init__(self, n=0, low=None, kids=0, leaves=0, saved=0):
        self.n, self.low, self.kids, self.leaves, self.saved, self.waiting = n, low, kids, leaves, saved, []

    def add(self, other: Sums) -> None:
        self.n += other.n
        self.low = other.low if self.low is None else self.low if other.low is None else min(self.low, other.low)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.waiting += other.waiting


class Row:
    """A key with the characters of each turn, the sums of depths 0, 1, ..., and the conversation that ends there, if any."""

    __slots__ = ("key", "chars", "sums", "conv")

    def __init__(self, key, chars, sums, conv=None):
        self.key, self.chars, self.sums, self.conv = key, chars, sums, conv


def prefix_id(key: bytes, depth: int) -> bytes:
    return sha256(key[:depth * WIDTH]).digest()[:WIDTH]


class Chunk:
    """Finished nodes, the rows of the two open paths, and pieces of members of open nodes; ``final``: nothing stays open."""

    def __init__(self, rows: list[Row], final: bool):
        self.nodes, self.open, self.pieces = [], [], []
        tree = RadixTree()
        for row in rows:
            tree.insert(row.key, row)
        first, last = rows[0], rows[-1]
        sides = [{}, {}]
        known = {}  # sums of nodes whose parents wait
        for node, above, through, leads, trails in tree.upwards():
            depth = through // WIDTH
            sums, key, chars = [Sums() for _ in range(depth + 1)], None, None
            for row in node.rows:
                for mine, more in zip(sums, row.sums):
                    mine.add(more)
                key, chars = row.key, row.chars
            for child in node.branches.ordered():
                below, key, chars = known.pop(id(child))
                for mine, more in zip(sums, below):
                    mine.add(more)
            members = [row.conv for row in node.rows if row.conv is not None]
            top = (above - 1) // WIDTH if above else -1
            for d in range(depth, top, -1):
                ends = members if d * WIDTH == through else []
                if (leads or trails) and not final:
                    self._leave(sums[d], key, d, ends)
                    sides[not leads][d] = sums[d]
                else:
                    self._finish(sums, key, chars, d, ends, final)
            known[id(node)] = sums[:top + 1], key, chars
        for row, side in zip((first, last), sides):
            if side:
                deepest = max(side)
                self.open.append(Row(row.key[:deepest * WIDTH], row.chars[:deepest], [side.get(d, Sums()) for d in range(deepest + 1)]))

    def _finish(self, sums, key, chars, d, ends, final):
        own = sums[d]
        own.leaves = own.leaves or 1
        own.saved += (own.n - 1) * (chars[d - 1] if d else 0)
        for record in own.waiting:
            self.nodes.append(record | {"parent_conv_id": own.low})
        # Members of what was open in an earlier level are in its pieces.
        record = {"conv_id": own.low, "depth": d, "n_convs": own.n, "n_children": own.kids, "n_leaves": own.leaves, "saved_tokens": own.saved,
                  "ends_sha256": None if final is not None else sha256(",".join(map(str, ends)).encode()).hexdigest(),
                  "node": prefix_id(key, d) if final is not None else None}
        if d:
            sums[d - 1].add(Sums(kids=1, leaves=own.leaves, saved=own.saved))
            sums[d - 1].waiting.append(record)
        else:
            self.nodes.append(record)

    def _leave(self, sums, key, d, ends):
        own = None
        if sums.waiting or ends:
            own = prefix_id(key, d)
        self.nodes.extend(record | {"parent": own} for record in sums.waiting)
        sums.waiting = []
        if ends:
            self.pieces.append({"node": own, "ids": ",".join(map(str, ends))})


_LISTS = ["n", "low", "kids", "leaves", "saved"]
_OUT = pa.schema([
    ("kind", pa.string()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")),
    ("ends_sha256", pa.string()), ("node", pa.binary()), ("parent", pa.binary()), ("part", pa.int64()), ("chunk", pa.int64()), ("side", pa.int64()),
    ("key", pa.binary()), ("chars", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in _LISTS), ("ids", pa.string())])
_DDL = ("kind string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string, node binary, parent binary, part bigint, chunk bigint, side bigint, key binary, "
        "chars array<bigint>, n array<bigint>, low array<bigint>, kids array<bigint>, leaves array<bigint>, saved array<bigint>, ids string")


def _conversations(batches) -> Iterator[Row]:
    for batch in batches:
        for ids, chars, conv in zip(*(batch.column(c).to_pylist() for c in ("ids", "chars", "conv_id"))):
            yield Row(b"".join(ids), chars, [Sums(1, conv) for _ in range(len(ids) + 1)], conv)


def _open_paths(batches) -> Iterator[Row]:
    for batch in batches:
        for key, chars, *sums in zip(*(batch.column(c).to_pylist() for c in ("key", "chars", *_LISTS))):
            yield Row(key, chars, [Sums(*values) for values in zip(*sums)])


def _chunks(rows: Iterator[Row], limit: int) -> Iterator[list[Row]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.key)
        if len(held) == limit or size > CHUNK_BYTES and len(held) >= LEAST:
            yield held
            held, size = [], 0
    if held:
        yield held


def _merged(batches, level: int, limit: int, last: bool):
    """The rows that chunks of conversations (level 0) or of open paths leave."""
    part = TaskContext.get().partitionId()
    rows = _open_paths(batches) if level else _conversations(batches)
    # None: the first level, where members are at hand.
    final = None if not level else last
    for number, held in enumerate([list(rows)] if last else _chunks(rows, limit)):
        if not held:
            continue
        chunk = Chunk(held, final)
        place = {"part": part, "chunk": number}
        out = [r | {"kind": "node"} for r in chunk.nodes] + [r | {"kind": "piece"} | place for r in chunk.pieces]
        for side, row in enumerate(chunk.open):
            lists = {c: [getattr(s, c) for s in row.sums] for c in _LISTS}
            out.append({"kind": "open", "side": side, "key": row.key, "chars": row.chars} | place | lists)
        for start in range(0, len(out), CHUNK):
            yield pa.RecordBatch.from_pylist(out[start:start + CHUNK], _OUT)


def _hashed(batches):
    """The digest of each node's members, from its pieces in order."""
    node = state = None
    for batch in batches:
        out = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = own, sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["node", "digest"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], ["node", "digest"])


# -- conversations -------------------------------------------------------------


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of a digest of both; the byte count of the role keeps them apart."""
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(said.cast("binary"), 256)), 1, WIDTH)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), id and chars of every turn, by turn (null first), ties by id; null role or text is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = save(
        conversations.where("conv_id is not null").select(
            F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
            turn_id(role, text).alias("id"), F.char_length(text).cast("bigint").alias("chars"))
        .withColumn("salt", F.monotonically_increasing_id()), "trie-turns")
    return save(number_rows(turns, ["conv_id"], ["turn", "id", "salt"], "pos").drop("turn", "salt"), "trie-ordered")


def rebuilt(turns: DataFrame, group: int = 100, borrow: int = 6) -> DataFrame:
    """conv_id, ids and chars: the first turns of the group's first conversation, then one's own after as many.

    ``h`` = crc32(conv_id) modulo ``borrow`` turns are taken from conversation ``conv_id - conv_id % group``, all if it has fewer, none if there
    is no such conversation; a conversation's own first ``h`` turns go. It may have no turn left.
    """
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("size"))
    convs = save(convs.withColumns({
        "h": crc_of("conv_id") % borrow, "base": F.col("conv_id") - F.col("conv_id") % group}), "trie-conversations")
    firsts = save(turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < borrow)).withColumnRenamed("conv_id", "base"), "trie-first-turns")
    found = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").select(
        "conv_id", "h", F.least("h", F.coalesce("base_size", F.lit(0))).alias("taken"))
    taken = convs.join(firsts, "base").where("pos <= h").select("conv_id", F.col("pos").alias("d"), "id", "chars")
    own = turns.join(save(found, "trie-taken"), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "id", "chars")
    none = convs.select("conv_id", F.lit(0).cast("bigint").alias("d"), F.lit(b"").alias("id"), F.lit(0).cast("bigint").alias("chars"))
    said = taken.unionByName(own).unionByName(none).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("d", "id", "chars"))).alias("said"))
    said = said.withColumn("said", F.slice("said", 2, F.size("said")))
    return said.select("conv_id", F.col("said.id").alias("ids"), F.col("said.chars").alias("chars"))


def trie(keys: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The nodes of the trie over conversations (conv_id, ids, chars), as told in :func:`prefix_trie`."""
    keys = save(keys, "trie-keys")
    dealt, level, rows, closed = keys.repartitionByRange("ids", "conv_id").sortWithinPartitions("ids", "conv_id"), 0, None, []
    while True:
        last = level > 0 and rows <= chunk
        merged = save(dealt.mapInArrow(functools.partial(_merged, level=level, limit=chunk, last=last), _DDL), "trie-level")
        closed.append(merged.where("kind = 'node'"))
        if last:
            break
        if not level:
            pieces = merged.where("kind = 'piece'").select("node", "ids", "part", "chunk")
        paths = merged.where("kind = 'open'")
        rows, level = paths.count(), level + 1
        place = ["part", "chunk", "side"]
        parts = -(-rows // (4 * chunk))  # several chunks a task
        dealt = (paths.repartition(1) if rows <= chunk else paths.repartitionByRange(parts, *place)).sortWithinPartitions(*place)

    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "node", "parent_conv_id"]
    nodes = functools.reduce(DataFrame.unionByName, closed)
    late = functools.reduce(DataFrame.unionByName, closed[1:])
    # A node that was closed before its parent waits for the parent's smallest member.
    parents = late.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.where("parent is null").select(columns).unionByName(
        nodes.where("parent is not null").drop("parent_conv_id").join(parents, "parent").select(columns))
    digests = pieces.repartition("node").sortWithinPartitions("node", "part", "chunk").select("node", "ids").mapInArrow(_hashed, "node binary, digest string")
    told = nodes.where("node is null").select(*columns[:7], "parent_conv_id").unionByName(
        nodes.where("node is not null").join(save(digests, "trie-members"), "node", "left")
        .withColumn("ends_sha256", F.coalesce("digest", F.lit(EMPTY))).select(*columns[:7], "parent_conv_id"))
    return told


def prefix_trie(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per distinct beginning of rebuilt conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A node is a sequence of turns (role, text), from the root without turns; its members are the conversations that begin with
    it. conv_id is the smallest member, parent_conv_id the parent's (root: null). ``saved_tokens`` sums, over the subtree,
    the code points of a node's last text times its members but one. ``ends_sha256`` is of the members that end there, by number.

    Null role or text is empty; a null turn comes first; turns of one number are in the order of their ids; repeated rows
    are turns of their own. Rows without conv_id belong to no conversation and are left out. Other columns are
    ignored. An empty table has no node.
    """
    return trie(rebuilt(ordered_turns(conversations)), chunk)
