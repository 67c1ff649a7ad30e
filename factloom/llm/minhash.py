"""Near-duplicate detection: many universal hash minima with banding, signature
verification, full-set verification, and connected components by alternating
large-star and small-star.

How pairs are found without listing all pairs of a group:

* Texts with equal shingle sets form one class; only classes are compared.
* In each band bucket every class is paired with the bucket's smallest class.
  First only the best such pair of each class is verified on full sets, and
  components are built; then the remaining pairs between different components.
* Buckets that still hold more than one component (shared passages, chance) are
  compared exhaustively, between components only, on signatures, in pairs of
  blocks of bounded size dealt over tasks. A block pair returns no pairs but which of its
  classes hang together, one row for each class at most. Of what hangs together
  by signatures the full sets are compared in the same way.

No bucket or candidate is capped. With 32 bands of 4 minima a pair of similarity
0.75 meets in no bucket with probability 5e-6, and five standard deviations are
allowed in the signature test.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import words
from factloom.llm.tables import save, text_key

BANDS, ROWS, SHINGLE, PERCENT = 32, 4, 5, 75
MINIMA = BANDS * ROWS
BLOCK = 512
_A, _B = words.constants(MINIMA, 101), words.constants(MINIMA, 202)
_BAND = words.constants(ROWS, 303)
_KEYS = words.constants(2, 404)
_DIGEST = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>, signature binary"


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a shorter text is one shingle."""
    w = words.Words(texts, words.NOT_SPACE, lower=True)
    first, hashes = w.windows(size)
    bounds = np.searchsorted(first, w.bounds)
    sets = []
    for i, n in enumerate(w.counts()):
        if n >= size:
            sets.append(np.unique(hashes[bounds[i]:bounds[i + 1]]))
        else:
            own = w.hash[w.bounds[i]:w.bounds[i + 1]]
            sets.append(words.sequence_hash([own[j:j + 1] for j in range(n)]) if n else own)
    return sets


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that name a set: sums of mixed members, whatever their order."""
    return b"".join(int(words.mix64(shingles ^ k).sum(dtype=np.uint64)).to_bytes(8, "little") for k in _KEYS)


def minima(shingles: np.ndarray) -> np.ndarray:
    """Minima of ``(a x + b) mod 2^64 >> 32`` over the set, x being 32 bits of each shingle hash."""
    best = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    x = shingles >> np.uint64(32)
    for i in range(0, x.size, 2048):
        best = np.minimum(best, (_A[:, None] * x[None, i:i + 2048] + _B[:, None]).min(axis=1))
    return best >> np.uint64(32)


def _digest(batches, size):
    for batch in words.parts(batches):
        ids, texts = batch.column(0), words.encoded(batch.column(1))
        for lo, hi in words.slices(texts):
            sets = shingle_sets(texts[lo:hi], size)
            sign = np.array([minima(s) for s in sets], dtype=np.uint64).reshape(len(sets), MINIMA)
            band = words.mix64((sign.reshape(-1, BANDS, ROWS) * _BAND).sum(axis=2) + np.arange(BANDS, dtype=np.uint64))
            full = np.array([s.size > 0 for s in sets], dtype=bool)
            low = (sign & np.uint64(255)).astype(np.uint8)
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                ids.slice(lo, hi - lo),
                pa.array([s.size for s in sets], pa.int64()),
                pa.array([set_key(s) for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(band[full].reshape(-1).view(np.int64))),
                pa.array([low[i].tobytes() if full[i] else b"" for i in range(len(sets))], pa.binary()),
            ], ["doc_id", "n_shingles", "set_key", "bands", "signature"])


def _sets(batches, size):
    """(node, set_key, text) to (node, shingles), where the text has that key."""
    for batch in words.parts(batches):
        nodes, keys, texts = batch.column(0), batch.column(1).to_pylist(), words.encoded(batch.column(2))
        for lo, hi in words.slices(texts):
            sets = shingle_sets(texts[lo:hi], size)
            fit = [i for i, s in enumerate(sets) if set_key(s) == keys[lo + i]]
            yield pa.RecordBatch.from_arrays([
                nodes.take(pa.array([lo + i for i in fit], pa.int64())),
                pa.array([sets[i].tobytes() for i in fit], pa.binary()),
            ], ["node", "shingles"])


def _linked(batches, percent):
    """Pairs whose full sets are similar enough."""
    for batch in words.parts(batches):
        fit = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, y.size - 1)] == x).sum()) if y.size else 0
            fit.append(100 * common >= percent * (x.size + y.size - common))
        yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(fit, pa.bool_()))


def _least(percent: int) -> int:
    """Agreeing minima that a pair of the wanted similarity has but for five standard deviations."""
    p = percent / 100
    return max(1, int(MINIMA * p - 5 * (MINIMA * p * (1 - p)) ** 0.5))


def _agreeing(batches, percent):
    """Pairs whose signatures and sizes allow the similarity."""
    for batch in words.parts(batches):
        sides = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, MINIMA) for i in (2, 3)]
        n = [batch.column(i).to_numpy() for i in (4, 5)]
        fit = ((sides[0] == sides[1]).sum(axis=1) >= _least(percent)) & (100 * np.minimum(*n) >= percent * np.maximum(*n))
        yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), ["a", "b"]).filter(pa.array(fit))


def _groups(batches, keys):
    """Tables of the rows that share the key columns, from batches sorted by them."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(c).to_pylist() for c in keys)))
        starts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for start, end in zip(starts, starts[1:]):
            if held and values[start] != key:
                yield pa.Table.from_batches(held)
                held = []
            key = values[start]
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _hanging(linked: np.ndarray) -> np.ndarray:
    """For each member the first one that it is connected with, by a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        lower = np.minimum(label, np.where(linked, label, len(linked)).min(axis=1, initial=len(linked)))
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compared(table, percent, exact):
    """Links (a, b) that connect the classes of one block pair, at most one row for each class."""
    side, i, j = table.column("side").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    node, comp, n = (table.column(c).to_numpy() for c in ("node", "component", "n"))
    sign = np.frombuffer(b"".join(table.column("signature").to_pylist()), dtype=np.uint8).reshape(-1, MINIMA)
    fit = np.zeros((node.size, node.size), dtype=bool)
    right = np.arange(node.size) if i == j else np.flatnonzero(side == j)
    for x in range(node.size) if i == j else np.flatnonzero(side == i):
        near = right[(comp[right] != comp[x]) & (100 * np.minimum(n[x], n[right]) >= percent * np.maximum(n[x], n[right]))]
        fit[x, near] = (sign[near] == sign[x]).sum(axis=1) >= _least(percent)
    if exact and fit.any():
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("shingles").to_pylist()]
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        first = np.concatenate([[0], np.cumsum([s.size for s in sets])])
        mark = np.zeros(ids.size, dtype=np.int64)
        for x in np.flatnonzero(fit.any(axis=1)):
            own = ids[first[x]:first[x + 1]]
            mark[own] = 1
            common = np.add.reduceat(mark[ids], first[:-1])
            fit[x] &= 100 * common >= percent * (n[x] + n - common)
            mark[own] = 0
    fit |= fit.T
    if exact:
        fit |= comp[:, None] == comp
    label = _hanging(fit)
    a, b = node, node[label]
    return a[a != b], b[a != b]


def _block_links(batches, percent, exact):
    """Rows (grp, i, j, side, node, component, n, signature[, shingles]) sorted by grp, i, j: the links of each block pair."""
    for table in _groups(batches, ("grp", "i", "j")):
        a, b = _compared(table, percent, exact)
        if a.size:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that is not the smallest of its component.

    Alternates large-star (every larger neighbour moves to the smallest one) and
    small-star (the node and every smaller neighbour do) over edges (a, b) until
    an alternation changes nothing. Minima are aggregated before the shuffle and
    written, so both sides of each join are plain exchanges that Spark may split.
    """
    def changed(df):
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return row["n"], row["x"]

    now = save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = changed(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-minima")
        large = save(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "small-minima")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = save(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        before, mark = mark, changed(now)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, a set is a text's distinct shingles.
    Texts are linked from ``percent`` of shared shingles on. A text that is null, empty or without words has no
    shingles and no links: it is its own component, kept. Every row is judged by its own text, also where rows
    repeat a doc_id; a row without doc_id is linked with nothing, has no component and is kept.
    Other columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    digest = save(docs.mapInArrow(functools.partial(_digest, size=shingle), _DIGEST), "digest")
    classes = save(
        digest.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(
            F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"), F.first("signature").alias("signature")), "classes")
    component = _class_components(docs, classes, percent, shingle)
    named = classes.select("set_key", "node").join(component, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component"))
    return (
        digest.join(named, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))
    )


def _class_components(docs: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    rows = classes.select(F.explode("bands").alias("bucket"), "node")
    shared = save(rows.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = save(rows.join(shared, "bucket").select("bucket", "node", "center", "size"), "members")
    stars = save(
        members.where("node <> center").groupBy(F.col("node").alias("a"), F.col("center").alias("b")).agg(F.count("*").alias("bands")), "stars")
    sizes = classes.select("node", "n", "signature")

    def agreeing(pairs):
        return (
            pairs.select("a", "b").join(sizes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n").alias("na")), "a")
            .join(sizes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n").alias("nb")), "b")
            .select("a", "b", "sa", "sb", "na", "nb")
            .mapInArrow(functools.partial(_agreeing, percent=percent), "a bigint, b bigint"))

    def shingles(nodes):
        """The full sets of these classes, made again from their texts."""
        return save(
            nodes.join(classes.select("node", "set_key"), "node").join(docs.withColumnRenamed("doc_id", "node"), "node")
            .select("node", "set_key", "text")
            .mapInArrow(functools.partial(_sets, size=shingle), "node bigint, shingles binary").distinct(), "sets")

    def linked(pairs):
        """Pairs linked by their full sets."""
        sets = shingles(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        return save(
            pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
            .mapInArrow(functools.partial(_linked, percent=percent), "a bigint, b bigint"), "links")

    def across(pairs, component):
        """Pairs between different components."""
        own = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        return pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").where(
            F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(pairs.columns)

    def merged(component, links):
        return components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    best = stars.groupBy("a").agg(F.max(F.struct("bands", (-F.col("b")).alias("b"))).alias("s")).select("a", (-F.col("s.b")).alias("b"))
    first = save(agreeing(best), "pairs")
    component = components(linked(first))
    second = save(agreeing(across(stars, component)), "pairs")
    if not second.isEmpty():
        component = merged(component, linked(second))
    loose = components(_mixed_buckets(members, sizes, component, percent))
    if not loose.isEmpty():
        every = loose.unionByName(loose.select(F.col("component").alias("node"), "component").distinct()).select("node", F.col("component").alias("grp"))
        size = every.groupBy("grp").agg(F.count("*").alias("size"))
        rows = every.join(size, "grp").join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        rows = rows.join(sizes, "node").join(shingles(every.select("node")), "node")
        component = merged(component, _blocks(rows, percent, True))
    return component


def _blocks(rows: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Links within each grp (size rows), found in all pairs of blocks of about ``BLOCK`` of its rows."""
    dealt = (
        rows.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", "component", "n", "signature",
                *(["shingles"] if exact else [])))
    return save(
        dealt.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
        .mapInArrow(functools.partial(_block_links, percent=percent, exact=exact), "a bigint, b bigint"), "block-links")


def _mixed_buckets(members: DataFrame, sizes: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """What hangs together by signatures in the buckets that hold several components."""
    placed = save(
        members.join(component, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("component")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    return _blocks(placed.join(mixed, "bucket").join(sizes, "node").withColumnRenamed("bucket", "grp"), percent, False)


def _told_apart(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a number per doc_id and text: the doc_id, but where different texts share one, a number of its own for all but one of them."""
    own = F.col("doc_id").cast("bigint")
    shared = save(
        docs.where("doc_id is not null").groupBy(own.alias("__shared")).agg(F.min(text_key()).alias("__first"), F.max(text_key()).alias("last"))
        .where("__first <> last").drop("last"), "shared-ids")
    if shared.isEmpty():
        return docs.withColumn(name, own)
    other = F.lit(1 << 62) + F.xxhash64(own, "text").bitwiseAND(F.lit((1 << 62) - 1))
    return docs.join(shared, own == F.col("__shared"), "left").withColumn(
        name, F.when(F.col("__first") != text_key(), other).otherwise(own)).drop("__shared", "__first")


def one_per_group(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near copies, all its columns as they are.

    The kept one is that of the smallest doc_id; of rows equal in doc_id and text, one stays. Different texts
    that share a doc_id are documents of their own: one of them has the doc_id, the others come after all others. Rows without
    doc_id stay. The decisions of :func:`near_duplicates` hold. Only the ids that go or repeat are joined; while those
    are few enough to broadcast, the texts stay where they are.
    """
    docs = _told_apart(docs, "__id")
    near = save(near_duplicates(docs.select(F.col("__id").alias("doc_id"), "text"), percent, shingle).where("doc_id is not null").groupBy(
        F.col("doc_id").alias("__near")).agg(F.bool_or("kept").alias("kept"), (F.count("*") > 1).alias("repeated")).where("not kept or repeated"), "decisions")
    single = docs.join(near, F.col("__id") == F.col("__near"), "left_anti")
    again = docs.join(near.where("kept and repeated"), F.col("__id") == F.col("__near"), "left_semi").dropDuplicates(["__id"])
    return single.unionByName(again).drop("__id")
