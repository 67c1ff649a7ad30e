"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ten consecutive words (fewer, if the item is
shorter). A window can only occur where all its words do, so one necessary word
is enough to look it up: the one that is rarest in the corpus. Documents offer
the positions of such words; the place of the word in the window, the length of
the window and the ends of the document bound where a window could lie; and a
join on the rarest word, its place and the words themselves verifies it exactly.

Before anything is shuffled, documents drop positions that cannot join: two
bitmaps of fixed size (rarest words, windows) are all that goes to the tasks,
whatever the size of the benchmark. A full bitmap costs time, never results.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm import words
from factloom.llm.tables import join_rows, save, text_key

WINDOW = 10
#: bits of a bitmap (512 KB)
BITS = 1 << 22
_WINDOWS = "item_id string, fingerprint bigint, tokens binary, words array<bigint>"
_SCANNED = ("doc_id bigint, text_key bigint, n_words bigint, "
            "found array<struct<start: int, word: bigint, place: int, tokens: binary>>")


def _split(texts):
    return words.Words(texts, words.ALPHANUMERIC, lower=True)


def _item_windows(batches, size):
    for batch in words.parts(batches):
        ids, texts = batch.column(0), words.encoded(batch.column(1))
        for lo, hi in words.slices(texts):
            w = _split(texts[lo:hi])
            rows = ([], [], [], [])
            for i, n in enumerate(w.counts()):
                own = w.hash[w.bounds[i]:w.bounds[i + 1]]
                length = min(size, n)
                for at in range(n - length + 1 if n else 0):
                    part = own[at:at + length]
                    for column, value in zip(rows, (
                            ids[lo + i].as_py(), words.sequence_hash([part[j:j + 1] for j in range(length)]).view(np.int64)[0],
                            part.tobytes(), part.view(np.int64))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.binary()),
                pa.array(rows[3], pa.list_(pa.int64()))], ["item_id", "fingerprint", "tokens", "words"])


def _bitmap(df: DataFrame, column: str):
    """The values' bits, as at most BITS / 64 words brought to the driver and sent to the tasks."""
    bit = F.pmod(F.col(column), F.lit(BITS))
    packed = df.select(F.floor(bit / 64).cast("int").alias("at"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (bit % 64).cast("int")).alias("bit"))
    table = np.zeros(BITS // 64, dtype=np.uint64)
    for at, bits in packed.groupBy("at").agg(F.bit_or("bit")).collect():
        table[at] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return df.sparkSession.sparkContext.broadcast(table)


def _in(bitmap, hashes):
    bit = hashes & np.uint64(64 * bitmap.size - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _count_words(batches, vocabulary):
    for batch in words.parts(batches):
        texts = words.encoded(batch.column(0))
        for lo, hi in words.slices(texts):
            hashes = _split(texts[lo:hi]).hash
            found, n = np.unique(hashes[_in(vocabulary.value, hashes)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def _scan(batches, rarest, windows, lengths):
    struct = pa.struct([("start", pa.int32()), ("word", pa.int64()), ("place", pa.int32()), ("tokens", pa.binary())])
    for batch in words.parts(batches):
        texts = words.encoded(batch.column(2))
        for lo, hi in words.slices(texts):
            w = _split(texts[lo:hi])
            at = np.flatnonzero(_in(rarest.value, w.hash))
            first, last = w.bounds[w.row[at]], w.bounds[w.row[at] + 1]
            rows, starts, values, places, tokens = [], [], [], [], []
            for length in lengths:
                for place in range(length):
                    fits = (at - place >= first) & (at - place + length <= last)
                    here = at[fits]
                    if not here.size:
                        continue
                    start = here - place
                    likely = _in(windows.value, words.sequence_hash([w.hash[start + j] for j in range(length)]))
                    here, start = here[likely], start[likely]
                    rows.append(w.row[here])
                    starts.append(start - w.bounds[w.row[here]])
                    values.append(w.hash[here].view(np.int64))
                    places.append(np.full(here.size, place))
                    tokens.extend(w.hash[s:s + length].tobytes() for s in start)
            rows = np.concatenate([np.zeros(0, np.int64), *rows])
            order = np.argsort(rows, kind="stable")
            pick = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])[order]
            found = pa.StructArray.from_arrays(
                [pa.array(pick(starts), pa.int32()), pa.array(pick(values), pa.int64()), pa.array(pick(places), pa.int32()),
                 pa.array(tokens, pa.binary()).take(pa.array(order))], fields=list(struct))
            offsets = np.searchsorted(rows[order], np.arange(hi - lo + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(w.counts().astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), found)], ["doc_id", "text_key", "n_words", "found"])


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. A word inside any occurrence of
    a window of ``benchmark`` (item_id, text) is hit; items are those with occurring windows, by item_id as text.
    A null or empty text has no words and no hits; an item without words has no window; items that
    share an item_id count as one, an item without item_id is named by the empty string. Repeated rows get the same
    result each, rows are judged by their own text, and other columns are ignored. Without items nothing is hit.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = save(
        benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
        .mapInArrow(functools.partial(_item_windows, size=size), _WINDOWS).dropDuplicates(["item_id", "tokens"]), "item-windows")
    windows = save(_prefixes(docs, items), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most ``size`` values
    scanned = save(
        docs.select("doc_id", text_key().alias("text_key"), "text").mapInArrow(
            functools.partial(_scan, rarest=_bitmap(windows, "word"), windows=_bitmap(windows, "fingerprint"), lengths=lengths), _SCANNED),
        "scanned")
    hits = save(
        scanned.select("doc_id", "text_key", F.explode("found").alias("f")).select("doc_id", "text_key", "f.*")
        .join(windows.select("word", "place", "tokens", "length"), ["word", "place", "tokens"])
        .select("doc_id", "text_key", "start", (F.col("start") + F.col("length")).alias("end"), "tokens"), "hits")
    row = ["doc_id", "text_key"]
    earlier = Window.partitionBy(*row).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    n_hit = hits.select(*row, covered.alias("n")).groupBy(*row).agg(F.sum("n").alias("n_hit"))
    named = (
        hits.select(*row, "tokens").distinct().join(items.select("tokens", "item_id"), "tokens").select(*row, "item_id").distinct()
        .groupBy(*row).agg(F.sort_array(F.collect_list("item_id")).alias("items")))
    told = join_rows(n_hit, named, row, "inner")
    return join_rows(scanned, told, row).select(
        *row, "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _prefixes(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each distinct window with the word that is rarest in the corpus and its place.

    A window with a word that no document has cannot occur and is left out.
    """
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    counts = (
        docs.select("text").mapInArrow(functools.partial(_count_words, vocabulary=_bitmap(vocabulary, "word")), "word bigint, n bigint")
        .groupBy("word").agg(F.sum("n").alias("n")))
    return (
        items.dropDuplicates(["tokens"]).select("tokens", "fingerprint", F.posexplode("words").alias("place", "word"))
        .join(counts, "word", "left").groupBy("tokens", "fingerprint")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "word")).alias("least"), F.count("*").cast("int").alias("length"))
        .where("least.n > 0").select("tokens", "fingerprint", "length", "least.place", "least.word"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, all their columns as they are."""
    bad = save(contamination(docs, benchmark, size).where("contaminated").select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text")).distinct(), "contaminated")
    return docs.join(bad, docs.doc_id.cast("bigint").eqNullSafe(bad["__doc"]) & (text_key(docs.text.cast("string")) == bad["__text"]), "left_anti")
