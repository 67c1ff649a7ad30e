"""Language identification by interpolated Kneser-Ney character models.

Each language has one model over its letters, lower-cased, with one space between
runs. The n-grams of all languages are stored once, in sorted arrays of packed
hashes, with the log probability of the last character after the others under
every language; what an array of the highest order lacks falls back to the next
shorter one. The language of the lowest cross-entropy per character wins. A text is
rejected if even that is far beyond what nearly all calibration texts of the language have,
measured in standard deviations of a text of its length.

The models are counted on a bounded sample of labelled documents (``SAMPLE`` per
language, whole texts, those of the smallest hashes), so their size does not grow with
the corpus; every document is scored, over its whole text.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.llm.tables import save, text_key
from factloom.llm.words import decoded, parts

ORDER = 4
#: labelled documents of a language that are used, at most
SAMPLE = 4000
#: one sampled document in so many calibrates the rejection instead of being counted
CALIBRATION = 5
#: standard deviations beyond the mean from which on a text may be rejected
REJECT = 6.0
#: the quantile of the calibration texts' deviations that may move the limit, and the factor from it to the limit
QUANTILE, BEYOND = 0.99, 3.0
#: a language of fewer calibration texts is judged by the spread of all languages' texts, which are at least so many or judge nothing
LEAST, LEAST_OF_ALL = 100, 20
#: characters scored at a time, for four languages
CHUNK = 1 << 19
UNKNOWN = "und"
_SPACE = 0x20
_PAD = " " * (ORDER - 1)
_MASK = [np.uint64((1 << (16 * k)) - 1) for k in range(ORDER + 1)]


@functools.cache
def _unit() -> np.ndarray:
    """Per code point 16 bits: a letter itself (those beyond 16 bits share the private area), else a space."""
    letter = np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)
    codes = np.arange(0x110000)
    codes[0x10000:] = 0xE000 + codes[0x10000:] % 0x1900
    return np.where(letter, codes, _SPACE).astype(np.uint16)


class Characters:
    """The n-grams of some texts: ``grams`` of ``ORDER`` characters, ``bounds`` per text, ``letters`` per text."""

    def __init__(self, texts: list[str]):
        lowered = [f"{_PAD}{t.lower()} " for t in texts]
        length = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts))
        start = np.concatenate([[0], np.cumsum(length)])
        codes = _unit()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        keep = np.ones(codes.size, dtype=bool)
        keep[1:] = (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)
        for j in range(len(_PAD)):
            keep[start[:-1] + j] = True
        kept = np.concatenate([[0], np.cumsum(keep)])[start]
        codes = codes[keep].astype(np.uint64)
        self.letters = np.add.reduceat(codes != _SPACE, kept[:-1]) if len(texts) else np.zeros(0, np.int64)
        n = codes.size - ORDER + 1
        grams = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(ORDER):
            grams = (grams << np.uint64(16)) | codes[j:j + n]
        within = np.ones(codes.size, dtype=bool)  # the gram that ends here lies in one text
        for j in range(len(_PAD)):
            within[kept[:-1] + j] = False
        self.grams = grams[within[ORDER - 1:]]
        self.bounds = np.concatenate([[0], np.cumsum(np.diff(kept) - len(_PAD))])


def _slices(texts, size):
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > size:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def _counted(batches):
    """(lang, gram, n) of a batch of (lang, text)."""
    for batch in parts(batches):
        langs, texts = np.array(decoded(batch.column(0)), dtype=object), decoded(batch.column(1))
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for lo, hi in _slices(own, CHUNK):
                grams, n = np.unique(Characters(own[lo:hi]).grams, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * grams.size, pa.string()), pa.array(grams.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the keys in a sorted array, and whether they are there."""
    if not table.size:
        return np.zeros(keys.size, dtype=np.int64), np.zeros(keys.size, dtype=bool)
    at = np.minimum(np.searchsorted(table, keys), table.size - 1)
    return at, table[at] == keys


class _Level:
    """Counts of the n-grams of one order and language, discounted, with the weight left per history."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        once, twice = int((counts == 1).sum()), int((counts == 2).sum())
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.grams, self.counts = grams, counts.astype(np.float64)
        self.histories, first = np.unique(grams >> np.uint64(16), return_index=True)
        self.totals = np.add.reduceat(self.counts, first)
        self.left = self.discount * np.diff([*first, grams.size]) / self.totals

    def weight(self, histories: np.ndarray) -> np.ndarray:
        at, there = _find(self.histories, histories)
        return np.where(there, self.left[at], 1.0)

    def own(self, grams: np.ndarray) -> np.ndarray:
        at, there = _find(self.grams, grams)
        top, known = _find(self.histories, grams >> np.uint64(16))
        return np.where(there & known, np.maximum(self.counts[at] - self.discount, 0) / self.totals[top], 0.0)


def _levels(grams: np.ndarray, counts: np.ndarray) -> list[_Level]:
    """Of orders 1 to ORDER. Below the highest, an n-gram counts the distinct characters seen before it."""
    levels = [_Level(grams, counts)]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, _Level(*np.unique(levels[0].grams & _MASK[order], return_counts=True)))
    return levels


def _probability(levels: list[_Level], order: int, grams: np.ndarray, alphabet: int) -> np.ndarray:
    if order == 0:
        return np.full(grams.size, 1 / alphabet)
    level = levels[order - 1]
    lower = _probability(levels, order - 1, grams & _MASK[order - 1], alphabet)
    return level.own(grams) + level.weight(grams >> np.uint64(16)) * lower


class Model:
    """Sorted arrays of n-grams with a column of log probabilities per language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: per language the sorted grams of order ORDER and how often each occurs."""
        self.langs = sorted(counts)
        levels = [_levels(*counts[lang]) for lang in self.langs]
        alphabet = np.unique(np.concatenate([x[0].grams for x in levels])).size + 1 if levels else 1
        self.grams, self.logs, self.histories, self.weights = [], [], [], []
        for order in range(1, ORDER + 1) if levels else []:
            grams = np.unique(np.concatenate([x[order - 1].grams for x in levels]))
            histories = np.unique(np.concatenate([x[order - 1].histories for x in levels]))
            self.grams.append(grams)
            self.logs.append(np.log(np.stack([_probability(x, order, grams, alphabet) for x in levels], axis=1)).astype(np.float32))
            self.histories.append(histories)
            self.weights.append(np.log(np.stack([x[order - 1].weight(histories) for x in levels], axis=1)).astype(np.float32))
        self.floor = np.float32(-np.log(alphabet))

    def log_probabilities(self, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of each gram's last character after the others, a column per language."""
        if order == 0:
            return np.full((grams.size, len(self.langs)), self.floor, dtype=np.float32)
        at, there = _find(self.grams[order - 1], grams)
        out = self.logs[order - 1][at]
        missing = np.flatnonzero(~there)
        if missing.size:
            own = grams[missing]
            place, known = _find(self.histories[order - 1], own >> np.uint64(16))
            out[missing] = self.log_probabilities(own & _MASK[order - 1], order - 1) + self.weights[order - 1][place] * known[:, None]
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text under each language, and its number of letters."""
        entropy, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        for lo, hi in _slices(texts, max(1024, CHUNK * 4 // max(4, len(self.langs)))):
            c = Characters(texts[lo:hi])
            letters[lo:hi] = c.letters
            n = np.diff(c.bounds)
            some = np.flatnonzero(n)
            if some.size and self.langs:
                logs = np.add.reduceat(self.log_probabilities(c.grams), c.bounds[:-1][some], axis=0, dtype=np.float64)
                entropy[lo + some] = -logs / n[some][:, None]
        return entropy, letters


def _judged(texts, model, limits):
    """Per text: language, score, cross-entropy, letters, rejected."""
    limits = limits or {}
    entropy, letters = model.entropies(texts)
    rows = np.arange(len(texts))
    if model.langs:
        best = entropy.argmin(axis=1)
        least = entropy[rows, best]
        odds = np.exp(-np.minimum((entropy - least[:, None]) * letters[:, None], 700)).sum(axis=1)
    else:
        best, least, odds = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), np.ones(len(texts))
    known = (letters > 0) & bool(model.langs)
    langs = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
    z = np.array([deviation(h, n, limits.get(lang)) for h, n, lang in zip(least, letters, langs)])
    highest = np.array([limits[lang][3] if lang in limits else REJECT for lang in langs])
    return langs, np.where(known, 1 / odds, 0.0), np.where(known, least, np.nan), letters, ~known | (z > highest)


def _scored(batches, model, limits):
    for batch in parts(batches):
        langs, score, entropy, letters, rejected = _judged(decoded(batch.column(2)), model.value, limits)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(score), pa.array(entropy), pa.array(letters), pa.array(rejected)],
            ["doc_id", "text_key", "lang_pred", "score", "entropy", "letters", "rejected"])


def _kept(batches, model, limits):
    for batch in parts(batches):
        rejected = _judged(decoded(batch.column("text")), model.value, limits)[-1]
        yield batch.filter(pa.array(~rejected))


_RESULT = "doc_id bigint, text_key bigint, lang_pred string, score double, entropy double, letters bigint, rejected boolean"


def deviation(entropy: float, letters: int, limit: tuple[float, float, float, float] | None) -> float:
    """How many standard deviations of a text of this length the cross-entropy lies above the language's mean."""
    if limit is None:
        return 0.0
    mean, between, within, _ = limit
    return (entropy - mean) / (between + within / max(letters, 1)) ** 0.5


def _middle(h: np.ndarray, n: np.ndarray) -> float:
    """The median by letters."""
    order = np.argsort(h)
    return float(h[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])


def _spread(beyond: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Of entropies less their language's middle: the variance between texts, that within per letter, the limit."""
    within = float(np.median(beyond ** 2 * n)) / 0.455 + 1e-6
    between = max(1e-4, float(np.median(beyond[n >= np.median(n)] ** 2)) / 0.455)
    return between, within, max(REJECT, BEYOND * float(np.quantile(beyond / np.sqrt(between + within / n), QUANTILE)))


def calibrated(rows: list[tuple[str, float, int]], langs: list[str] = ()) -> dict[str, tuple[float, float, float, float]]:
    """Per language the middle, the variance between texts, the variance within per letter, and the deviation to reject beyond.

    The limit is ``BEYOND`` times a high quantile of the deviations of the language's own calibration texts, or ``REJECT``: a
    few odd texts do not move it, and it does not grow with the sample. A language of ``langs`` or ``rows`` with fewer than
    ``LEAST`` such texts has the spread and limit of all languages' texts around its own middle, or around that of all if it has no text.
    """
    rows = [r for r in rows if r[2] > 0]
    if len(rows) < LEAST_OF_ALL:
        return {}
    lang = np.array([r[0] for r in rows], dtype=object)
    h, n = (np.array([r[i] for r in rows], dtype=float) for i in (1, 2))
    middles = {a: _middle(h[lang == a], n[lang == a]) for a in sorted(set(lang))}
    beyond = h - np.array([middles[a] for a in lang])
    pooled = _spread(beyond, n)
    return {
        a: (middles.get(a, _middle(h, n)), *(_spread(beyond[lang == a], n[lang == a]) if (lang == a).sum() >= LEAST else pooled))
        for a in sorted({*middles, *langs})}


def held_out() -> Column:
    """Documents that nothing is learned from: crc32 of doc_id as text, modulo 4, is 2; no doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Model, dict]:
    """The model and the limits of rejection, from labelled documents (doc_id, text, lang) that are not held out."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    labelled = docs.where("lang is not null and text is not null").where(~held_out()).select("lang", "text", order.alias("h"))
    ranked = labelled.select("lang", "h").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    last = save(ranked.where(F.col("rank") <= sample).groupBy("lang").agg(F.max("h").alias("last")), "language-limits")
    chosen = save(labelled.join(last, "lang").where("h <= last").select(
        "lang", "text", (F.pmod(F.xxhash64("h"), F.lit(CALIBRATION)) == 0).alias("calibrates")), "language-sample")
    rows = chosen.where("not calibrates").select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    langs = np.array(rows.column("lang").to_pylist(), dtype=object)
    gram, n = rows.column("gram").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    counts = {}
    for lang in sorted(set(langs)):
        own = np.flatnonzero(langs == lang)
        own = own[np.argsort(gram[own])]
        counts[lang] = (gram[own], n[own])
    model = Model(counts)
    scored = _score(chosen.where("calibrates").select(F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("text_key"), "text", "lang"), model, None, "lang")
    limits = calibrated([tuple(r) for r in scored.where("lang = lang_pred").select("lang", "entropy", "letters").collect()], model.langs)
    return model, limits


def _with_lang(batches, model, limits):
    for batch in parts(batches):
        for out in _scored([batch], model, limits):
            yield out.append_column("lang", batch.column(3))


def _score(docs: DataFrame, model: Model, limits: dict | None, *extra: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if extra:
        return docs.mapInArrow(functools.partial(_with_lang, model=shared, limits=limits), _RESULT + ", lang string")
    return docs.mapInArrow(functools.partial(_scored, model=shared, limits=limits), _RESULT)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, text_key, held_out, lang_pred, score, entropy, letters, rejected.

    The language is one learned from documents that are not held out and have a lang; ``und`` with score 0, rejected, if the
    text is null, empty or without letters, or nothing was learned. ``score`` is the posterior probability of the
    language at equal priors. lang, source and doc_id play no part in a prediction; other columns are ignored; repeated
    rows get the same result; ties go to the first language by name. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model, limits = train(docs, sample)
    return _score(docs.select("doc_id", text_key().alias("text_key"), "text"), model, limits).select(
        "doc_id", "text_key", held_out().alias("held_out"), "lang_pred", "score", "entropy", "letters", "rejected")


def recognised(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, ...) that :func:`identify` does not reject, all their columns as they are.

    A row is kept or dropped where it is read; nothing but the training sample is shuffled.
    """
    model, limits = train(docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(functools.partial(_kept, model=shared, limits=limits), docs.schema)
