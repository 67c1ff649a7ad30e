"""Secret scan with corpus-wide ownership frequency.

Every text is scanned once for candidates. Candidate hashes are then counted by
distinct repositories and owners over the whole corpus: a value that many owners
or many repositories carry is a copied example, a value of few looks like a live credential.
Only hashes travel; the counts are aggregated in steps (repository, text or owner,
value), each combined before its shuffle, so a value in a third of all rows
meets no task as rows.

Kinds ``assign``, ``access`` and ``hex`` are always reported. ``opaque`` values,
long mixed-case tokens with digits outside those, are too common in
clean text to report by shape alone; they are added only where they look live.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import join_rows, save, text_key
from factloom.llm.words import decoded, parts

KINDS = ("assign", "access", "hex", "opaque")
#: a value with at least so many owners is a copied example
SHARED_OWNERS = 3
#: so is one in at least so many different repositories, whoever owns them
SHARED_REPOS = 20
MASK = "[secret]"

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 or more
_OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{32,}")
_HINT = re.compile(rb"(?i:pass|secret|token|api)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{32}")
_SCANNED = ("doc_id bigint, text_key bigint, owner string, repo string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
            "found array<struct<kind: int, start: int, end: int, value: binary>>")


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) in code points, leftmost and non-overlapping per kind, by start, then kind."""
    found = [(0, m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(1, m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(2, m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in found)
    at = furthest = 0
    for m in _OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            furthest = max(furthest, base[at][1])
            at += 1
        if furthest <= m.start() and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda c: (c[1], c[0]))


def digest(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end, *_ in spans)


def _scan(batches):
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary())]))
    for batch in parts(batches):
        counts, hashes, found = np.zeros((batch.num_rows, 3), np.int64), [], []
        for i, raw in enumerate(batch.column(4).cast("binary").to_pylist()):
            own = candidates(raw.decode("utf-8", "replace")) if raw and _HINT.search(raw) else []
            base = [c for c in own if c[0] < 3]
            for c in base:
                counts[i, c[0]] += 1
            hashes.append(hashlib.sha256(digest(base).encode()).hexdigest())
            found.append([(k, s, e, hashlib.sha256(v.encode()).digest()[:16]) for k, s, e, v in own])
        yield pa.RecordBatch.from_arrays([
            *batch.columns[:4], *(pa.array(counts[:, k]) for k in range(3)), pa.array(hashes, pa.string()),
            pa.array(found, kind)], ["doc_id", "text_key", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """(value, repos, owners): in how many distinct repositories and of how many distinct owners a value is.

    ``found`` has value, owner, repo and text_key. A null owner or repository counts as one of its own. Repositories whose
    copies of one text carry the value count as one, and so does a repository with several texts or owners.
    """
    first = found.groupBy("value", "repo").agg(F.min("text_key").alias("text_key"))
    repos = first.groupBy("value", "text_key").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("repos"))
    owners = found.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("owners"))
    return repos.join(owners, "value")


def scan(docs: DataFrame, owner: str | Column = "source", repo: str | Column = "doc_id", shared_owners: int = SHARED_OWNERS,
         shared_repos: int = SHARED_REPOS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, owner, repo): doc_id, text_key, n_assign, n_access, n_hex, base_sha256,
    spans, n_live, n_example, repos and owners (of each of the spans, comma-joined), live (array of start, end of the spans that
    look live).

    A null or empty text has no spans: counts 0, the digest of the empty string, spans ''. Rows that repeat a document are
    one repository and get the same result each. Other columns are ignored.
    """
    owner, repo = (F.col(c) if isinstance(c, str) else c for c in (owner, repo))
    row = ["doc_id", "text_key"]
    scanned = save(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                    owner.cast("string").alias("owner"), repo.cast("string").alias("repo"))
        .select("doc_id", text_key().alias("text_key"), "owner", "repo", "text").mapInArrow(_scan, _SCANNED), "scanned")
    found = save(
        scanned.where(F.size("found") > 0).select(*row, "owner", "repo", F.explode("found").alias("f"))
        .select(*row, "owner", "repo", "f.*").distinct(), "found")
    judged = found.drop("owner", "repo").distinct().join(ownership(found), "value").withColumn(
        "live", (F.col("owners") < shared_owners) & (F.col("repos") < shared_repos))
    span = F.struct("start", "kind", "end", "live", "repos", "owners")
    told = judged.where("kind < 3 or live").groupBy(*row).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    names = F.array(*(F.lit(k) for k in KINDS))
    return join_rows(scanned, told, row).select(
        *row, "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join(F.transform("spans", lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","), F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("spans", lambda s: s["live"])), F.lit(0)).cast("bigint").alias("n_live"),
        F.coalesce(F.size(F.filter("spans", lambda s: ~s["live"])), F.lit(0)).cast("bigint").alias("n_example"),
        *(F.coalesce(F.array_join(F.transform("spans", lambda s: s[k].cast("string")), ","), F.lit("")).alias(k) for k in ("repos", "owners")),
        F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("live"))


def _masked(batches, mask):
    for batch in parts(batches):
        texts = []
        for text, spans in zip(decoded(batch.column("text")), batch.column("__live").to_pylist()):
            pieces, at = [], 0
            for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    pieces += [text[at:s["start"]], mask]
                at = max(at, s["end"])
            texts.append("".join([*pieces, text[at:]]))
        place = batch.schema.get_field_index("text")
        yield batch.set_column(place, "text", pa.array(texts, batch.schema.field(place).type)).drop_columns(["__live"])


def masked(docs: DataFrame, owner: str | Column = "source", repo: str | Column = "doc_id", shared_owners: int = SHARED_OWNERS,
           mask: str = MASK, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """The rows of ``docs`` with every span that looks live replaced by ``mask``; overlapping spans become one.

    Copied examples, other texts and other columns stay as they are; n_chars, where it is a column, is counted anew. Malformed bytes of a
    masked text become U+FFFD.
    """
    live = scan(docs, owner, repo, shared_owners, shared_repos).where("n_live > 0").select(
        F.col("doc_id").alias("__doc"), F.col("text_key").alias("__text"), F.col("live").alias("__live")).dropDuplicates(["__doc", "__text"])
    live = save(live, "live")
    match = docs.doc_id.cast("bigint").eqNullSafe(live["__doc"]) & (text_key(docs.text.cast("string")) == live["__text"])
    out = docs.join(live, match, "left").drop("__doc", "__text")
    changed = out.where("__live is not null").mapInArrow(functools.partial(_masked, mask=mask), docs.schema)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.where("__live is null").select(docs.columns).unionByName(changed)
