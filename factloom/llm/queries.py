"""Queries that apply each operator to its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import chat, decontaminate, language_id, licences, manifest, minhash, mixing, prefix_trie, quality, secret_scan, toxicity, url_filter, warc
from factloom.llm.tables import crc_of, read


def op1_warc_revisits(spark, sf_dir):
    return warc.deduplicate(read(spark, sf_dir, "pages"), warc.archive_folder(spark))


def op2_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 4)) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.root < l.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

def op3_secret_scans(spark, sf_dir):
    return secret_scan.scan(read(spark, sf_dir, "documents")).drop("text_key", "live")


def op4_licence_scans(spark, sf_dir):
    return licences.scan(read(spark, sf_dir, "documents")).drop("text_key")


def op5_url_filters(spark, sf_dir):
    return url_filter.filter_urls(read(spark, sf_dir, "pages"))


def op6_chat_formatting(spark, sf_dir):
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    probe = spark.range(1).select(F.inline(F.array(*(
        F.struct(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), said.alias("text"))
        for i, role in enumerate(("user", "assistant"))))))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_table(rows.unionByName(probe)))


OP6_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
escaped AS (
  SELECT *, length(replace(replace(replace(role, '~', '~0'), '<|', '~1'), chr(10), '~2'))
    + length(replace(replace(text, '~', '~0'), '<|', '~1')) + 12 + 1 + 11 AS n FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""


def op7_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_key")


def op8_mixing_sources(spark, sf_dir):
    return mixing.mix(read(spark, sf_dir, "documents")).drop("text_key", "copies")


def op9_language_id(spark, sf_dir):
    return language_id.identify(read(spark, sf_dir, "documents")).drop("text_key")


def op10_quality_rules(spark, sf_dir):
    return quality.quality(read(spark, sf_dir, "documents")).drop("text_key")


OP7_SQL = r"""
WITH words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 9), ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
  FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
hits AS MATERIALIZED (
  SELECT doc_id, i, p.n, item_id FROM places p JOIN windows v ON v.n = p.n AND v.s = array_to_string(list_slice(w, i, i + p.n - 1), ' ')),
hit_words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

OP8_SQL = r"""
WITH rows AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS place FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM rows GROUP BY source),
limited AS (SELECT *, 2.0::DOUBLE * source_size AS lim, ([3.0, 1.0, 2.0]::DOUBLE[])[((rank - 1) % 3 + 1)::INT] AS weight FROM ranked),
rated AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY lim / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM limited),
sources AS MATERIALIZED (
  SELECT source, source_size, least(lim, weight * (SELECT arg_min(rate, (lim / weight, rank)) FROM rated WHERE rate * weight <= lim)) AS target
  FROM rated),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM sources),
pass0 AS (
  SELECT r.*, source_size, target, times, floor(target - times * source_size) AS budget, false AS chosen
  FROM rows r JOIN budgets b ON b.source IS NOT DISTINCT FROM r.source),
step1 AS (
  SELECT *, NOT chosen AS open, sum(size) FILTER (NOT chosen) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS through
  FROM pass0),
pass1 AS MATERIALIZED (
  SELECT * EXCLUDE (open, through, budget, chosen), chosen OR (open AND through <= budget) AS chosen,
    budget - coalesce(max(through) FILTER (open AND through <= budget) OVER (PARTITION BY source), 0) AS budget FROM step1),
{steps},
nearest AS (
  SELECT source, arg_min(place, (abs(size - budget), place)) AS nearest FROM pass4 WHERE NOT chosen AND size > 0 AND size < 2 * budget GROUP BY source)
SELECT doc_id, size, source_size, target,
  (size * (times + ((chosen OR coalesce(place = nearest, false)) AND times < 2)::INT))::BIGINT AS taken
FROM pass4 p LEFT JOIN nearest n ON n.source IS NOT DISTINCT FROM p.source
"""
_OP8_STEP = """
step{n} AS (
  SELECT *, NOT chosen AND size > 0 AND size <= budget AS open,
    sum(size) FILTER (NOT chosen AND size > 0 AND size <= budget) OVER (PARTITION BY source ORDER BY place RANGE UNBOUNDED PRECEDING) AS through
  FROM pass{before}),
pass{n} AS MATERIALIZED (
  SELECT * EXCLUDE (open, through, budget, chosen), chosen OR (open AND through <= budget) AS chosen,
    budget - coalesce(max(through) FILTER (open AND through <= budget) OVER (PARTITION BY source), 0) AS budget FROM step{n})"""
OP8_SQL = OP8_SQL.replace("{steps}", ",".join(_OP8_STEP.format(n=n, before=n - 1) for n in (2, 3, 4)))

OP1_SQL = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p, sha1(coalesce(html, '')) AS h FROM pages),
digests AS (
  SELECT page_id, octet_length(p)::BIGINT AS payload_bytes,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, 1 + 10 * (k // 8)::INT, 10))::BIGINT >> (5 * (7 - k % 8))::INT) & 31)::INT + 1, 1)
      FOR k IN range(0, 32)], '') AS payload_digest
  FROM payloads),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM digests GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM digests JOIN firsts USING (payload_digest)
"""



def op11_merkle_manifest(spark, sf_dir):
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.verify(read(spark, sf_dir, "documents"), F.when(crc_of("doc_id") % 5 == 0, lowered)).drop("copied")


def op12_toxicity(spark, sf_dir):
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_key")


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


#: crc32 of a number's decimal text, by a table made from the polynomial
CRC_TABLE = """crc_table AS MATERIALIZED (
  SELECT list(list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY c) AS t
  FROM (SELECT unnest(range(256)) AS c))"""


def crc_sql(number: str) -> str:
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({number}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), "
            "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)")




def _leaf_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in fields) + ")"


_LEAF = _leaf_sql("doc_id", "source", "lang", "n_chars", "text")
_LEAF_LOWERED = _leaf_sql(
    "doc_id", "source", "lang", "n_chars", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
#: one level: nodes with what stands before and after them in their run; a tree of one node stays as it is
_OP11_LEVEL = """
{t}{k}_run AS MATERIALIZED (
  SELECT tree, pos, h, count(*) OVER (PARTITION BY tree) > 1 AS many,
    list(h) OVER (PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS run FROM {t}{k}),
{t}{k}_path AS MATERIALIZED (
  SELECT tree, pos, many, CASE WHEN many THEN array_to_string(run[1:(pos % 16)::INT], '') ELSE '' END AS before,
    CASE WHEN many THEN array_to_string(run[(pos % 16)::INT + 2:], '') ELSE '' END AS after FROM {t}{k}_run),
{t}{next} AS MATERIALIZED (
  SELECT DISTINCT tree, pos // 16 AS pos, CASE WHEN many THEN sha256(array_to_string(run, '')) ELSE h END AS h FROM {t}{k}_run)"""
_OP11_STEP = """
{t}_fold{next} AS MATERIALIZED (
  SELECT f.* EXCLUDE (x, proof), CASE WHEN many THEN sha256(before || x || after) ELSE x END AS x, proof || before || after AS proof
  FROM {t}_fold{k} f JOIN {t}{k}_path p ON p.tree = f.{key} AND p.pos = f.{pos} // {width})"""
_DEPTH = 6


def _op11_sql() -> str:
    def levels(t):
        return ",".join(_OP11_LEVEL.format(t=t, k=k, next=k + 1) for k in range(_DEPTH))

    def steps(t, key, pos):
        return ",".join(_OP11_STEP.format(t=t, k=k, next=k + 1, key=key, pos=pos, width=16 ** k) for k in range(_DEPTH))

    return f"""
WITH {CRC_TABLE},
leaves AS MATERIALIZED (
  SELECT doc_id, coalesce('1' || source, '0') AS tree, {_LEAF} AS leaf,
    CASE WHEN {crc_sql("doc_id")} % 5 = 0 AND text IS NOT NULL THEN {_LEAF_LOWERED}
    END AS changed FROM documents, crc_table),
numbered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
a0 AS (SELECT tree, place AS pos, leaf AS h FROM numbered),{levels("a")},
b0 AS (SELECT 'all' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, tree AS own FROM a{_DEPTH}),{levels("b")},
a_fold0 AS (SELECT doc_id, tree, place, leaf, coalesce(changed, leaf) AS x, '' AS proof FROM numbered),{steps("a", "tree", "place")},
b_fold0 AS (
  SELECT doc_id, leaf, f.tree, b0.h AS subroot, b0.tree AS top, b0.pos AS at, x, proof FROM a_fold{_DEPTH} f JOIN b0 ON b0.own = f.tree),{steps("b", "top", "at")}
SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = r.h AS verified
FROM b_fold{_DEPTH}, b{_DEPTH} r
"""


OP11_SQL = _op11_sql()

OP13_SQL = f"""
WITH {CRC_TABLE},
said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, length(text) AS chars, sha256(octet_length(encode(role))::VARCHAR || ':' || role || text) AS id, turn FROM said),
ordered AS MATERIALIZED (
  SELECT conv_id, id, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM turns),
convs AS MATERIALIZED (
  SELECT conv_id, {crc_sql("conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base
  FROM (SELECT DISTINCT conv_id FROM ordered), crc_table),
taken AS (SELECT c.conv_id, pos AS d, id, chars FROM convs c JOIN ordered o ON o.conv_id = c.base AND pos <= h),
counted AS (SELECT conv_id, count(*) AS n FROM taken GROUP BY conv_id),
own AS (
  SELECT c.conv_id, pos - h + coalesce(n, 0) AS d, id, chars
  FROM convs c JOIN ordered o ON o.conv_id = c.conv_id AND pos > h LEFT JOIN counted n ON n.conv_id = c.conv_id),
rebuilt AS (SELECT * FROM taken UNION ALL SELECT * FROM own),
begun AS MATERIALIZED (
  SELECT conv_id, d, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS p, chars FROM rebuilt
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS MATERIALIZED (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM begun GROUP BY d, p),
children AS (SELECT d - 1 AS d, p[:length(p) - 64] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
weighed AS (
  SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children ON children.d = nodes.d AND children.p = nodes.p),
above AS (
  SELECT k AS d, p[:64 * k] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM weighed) GROUP BY 1, 2),
ended AS (
  SELECT d, p, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
  FROM (SELECT *, d = max(d) OVER (PARTITION BY conv_id) AS last FROM begun) WHERE last GROUP BY d, p)
SELECT w.conv_id, w.d::BIGINT AS depth, parent.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM weighed w JOIN above a ON a.d = w.d AND a.p = w.p
LEFT JOIN ended e ON e.d = w.d AND e.p = w.p LEFT JOIN nodes parent ON parent.d = w.d - 1 AND parent.p = w.p[:length(w.p) - 64]
"""

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_warc_revisits": op1_warc_revisits,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_secret_scans": op3_secret_scans,
    "op4_licence_scans": op4_licence_scans,
    "op5_url_filters": op5_url_filters,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES = {
    "op1_warc_revisits": OP1_SQL,
    "op2_minhash_near_dedup": OP2_SQL,
    "op6_chat_formatting": OP6_SQL,
    "op7_benchmark_decontamination": OP7_SQL,
    "op8_mixing_sources": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
