"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import decontaminate, language_id, mixing, secret_scan
from factloom.llm.queries import ORACLES, QUERIES

from . import test_decontaminate, test_minhash, test_mixing

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "conversations")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append((name, before, docs))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order_and_columns(stages):
    assert [n for n, *_ in stages] == ["language_id", "near_duplicates", "decontamination", "secret_scans", "mixing"]
    for _, before, after in stages[:-1]:
        assert after.schema.names == before.schema.names
    assert stages[-1][2].columns == [*stages[-1][1].columns, "copies"]


def test_language(stages):
    _, before, after = stages[0]
    good = {r.doc_id for r in language_id.identify(before).collect() if not r.rejected}
    assert rows(after) == [r for r in rows(before) if r[0] in good]
    assert len(good) >= 0.99 * before.count()


def test_near_duplicates(stages):
    _, before, after = stages[1]
    want = test_minhash.brute_force([(r.doc_id, r.text) for r in before.collect()])
    assert rows(after) == [r for r in rows(before) if want[r[0]][1] == r[0]]
    assert after.count() < before.count()


def test_decontamination(spark, stages):
    _, before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in test_decontaminate.brute_force([(r.doc_id, r.text) for r in before.collect()], items) if r[-1]}
    assert bad and rows(after) == [r for r in rows(before) if r[0] not in bad]


def test_secrets(stages):
    _, before, after = stages[3]
    owners = {}
    found = [(r, secret_scan.candidates(r.text)) for r in before.collect()]
    for r, spans in found:
        for *_, value in spans:
            owners.setdefault(value, set()).add(r.source)
    want = {}
    for r, spans in found:
        text, at, parts = r.text, 0, []
        for _, start, end, value in sorted(spans, key=lambda s: (s[1], -s[2])):
            if len(owners[value]) < secret_scan.SHARED_OWNERS:
                if start >= at:
                    parts += [text[at:start], secret_scan.MASK]
                at = max(at, end)
        want[r.doc_id] = "".join([*parts, text[at:]])
    got = {r.doc_id: r.text for r in after.collect()}
    assert got == want


def test_mixture(stages):
    _, before, after = stages[4]
    want = test_mixing.brute_force([(r.doc_id, r.text, r.source) for r in before.collect()])
    assert {(r.doc_id, r.copies) for r in after.collect()} == {(i, v[3]) for (i, *_), v in want.items() if v[3]}
    assert mixing.PASSES and decontaminate.WINDOW == 10


def test_odd_input(spark, docs):
    """Nulls, empty and very long texts, repeated rows, clashing columns and an empty table go through every stage."""
    odd = docs([(1, None, None, None), (2, ""), (3, "the thing " * 30_000), (3, "the thing " * 30_000), (None, "the thing of them", "en", None), (4, "the thing that is here", "en"), (5, "password=r34lsecret the thing", "en")])
    for table in (odd, odd.limit(0)):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        assert out.columns == [*table.columns, "copies"]
        got = out.collect()
        assert len(got) <= table.count() and {r.doc_id for r in got} <= {3, None, 4, 5}


def test_malformed_text_goes_through_every_stage(spark, docs):
    rows = docs([(i, f"the thing that is here {i} and there", "en") for i in range(30)] + [(40, "password=r34lsecret the thing", "en")])
    bad = F.concat(F.lit(b"caf\xe9 \xff ").cast("string"), "text")
    out = rows.withColumn("text", F.when(F.col("doc_id") % 4 == 0, bad).otherwise(F.col("text")))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.select("doc_id", F.length("text").alias("n")).collect()
    assert secret_scan.masked(rows.withColumn("text", bad).where("doc_id = 40")).select("text").first()[0] == "caf\ufffd \ufffd [secret] the thing"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    df = QUERIES[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(order).collect())
    assert got
    if name in ORACLES:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cursor = con.execute(ORACLES[name])
        names = [d[0] for d in cursor.description]
        place = [names.index(c) for c in order]
        assert sorted(names) == order and got == sorted(repr(tuple(r[i] for i in place)) for r in cursor.fetchall())


def test_sql_belongs_to_queries():
    assert set(ORACLES) <= set(QUERIES)
