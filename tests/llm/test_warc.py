import base64
import gzip
import hashlib
import pathlib

from factloom.llm import warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


ROWS = [
    (5, "http://a/x", "<p>same</p>"), (2, "http://b/y z\r\nWARC-Type: evil", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "u", ""), (4, "u", None),
    (6, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nx"), (7, "u", "x" * 300_000), (8, "u", "line\n\nend\r\n"), (8, "u", "line\n\nend\r\n"), (None, "u", "nobody"), (1, "u", "nobody"),
    (None, "u", "alone"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, type string, digest int").repartition(3)


def test_round_trip(spark, tmp_path):
    out = warc.deduplicate(table(spark), str(tmp_path / "a"))
    want = []
    for page, _, html in ROWS:
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        first = min(same) if same else page
        want.append((page, len((html or "").encode()), digest(html), "response" if page == first else "revisit", None if page == first else first))
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
    payloads = {(r.page_id, r.url): r.payload for r in warc.read_archives(spark, str(tmp_path / "a")).where("type = 'response'").collect()}
    assert bytes(payloads[(6, "u")]).decode() == ROWS[5][2] and bytes(payloads[(7, "u")]).decode() == ROWS[6][2]
    assert [u for p, u in payloads if p == 2] == ["http://b/y%20z%20%20WARC-Type:%20evil"]


def test_small_payloads_stay_whole(spark, tmp_path):
    out = {(r.page_id, r.record_type) for r in warc.deduplicate(table(spark), str(tmp_path / "a"), least_bytes=5).collect()}
    assert {(3, "response"), (4, "response"), (5, "revisit"), (2, "response")} <= out


def test_files_are_bounded_by_bytes(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", "x" * n) for i, n in enumerate([10] * 50 + [3_000] * 20 + [90_000] * 5)], "page_id bigint, url string, html string").coalesce(1)
    known = pages.selectExpr("*", "cast(page_id as string) AS payload_digest", "'response' AS record_type", "cast(null as bigint) AS refers_to")
    warc.write_archives(known, str(tmp_path / "a"), file_records=40, file_bytes=40_000, compression="none")
    sizes = [f.stat().st_size for f in pathlib.Path(tmp_path / "a").glob("part-*")]
    assert len(sizes) > 8 and max(s for s in sizes if s < 90_000) < 65_000 and sum(s >= 90_000 for s in sizes) == 5
    assert {(r.page_id, len(r.payload)) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()} == {(r.page_id, len(r.html)) for r in pages.collect()}


def test_a_very_large_page(spark, tmp_path):
    rows = [(1, "u", "x" * 40_000_000), (2, "u", "x" * 40_000_000), (3, "u", "y")]
    got = warc.deduplicate(spark.createDataFrame(rows, "page_id bigint, url string, html string"), str(tmp_path / "a")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [
        (1, 40_000_000, "response", None), (2, 40_000_000, "revisit", 1), (3, 1, "response", None)]


def test_empty_table(spark, tmp_path):
    assert warc.deduplicate(table(spark).limit(0), str(tmp_path / "a")).collect() == []


def test_archives_of_others(spark, tmp_path):
    """Files of several gzip members, with headers in another order and case."""
    def record(number, kind, body, extra=""):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return gzip.compress(f"WARC/1.0\r\nwarc-record-id: <urn:page:{number}>\r\ncontent-length: {len(block)}\r\nWARC-Type: {kind}\r\n{extra}WARC-Payload-Digest: sha1:{digest('hi')}\r\n\r\n".encode()
                             + block + b"\r\n\r\n")

    pathlib.Path(tmp_path / "x.warc.gz").write_bytes(record(1, "response", b"hi") + record(2, "revisit", b"", "WARC-Refers-To: <urn:page:1>\r\n"))
    got = warc.restored(warc.read_archives(spark, str(tmp_path))).collect()
    assert sorted(map(tuple, got)) == [(1, 2, digest("hi"), "response", None), (2, 2, digest("hi"), "revisit", 1)]
