import gzip
import hashlib

from veedor.llm.warc import MIN_BYTES, read_archive, resolve_revisits, write_archive

BIG, NASTY = "é" * MIN_BYTES, "WARC/1.1\r\nWARC-Type: response\r\n\r\nContent-Length: 5\r\n\r\n" * 40
ROWS = [
    (1, "http://a", BIG), (2, "http://a", BIG), (9, None, BIG), (3, "http://b\r\nX: y", NASTY), (4, "http://c", NASTY), (5, "u", None),
    (6, "u", ""), (7, "u", "small"), (8, "u", "small"), (None, "u", BIG), (10, "u", "z" * 2_000_000), (11, "u", BIG + "x"), (11, "u", BIG + "x"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS file", "1 AS place", "2 AS payload")


def test_round_trip(spark):
    path = write_archive(pages(spark, ROWS))
    found = read_archive(spark, path, payloads=True).collect()
    assert {r.record_type for r in found} == {"response"}
    got = sorted((str(r.page_id), r.payload.decode()) for r in found)
    assert got == sorted((str(i), t or "") for i, _, t in ROWS)


def test_revisits(spark):
    path = resolve_revisits(spark, write_archive(pages(spark, ROWS)))
    found = read_archive(spark, path).collect()
    assert len(found) == len(ROWS)
    of = lambda t: [r for r in found if r.payload_digest == hashlib.sha1((t or "").encode()).hexdigest()]
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in of(BIG)) == [
        ("1", "revisit", 9), ("2", "revisit", 9), ("9", "response", None), ("None", "revisit", 9)]
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in of(NASTY)) == [(3, "revisit", 4), (4, "response", None)]
    assert sorted((r.record_type, r.refers_to) for r in of(BIG + "x")) == [("response", None), ("revisit", 11)]
    for text in ("small", "", "z" * 2_000_000):
        assert {r.record_type for r in of(text)} == {"response"}
    assert all(r.payload_bytes == len(BIG.encode()) for r in of(BIG))
    whole = b"".join(gzip.decompress(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert whole.count(BIG.encode()) == 2  # once for itself, once inside the longer payload
    assert b"\r\nX: y" not in whole


def test_empty(spark):
    path = resolve_revisits(spark, write_archive(pages(spark, [])))
    assert read_archive(spark, path).count() == 0
