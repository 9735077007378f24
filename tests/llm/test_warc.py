import hashlib

from repolens.llm.common import new_path
from repolens.llm.warc import archive_pages, read_archive, record_bytes, write_archive

BIG = "<p>ä</p>" * 200


def test_round_trip_and_revisits(spark):
    rows = [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (7, None, BIG), (3, "http://b/\r\nX: y", "small"), (4, "http://b/4", "small"),
        (5, "u", None), (6, "u", ""), (None, "u", BIG), (8, "u", BIG + "!" * 100_000), (8, "u", BIG + "!" * 100_000),
    ]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    path = new_path(spark, "warc-test")
    write_archive(pages, path)
    got = read_archive(spark, path).collect()
    want = []
    for page_id, _, text in rows:
        data = (text or "").encode()
        first = max((p for p, _, t in rows if p is not None and (t or "").encode() == data), default=None)
        revisit = len(data) >= 1000 and page_id != first
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None, data))
    assert sorted(map(repr, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got])) == sorted(map(repr, want))
    assert all(r.verified for r in got)
    assert spark.read.parquet(f"{path}/payloads").count() == len({w[5] for w in want})
    record = {r.page_id: bytes(r.record) for r in record_bytes(read_archive(spark, path)).collect()}
    head, http, body = record[7].split(b"\r\n\r\n")[:3]
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Payload-Digest: sha1:") and body == BIG.encode()
    assert b"Content-Length: %d\r\n" % (len(http) + 4 + len(body)) in head + b"\r\n"
    assert BIG.encode() not in record[2] and b"WARC-Refers-To: <urn:page:7>\r\n" in record[2]
    assert b"X: y" in record[3] and b"\r\nX: y" not in record[3]


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_line_separators_in_a_url_forge_no_field(spark):
    urls = ["http://a/x WARC-Refers-To: <urn:page:5>", "http://a/\u0085y", "http://a/ WARC-Type: revisit", "http://a/plain"]
    pages = spark.createDataFrame([(i, u, "small") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in archive_pages(pages).collect()}
    assert [got[i].url for i in range(4)] == urls
    assert all(r.refers_to is None and r.record_type == "response" and r.verified for r in got.values())
