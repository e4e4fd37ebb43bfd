import hashlib

from kinolake.llm import warc as W

BIG, OTHER = "p" * 1200, "q" * 999


def test_round_trip_and_roles(spark, tmp_path):
    rows = [(1, "http://a", BIG, 5), (2, "http://b", BIG, 5), (7, None, BIG, 5), (3, "http://c", OTHER, 5), (4, "http://d\r\nX: y", OTHER, 5), (5, "e", None, 5), (6, "f", "é" * 600, 5), (None, "g", BIG, 5), (8, "http://h", "end\r\n\r\n", 5), (7, None, BIG, 5)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    W.write_archive(pages, str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == 5
    got = W.read_records(spark, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for i, _, h, _ in rows if i == r["page_id"]) or ""
        body = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        first = len(body) < 1000 or r["page_id"] in (6, 7)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", 7))
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")).split()[1])
        assert rest == (body if first else b"") + b"\r\n\r\n" and length == len(rest) - 4
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and head.count(b"\r\n") in (6, 8)
    plain = sorted(map(repr, W.warc(pages).collect()))
    assert len(plain) == len(rows)


def test_empty_table(spark):
    assert W.warc(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
