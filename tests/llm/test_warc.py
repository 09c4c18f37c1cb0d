import pytest
from pyspark.sql import functions as F

from dialoom.llm.warc import canonical_url, http_headers, http_status, resolve_revisits


@pytest.mark.parametrize(("url", "expected"), [
    ("HTTP://User@WWW.Example.com:80/A/?b=2&utm_source=x&a=1#top", "example.com/A?a=1&b=2"), ("https://example.com", "example.com"), ("http://e.org/?ref=x", "e.org"),
    ("e.org/p//", "e.org/p"), ("http://e.org:8080/", "e.org:8080"), (None, None), ("", None), ("http://e.org?reference=1", "e.org?reference=1"),
])
def test_canonical_url(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u string").select(canonical_url(F.col("u")).alias("c")).first().c == expected


def test_headers(spark):
    block = "HTTP/1.1 304 Not Modified\r\nETag: W/\"a:b\"\r\netag: late\r\nno colon\r\n : x\nDate:\tnow "
    df = spark.createDataFrame([(block,), (None,), ("junk",)], "b string").select(http_status(F.col("b")).alias("s"), http_headers(F.col("b")).alias("h"))
    assert [(r.s, r.h) for r in df.collect()] == [(304, {"etag": 'W/"a:b"', "date": "now"}), (None, {}), (None, {})]


def full(i, url, ts, fields="", body="b"):
    return (i, url, ts, f"HTTP/1.1 200 OK\r\nContent-Type: t\r\nDate: {ts}{fields}", body, "clash")


def again(i, url, ts, fields=""):
    return (i, url, ts, f"HTTP/1.1 304 Not Modified\r\nDate: {ts}\r\nContent-Length: 0{fields}", None, "clash")


SCHEMA = "record_id long, url string, ts long, http string, body_sha256 string, source string"


def solve(spark, rows, **options):
    return {r.record_id: r for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_latest_earlier_response(spark):
    e = lambda x: f"\r\nETag: {x}"
    rows = [
        full(1, "http://a/x", 10, e('"1"'), "old"), full(2, "https://a/x/", 50, e('"2"'), "new"), again(3, "http://a/x#f", 40, e('W/"1"')), again(4, "http://a/x", 60, e('"2"')), again(5, "http://a/x", 70, e('"1"')),
        again(6, "http://a/x", 5, e('"1"')), again(7, "http://b", 9), again(8, None, 9), full(9, "http://c", 10, "\r\nLast-Modified: m"), again(10, "http://c", 10, "\r\nLast-Modified: m"), again(11, "http://c", 11, "\r\nLast-Modified: n"),
        (12, "http://a/x", 65, "HTTP/1.1 404 Not Found", None, "clash"), again(13, "http://a/x", None), again(14, "http://c", 5000),
    ]
    for width in (1, 7, 100, 10_000):
        got = solve(spark, rows, width=width)
        assert {i: (r.outcome, r.source_id) for i, r in got.items()} == {
            1: ("full", 1), 2: ("full", 2), 3: ("resolved", 1), 4: ("resolved", 2), 5: ("changed", None), 6: ("missing", None), 7: ("missing", None), 8: ("missing", None),
            9: ("full", 9), 10: ("resolved", 9), 11: ("changed", None), 12: ("other", None), 13: ("missing", None), 14: ("resolved", 9)}
        assert got[3].body_sha256 == "old" and got[3].headers == {"content-type": "t", "date": "40", "etag": 'W/"1"'} and got[5].headers["content-length"] == "0"


def test_repeated_rows_and_empty_table(spark):
    rows = [full(1, "http://a", 1), again(2, "http://a", 2), again(2, "http://a", 2)]
    assert sorted(r.outcome for r in resolve_revisits(spark.createDataFrame(rows, SCHEMA)).collect()) == ["full", "resolved", "resolved"]
    assert resolve_revisits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_fields(spark):
    block = "HTTP/1.1 200 OK\r\nVary: a\r\nSet-Cookie: x=1; p, q\r\nVARY: b\r\nSet-Cookie: y=2\r\nDate: 1\r\nDate: 2"
    got = spark.createDataFrame([(block,)], "b string").select(http_headers(F.col("b")).alias("h")).first().h
    assert got == {"vary": "a, b", "set-cookie": "x=1; p, q\ny=2", "date": "1"}


def record(kind, i, url, date, http, body=b"", more=""):
    block = http.encode() + b"\r\n\r\n" + body if http else body
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x:{i}>\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}{more}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block


def test_files_of_records(spark, tmp_path):
    import gzip
    import hashlib

    body = bytes(range(256)) * 5000 + b"\r\n\r\nWARC/1.1\r\nnot a record"
    records = [
        record("warcinfo", 0, "", "2020-01-01T00:00:00Z", "", b"software: x"), record("response", 1, "http://a/é", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nETag: \"1\"", body),
        record("revisit", 2, "<http://a/é>", "2020-01-01T00:00:07Z", "HTTP/1.1 304 Not Modified\r\nETag: \"1\"", more="\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/server-not-modified\r\nWARC-Refers-To: <urn:x:1>"),
        record("response", 3, "http://b", "bad date", "HTTP/1.1 200 OK", b""), record("request", 4, "http://b", "2020-01-01T00:00:00Z", "GET / HTTP/1.1"),
    ]
    end = b"\r\n\r\n"
    (tmp_path / "plain.warc").write_bytes(end.join(records) + end)
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(r + end) for r in records))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(end.join(records))[:-20])
    from dialoom.llm.warc import parse_records, read_warc

    cut = read_warc(spark, str(tmp_path))
    assert sorted((r.file[-8:], len(r.record)) for r in cut.where("file not like '%whole%'").collect()) == sorted((f, len(r)) for f in ("ain.warc", ".warc.gz") for r in records)
    assert cut.where("file like '%whole%'").count() >= 2
    read = parse_records(cut.where("file like '%each%'"))
    got = {r.record_id: r for r in read.collect()}
    one, two = got["<urn:x:1>"], got["<urn:x:2>"]
    assert (one.type, one.url, one.ts, one.http, one.body_sha256) == ("response", "http://a/é", 1577836800, 'HTTP/1.1 200 OK\r\nETag: "1"', hashlib.sha256(body).hexdigest())
    assert (two.type, two.url, two.ts, two.body_sha256, two.refers_to, two.profile[-12:]) == ("revisit", "http://a/é", 1577836807, None, "<urn:x:1>", "not-modified")
    assert got["<urn:x:3>"].ts is None and got["<urn:x:3>"].body_sha256 == hashlib.sha256(b"").hexdigest() and got["<urn:x:4>"].http is None
    assert {r.record_id: (r.outcome, r.source_id) for r in resolve_revisits(read).collect()}["<urn:x:2>"] == ("resolved", "<urn:x:1>")
    odd = spark.createDataFrame([(None, "x"), (b"junk", "x"), (b"", "x")], "record binary, parsed string")
    assert [tuple(r) for r in parse_records(odd).collect()] == [(None,) * 8] * 3
