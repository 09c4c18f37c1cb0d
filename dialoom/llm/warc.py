"""WARC revisits: a not-modified capture takes its body from the latest earlier full response.

Captures of one canonical URL are joined as of their time. The join is two
level, so that a much-captured URL isn't one task's work: the last full
response of each (URL, time range) is carried over the ranges, and a window
within a range finds what is nearer. Only ids, digests and headers take part;
bodies stay where they are.

`read_warc` cuts files into records, `parse_records` reads a record's WARC and
HTTP headers and digests its body, `resolve_revisits` joins.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dialoom.llm.common import free_name, let, materialize, table

#: Header fields that a 304 response may update in the stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Fields that hold one value.
SINGLE = ("etag", "last-modified", "date", "expires", "content-length", "content-type", "location", "warc-type", "warc-date", "warc-record-id", "warc-target-uri")
#: Query parameters that don't change what is served.
TRACKING = r"^(utm_[a-z]+|gclid|fbclid|ref)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and www., path without end slashes, sorted query without tracking; no scheme or fragment.

    Null and empty give null. A text without a scheme is taken as host and path.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^[^@]*@|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING)))
    query = F.array_join(F.array_sort(params), "&")
    out = F.concat(F.regexp_replace(host, r"^www\.", ""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(out != "", out)


def http_status(block: Column) -> Column:
    """Status code of an HTTP header block; null where it has none."""
    return F.regexp_extract(F.coalesce(block, F.lit("")), r"^HTTP/\S+ (\d{3})", 1).try_cast("int")


def http_headers(block: Column) -> Column:
    """Map of lower-case field names to values; lines without a colon don't count.

    Values of a repeated field are joined: by a comma, or by a newline for
    `set-cookie`; of fields that hold one value the first counts.
    """
    lines = F.filter(F.split(F.coalesce(block, F.lit("")), r"\r?\n"), lambda x: F.regexp_like(x, F.lit(r"^[!-9;-~]+:")))
    pairs = F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ":", 1)).alias("k"), F.regexp_extract(x, r"^[^:]*:[ \t]*(.*?)[ \t]*$", 1).alias("v")))

    def entry(k: Column, pairs: Column) -> Column:
        values = F.transform(F.filter(pairs, lambda p: p["k"] == k), lambda p: p["v"])
        joined = F.when(k == "set-cookie", F.array_join(values, "\n")).otherwise(F.array_join(values, ", "))
        return F.struct(k.alias("k"), F.when(k.isin(*SINGLE), values[0]).otherwise(joined).alias("v"))

    return let(pairs, lambda p: F.map_from_entries(F.transform(F.array_distinct(F.transform(p, lambda x: x["k"])), lambda k: entry(k, p))))


def _records(data: bytes) -> Iterator[bytes]:
    """Records of a file, gzipped as a whole, by record, or not at all; what no record begins in is skipped."""

    def plain() -> Iterator[bytes]:
        if data[:2] != b"\x1f\x8b":
            yield data
            return
        left = memoryview(data)
        while len(left):
            member = zlib.decompressobj(31)
            for i in range(0, len(left), 1 << 20):
                yield member.decompress(left[i : i + (1 << 20)])
                if member.eof:
                    left = left[min(i + (1 << 20), len(left)) - len(member.unused_data) :]
                    break
            else:
                return  # cut off: what was whole has been given out

    held = b""
    for piece in plain():
        held += piece
        while True:
            at = held.find(b"WARC/")
            end = held.find(b"\r\n\r\n", max(at, 0))
            if at < 0 or end < 0:
                break
            size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", held[at:end])
            stop = end + 4 + int(size[1] if size else 0)
            if stop > len(held):
                break
            yield held[at:stop]
            held = held[stop:]


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Rows (file, record) of the WARC files under `path`, plain or gzipped; a file, of 2 GB at most, is one task's work.

    A record that is cut off at the end of its file is left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrived:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for record in _records(content.as_buffer().to_pybytes()):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([record], pa.binary())], names=["file", "record"])

    return files.mapInArrow(run, "file string, record binary")


def parse_records(records: DataFrame, record: str = "record") -> DataFrame:
    """Rows (record_id, type, profile, refers_to, url, ts, http, body_sha256) of binary WARC records.

    `ts` is WARC-Date in seconds; `http` the HTTP header block of the content,
    null where there is none; the digest is of the body of a `response`, after
    its HTTP header, so a revisit has none. A null record, and one without a
    header, is null in all. Repeated rows stay.
    """
    # Each byte one character, so that lengths and places count bytes.
    latin = F.decode(F.col(f"`{record}`"), "ISO-8859-1")
    text = lambda x: F.coalesce(F.try_validate_utf8(F.encode(x, "ISO-8859-1").cast("string")), x)

    def parts(x: Column) -> Column:
        head = F.substring_index(x, "\r\n\r\n", 1)
        fields = F.when(head.startswith("WARC/"), http_headers(text(head)))
        return F.struct(fields.alias("fields"), F.substring(x, F.char_length(head) + 5, F.char_length(x)).alias("block"))

    def read(p: Column) -> Column:
        field = lambda name: F.try_element_at(p["fields"], F.lit(name))
        size = F.coalesce(field("content-length").try_cast("int"), F.char_length(p["block"]))
        block = F.substring(p["block"], F.lit(1), size)
        http = F.when(block.startswith("HTTP/"), F.substring_index(block, "\r\n\r\n", 1))
        body = F.substring(block, F.char_length(http) + 5, F.char_length(block))
        digest = F.when(F.lower(field("warc-type")) == "response", F.sha2(F.encode(body, "ISO-8859-1"), 256))
        return F.struct(
            field("warc-record-id").alias("record_id"), F.lower(field("warc-type")).alias("type"), field("warc-profile").alias("profile"), field("warc-refers-to").alias("refers_to"),
            F.regexp_replace(field("warc-target-uri"), "^<|>$", "").alias("url"), F.unix_seconds(F.try_to_timestamp(field("warc-date"))).alias("ts"), text(http).alias("http"), digest.alias("body_sha256"))

    name = free_name(records, "parsed")
    return records.select(let(let(latin, parts), read).alias(name)).select(F.col(f"`{name}`.*"))


def same_validators(revisit: Column, full: Column) -> Column:
    """Whether the revisit's validators fit: entity tags compared weakly, else dates; none at all fit."""
    tag = lambda m: F.regexp_replace(F.try_element_at(m, F.lit("etag")), r"^W/", "")
    date = lambda m: F.try_element_at(m, F.lit("last-modified"))
    return (
        F.when(tag(revisit).isNotNull() & tag(full).isNotNull(), tag(revisit) == tag(full))
        .when(date(revisit).isNotNull() & date(full).isNotNull(), date(revisit) == date(full))
        .otherwise(F.lit(True))
    )


def merged_headers(revisit: Column, full: Column) -> Column:
    """The full response's fields, permitted ones replaced by the revisit's."""
    new = F.map_filter(revisit, lambda k, _: k.isin(*PERMITTED))
    old = F.map_filter(full, lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))
    return F.map_concat(old, new)


def resolve_revisits(records: DataFrame, *, width: int = 86_400) -> DataFrame:
    """Rows of records (record_id, url, ts, http, body_sha256) with source_id, outcome, headers and body.

    A row with status 200 and a body digest is a full response; status 304 is a
    revisit. Earlier means a lesser ts, or the same and a lesser record_id; a
    null ts comes first. Outcomes: `full`; `resolved`; `changed`, the validators
    differ; `missing`, nothing earlier or no URL; `other`, any other status.
    Repeated rows are rows of their own and find the same response; other columns
    are not read; an empty table gives no rows. `width`
    is the length of a time range in units of ts.
    """
    read = records.select(
        "record_id", "ts", canonical_url(F.col("url")).alias("key"), http_status(F.col("http")).alias("status"),
        http_headers(F.col("http")).alias("headers"), "body_sha256").withColumn("range", F.floor(F.coalesce("ts", F.lit(0)) / width))
    full = (F.col("status") == 200) & F.col("body_sha256").isNotNull()
    read = read.withColumn("kind", F.when(full, "full").when(F.col("status") == 304, "revisit").otherwise("other"))
    # Written once: four branches read it, and headers are parsed and bodies digested for all of them.
    read = materialize(read, "warc-read")
    facts = F.struct("record_id", "headers", "body_sha256")
    known = read.where("key is not null and kind <> 'other'").withColumn("fact", F.when(F.col("kind") == "full", facts))
    order = F.struct("ts", "record_id")
    last = known.where("kind = 'full'").groupBy("key", "range").agg(F.max_by("fact", order).alias("last"))
    spans = known.groupBy("key", "range").agg(F.lit(1).alias("one")).join(last, ["key", "range"], "left")
    ranges = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("key", "range", F.last("last", ignorenulls=True).over(ranges).alias("carried"))
    within = Window.partitionBy("key", "range").orderBy(F.col("ts").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = known.withColumn("near", F.last("fact", ignorenulls=True).over(within)).join(carried, ["key", "range"])
    found = near.withColumn("source", F.when(F.col("kind") == "revisit", F.coalesce("near", "carried")))
    rest = read.where("key is null or kind = 'other'").withColumn("source", F.lit(None).cast(found.schema["source"].dataType))
    cols = ["record_id", "key", "ts", "kind", "headers", "body_sha256", "source"]
    every = found.select(*cols).unionByName(rest.select(*cols))
    fits = same_validators(F.col("headers"), F.col("source.headers"))
    outcome = (
        F.when(F.col("kind") != "revisit", F.col("kind"))
        .when(F.col("source").isNull(), "missing").when(fits, "resolved").otherwise("changed")
    )
    got = F.col("outcome") == "resolved"
    return every.withColumn("outcome", outcome).select(
        "record_id", F.col("key").alias("canonical"), "ts", "outcome",
        F.when(got, F.col("source.record_id")).when(F.col("outcome") == "full", F.col("record_id")).alias("source_id"),
        F.when(got, F.col("source.body_sha256")).otherwise(F.col("body_sha256")).alias("body_sha256"),
        F.when(got, merged_headers(F.col("headers"), F.col("source.headers"))).otherwise(F.col("headers")).alias("headers"))


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of each page: its full response, and a later revisit by a variant of its URL.

    By page_id modulo 4 the revisit has the same entity tag (weak), another
    one, the same date, or no validator.
    """
    p = F.col("page_id")
    tag = F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16)
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    date = line("Last-Modified", F.concat(F.lit("day "), p.cast("string")))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nCache-Control: max-age=60"), line("Date", (p * 10).cast("string")))
    full = F.concat(head, F.when(p % 4 < 2, line("ETag", F.concat(F.lit('"'), tag, F.lit('"')))).otherwise(date))
    later = p * 10 + 5 + p % 7 * 1000
    again = F.concat(
        F.lit("HTTP/1.1 304 Not Modified\r\nContent-Length: 0\r\nCache-Control: max-age=120"), line("Date", later.cast("string")),
        F.when(p % 4 == 0, line("ETag", F.concat(F.lit('W/"'), tag, F.lit('"')))).when(p % 4 == 1, line("ETag", F.lit('"other"'))).when(p % 4 == 2, date).otherwise(""))
    first = F.struct((p * 2).alias("record_id"), F.col("url").alias("url"), (p * 10).alias("ts"), full.alias("http"), F.sha2("html", 256).alias("body_sha256"))
    second = F.struct((p * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), later.alias("ts"), again.alias("http"), F.lit(None).cast("string").alias("body_sha256"))
    return pages.select(F.inline(F.array(first, second)))


def op9_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages")), width=20_000)
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    source = F.coalesce("source_id", F.lit(-1)).alias("source_id")  # -1: none
    return found.select("record_id", "canonical", "ts", "outcome", source, "body_sha256", F.sha2(F.array_join(lines, "\n"), 256).alias("headers_sha256"))
