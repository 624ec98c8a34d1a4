"""Operator 9, WARC archives: written from pages, read back, assembled into captures.

Each page becomes a transaction of three records: a request, a response (or a revisit, if an equal
payload of at least MIN_PAYLOAD bytes stands in a page with a smaller id) and metadata. Request and
metadata name the response in WARC-Concurrent-To. Records are made by SQL expressions and written as
text files whose line separator is the record's closing CRLF CRLF, so a file is a plain WARC archive
(gzip by default). The reader takes archives as binary files, parses records by their Content-Length
and assembles a capture by joining the three records on the concurrent-to identifiers.

Nulls and odd input: a null url leaves WARC-Target-URI out and a null html is an empty payload. A null
page id stands last in order and is written as an empty field. Pages equal in id, url and content are
numbered, so that each row gives a capture: they are counted, one of them is kept and written as often as
it stood, from many tasks if that is often. Of equal payloads exactly one row is the response: ties in id go
to the smaller url, null first. CR and LF in a url are percent-encoded. A long payload is one record, held
whole by one task. Extra columns are ignored. An empty table gives an archive without records and no captures.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, durable

MIN_PAYLOAD = 100
#: Raw bytes of records that one archive file holds, about.
FILE_BYTES = 16 << 20
END = "\r\n\r\n"
#: Up to so many different rows that stand more than once, counted, are broadcast; of one, a task writes up to COPIES.
BROADCAST_REPEATS = 1_000_000
COPIES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _urn(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\u0001null")) if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def _record(kind: Column | str, rid: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind if isinstance(kind, Column) else F.lit(kind)), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]  # a null value leaves the line out
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _hash(seed: int, *parts: Column) -> Column:
    return F.xxhash64(F.lit(seed), *parts, *[p.isNull() for p in parts])


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """For each page: key, url, html, digest, rid (its response's record id) and refers_to (the record that it revisits)."""
    df = pages.select(F.col(key), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    df = df.withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    df = df.withColumns({"a": _hash(1, F.col(key), F.col("url"), F.col("digest")), "b": _hash(2, F.col("digest"), F.col("url"), F.col(key))})
    # equal rows are counted in parts before the shuffle
    many = durable(df.select(key, "url", "digest", "size", "a", "b").groupBy(key, "url", "digest", "size", "a", "b").agg(F.count("*").alias("n")))
    first = many.where(F.col("size") >= MIN_PAYLOAD).groupBy("digest").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.coalesce("url", F.lit("")).alias("u"), F.col("url").isNotNull().alias("has_url"))).alias("f"))
    first = durable(first.select("digest", F.col("f.k").alias("first_key"), F.when(F.col("f.has_url"), F.col("f.u")).alias("first_url")))
    again = durable(many.where("n > 1").select("a", "b", "n"))
    n = again.count()
    if n:
        again = F.broadcast(again) if n <= BROADCAST_REPEATS else again
        one = df.join(again, ["a", "b"]).groupBy(key, "url", "digest", "size", "a", "b", "n").agg(F.first("html").alias("html"))
        runs = one.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES).cast("long")))).repartition("a", "run")
        copies = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * COPIES + 1, F.least(F.col("n"), (F.col("run") + 1) * COPIES)))).drop("n", "run")
        df = df.join(again.select("a", "b"), ["a", "b"], "left_anti").withColumn("copy", F.lit(1).cast("long")).unionByName(copies)
    else:
        df = df.withColumn("copy", F.lit(1).cast("long"))
    df = df.join(first, "digest", "left")
    rid = _urn("response", F.col(key), F.col("url"), F.col("digest"), F.col("copy"))
    target = _urn("response", F.col("first_key"), F.col("first_url"), F.col("digest"), F.lit(1))
    df = df.withColumns({"rid": rid, "target": target, "target_key": F.col("first_key")})
    return df.withColumn("refers_to", F.when((F.col("size") >= MIN_PAYLOAD) & (F.col("rid") != F.col("target")), F.col("target")))


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", compression: str = "gzip") -> None:
    """Write the archive of pages to the folder path, in files of about FILE_BYTES each."""
    df = plan(pages, key, url, html)
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("refers_to").isNotNull()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    response = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.col("rid"),
        [
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Refers-To", F.col("refers_to")),
            ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
    )
    request = _record("request", _urn("request", F.col("rid")), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}")))
    fields = F.concat(F.lit("page-id: "), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", _urn("metadata", F.col("rid")), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", F.col("rid")), ("Content-Type", F.lit("application/warc-fields"))], fields)
    total = pages.agg(F.count("*").alias("rows"), F.sum(F.octet_length(html).cast("long") + 2000).alias("raw")).collect()[0]
    most = max(3, round(3 * FILE_BYTES * total["rows"] / (total["raw"] or 1)))
    records = df.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", most).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, content block) of the records of an archive, compressed or not, in one member or many."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data:
            d = zlib.decompressobj(31)
            parts.append(d.decompress(data) + d.flush())
            data = d.unused_data
        data = b"".join(parts)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in data[at:end].decode("utf-8").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        begin = end + 4
        stop = begin + int(headers["content-length"])
        yield headers, data[begin:stop]
        at = stop + 4


def records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record of the archives in path. Digest and size of a response come from its bytes, a revisit's from its headers."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "kind string, rid string, concurrent_to string, refers_to string, uri string, payload_bytes long, payload_digest string, fields string, payload binary"
    arrow = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                rows, size = [], 0
                for h, block in parse(data):
                    kind, got, n, digest, fields = h["warc-type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            got, n, digest = body, len(body), hashlib.sha256(body).hexdigest()
                            if f"sha256:{digest}" != h["warc-payload-digest"]:
                                raise ValueError(f"payload digest of {h['warc-record-id']}")
                        else:
                            n = next(int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                            digest = h["warc-payload-digest"].partition(":")[2]
                    elif kind == "metadata":
                        fields = block.decode("utf-8")
                    size += len(block)
                    rows.append({"kind": kind, "rid": h["warc-record-id"], "concurrent_to": h.get("warc-concurrent-to"), "refers_to": h.get("warc-refers-to"), "uri": h.get("warc-target-uri"), "payload_bytes": n, "payload_digest": digest, "fields": fields, "payload": got if payload else None})
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.mapInArrow(run, schema)


def captures(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One nested row for each capture: rid, response, request, metadata, page_id."""
    rows = records(spark, path, payload)
    rows.write.parquet(at := f"{path.rstrip('/')}-records")  # parsed once, read by column
    rows = spark.read.parquet(at)
    main = rows.where(F.col("kind").isin("response", "revisit")).select("rid", F.struct("kind", "uri", "refers_to", "payload_bytes", "payload_digest", *(["payload"] if payload else [])).alias("response"))
    request = rows.where("kind = 'request'").select(F.col("concurrent_to").alias("rid"), F.struct(F.col("rid").alias("record_id"), "uri").alias("request"))
    metadata = rows.where("kind = 'metadata'").select(F.col("concurrent_to").alias("rid"), F.struct(F.col("rid").alias("record_id"), "fields").alias("metadata"))
    page = F.nullif(F.regexp_extract("metadata.fields", r"(?m)^page-id: (.*?)\r?$", 1), F.lit(""))
    return main.join(request, "rid", "left").join(metadata, "rid", "left").withColumn("page_id", page)


def digest(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (page id) of captures."""
    flat = found.select(F.col("page_id").cast("long").alias("page_id"), "rid", "response.kind", "response.refers_to", "response.payload_bytes", "response.payload_digest")
    target = flat.where("kind = 'response'").select(F.col("rid").alias("refers_to"), F.col("page_id").alias("_page"))
    linked = flat.where("kind = 'revisit'").join(target, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "kind", "_page")
    alone = flat.where("kind = 'response'").select("page_id", "payload_bytes", "payload_digest", "kind", F.lit(None).cast("long").alias("_page"))
    both = alone.unionAll(linked)
    return both.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("_page").alias("refers_to"))


def with_payloads(found: DataFrame) -> DataFrame:
    """captures() with column html: a revisit's payload is that of the record which it names."""
    bodies = found.where("response.kind = 'response'").select(F.col("rid").alias("_rid"), F.col("response.payload").alias("_payload"))
    source = F.coalesce("response.refers_to", "rid")
    return found.withColumn("_rid", source).join(bodies, "_rid", "left").withColumn("html", F.col("_payload").cast("string")).drop("_rid", "_payload")
