"""WARC archives of pages: written in segments, read back by segment reassembly.

Writing: a page becomes an HTTP response with chunked transfer framing, in a WARC record. A
record longer than a segment is split into continuation records, which name the first record's
identifier (the origin) and their number; the last one states the total length. A page whose
payload another one already has becomes a revisit record, which refers to that page's record.

Reading: records that are whole pass straight through. Continuations are grouped by origin
and ordered by number; the blocks must follow each other without a gap and add up to the
stated total. Then the chunked framing is undone, and the payload's digest is verified.

Files are plain text files of records to Spark: the blocks are bytes, and every record ends in
two line ends, the second of which is Spark's line separator.

Defined results: null payloads count as empty; a null url has no target header. Payloads below
MIN_BYTES are always responses. Of equal larger payloads all rows with the smallest id are
responses (null ids come last), so rows repeated with the same id, url and payload stay alike.
An empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyedflow.llm.common import store, table
from keyedflow.plans.runs import work_folder

MIN_BYTES = 100
#: Bytes of a block, of a chunk of the transfer framing, and records of a file: a file holds
#: 64 MiB of blocks at most, which a reading task has in memory.
SEGMENT, CHUNK, FILE_RECORDS = 16 << 10, 8 << 10, 4096
#: Fixed date, so that the archives of a table are the same whenever they are written.
DATE = "2024-01-01T00:00:00Z"
END = b"\r\n"


def record_id(page: str, url: str, digest: str) -> str:
    h = hashlib.md5(f"{page}\n{url}\n{digest}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK] for i in range(0, len(payload), CHUNK)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        end = body.index(END, at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        if len(parts[-1]) != size or body[end + 2 + size : end + 4 + size] != END:
            raise ValueError("a chunk is shorter than it says")
        at = end + 4 + size


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", str(len(block)))])
    # The line separator that Spark adds is the second line end.
    return b"WARC/1.1\r\n" + lines.encode() + END + block + END


def records(page: str, url: str, payload: bytes, digest: str, refers: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of a page; ``refers`` is the record identifier that a revisit names."""
    own = record_id(page, url, digest)
    headers = [("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Page-Id", page)]
    if url:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if refers:
        kind = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), ("WARC-Refers-To", refers)]
        yield record([*kind, *headers, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], http)
        return
    block = http + chunked(payload)
    blocks = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *headers]
    yield record(first + [("WARC-Segment-Number", "1")] * (len(blocks) > 1), blocks[0])
    for number, part in enumerate(blocks[1:], 2):
        kind = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page, url, f"{digest}/{number}")), ("WARC-Date", DATE)]
        kind += [("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number))]
        yield record(kind + [("WARC-Segment-Total-Length", str(len(block)))] * (number == len(blocks)), part)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, segment: int = SEGMENT) -> None:
    """Write ``pages`` (page_id, url, html) as gzipped archives into ``folder``."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"),
        F.coalesce("url", F.lit("")).alias("url"),
        html.alias("payload"),
        F.sha2(html, 256).alias("digest"),
        F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url")).alias("rank"),
    )
    # One row for each payload that occurs twice or more; only these are looked up.
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")
    ).where("n > 1")
    joined = rows.join(first, "digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("rank.id").eqNullSafe(F.col("first.id"))
    joined = joined.select(
        "page", "url", "digest",
        F.when(~revisits, F.col("payload")).alias("payload"),
        F.when(revisits, F.coalesce(F.col("first.id").cast("string"), F.lit(""))).alias("first_page"),
        F.col("first.url").alias("first_url"),
    )

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p in batch.itertuples(index=False):
                revisit = isinstance(p.first_page, str)
                refers = record_id(p.first_page, p.first_url, p.digest) if revisit else ""
                out.extend(records(p.page, p.url, b"" if revisit else p.payload, p.digest, refers, segment))
            yield pd.DataFrame({"record": out})

    made = joined.mapInPandas(written, "record binary").select(F.col("record").cast("string"))
    made.write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(folder)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of the records of one archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start, size = end + 4, int(headers["Content-Length"])
        yield headers, content[start : start + size]
        if content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not as long as it says")
        at = start + size + 4


def read_records(spark, folder: str) -> DataFrame:
    """The records of all archives below ``folder``."""
    schema = "id string, type string, page string, digest string, refers string, origin string, number int, total long, block binary"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = [
                    (
                        h["WARC-Record-ID"], h["WARC-Type"], h.get("X-Page-Id"), h.get("WARC-Payload-Digest", "").removeprefix("sha256:"),
                        h.get("WARC-Refers-To"), h.get("WARC-Segment-Origin-ID"), int(h.get("WARC-Segment-Number", 0)),
                        int(h.get("WARC-Segment-Total-Length", -1)), block,
                    )
                    for h, block in parsed(gzip.decompress(content))
                ]
                yield pd.DataFrame(rows, columns=["id", "type", "page", "digest", "refers", "origin", "number", "total", "block"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select("content")
    return files.mapInPandas(read, schema)


def reassembled(segments: DataFrame) -> DataFrame:
    """Whole records from segments: by origin, in order of number, of the stated length.

    Records that were written more than once come back as often.
    """
    origin = F.coalesce("origin", "id")
    each = segments.groupBy(origin.alias("id"), "number").agg(
        F.count(F.lit(1)).alias("copies"), F.first("block").alias("block"), F.max("total").alias("total"),
        F.max("page").alias("page"), F.max("digest").alias("digest"),
    )
    whole = each.groupBy("id").agg(
        F.min("copies").alias("copies"), F.max("total").alias("total"), F.max("page").alias("page"), F.max("digest").alias("digest"),
        F.max("number").alias("last"), F.count(F.lit(1)).alias("parts"),
        F.array_sort(F.collect_list(F.struct("number", "block"))).alias("blocks"),
    )
    block = F.aggregate("blocks", F.lit(b""), lambda a, b: F.concat(a, b["block"]))
    whole = whole.withColumn("block", block)
    sound = (F.col("parts") == F.col("last")) & (F.octet_length("block") == F.col("total"))
    block = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), F.col("id"))))
    return whole.select("id", "page", "digest", block.alias("block"), F.explode(F.expr("sequence(1, copies)")).alias("_copy")).drop("_copy")


def payloads(whole: DataFrame) -> DataFrame:
    """``id, page, payload`` of whole responses, the framing undone and the digest verified."""

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for block, digest in zip(batch["block"], batch["digest"]):
                head, body = block.split(b"\r\n\r\n", 1)
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError("a payload's digest is not as stated")
                found.append(payload)
            yield pd.DataFrame({"id": batch["id"], "page": batch["page"], "payload": found})

    return whole.select("id", "page", "digest", "block").mapInPandas(decoded, "id string, page string, payload binary")


def read_archives(spark, folder: str) -> DataFrame:
    """``page, payload_bytes, payload_digest, record_type, refers_to`` of every page."""
    found = read_records(spark, folder)
    segmented = F.col("origin").isNotNull() | (F.col("number") > 0)
    single = found.where((F.col("type") == "response") & ~segmented).select("id", "page", "digest", "block")
    responses = payloads(single.unionByName(reassembled(found.where(segmented)))).select(
        "id", "page", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )
    responses = store(responses)
    named = responses.dropDuplicates(["id"]).select(F.col("id").alias("refers"), F.col("page").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = found.where("type = 'revisit'").select("page", "refers").join(named, "refers", "left")
    return responses.select(
        "page", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("string").alias("refers_to")
    ).unionByName(revisits.select("page", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    folder = work_folder(spark)
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    as_id = lambda c: F.nullif(F.col(c), F.lit("")).cast(kind)
    return read_archives(spark, folder).select(
        as_id("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", as_id("refers_to").alias("refers_to")
    )


OP4_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
