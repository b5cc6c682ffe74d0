"""WARC archives with revisit records."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, frees_shuffles, join_shared, may_have, new_path, scratch

LEAST_BYTES = 100
RECORD_END = "\r\n\r\n"
#: Most bytes of a file before compression: an archive is read as one value, which has to be under 2 GB.
FILE_BYTES = 1 << 30


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, date: str = "2026-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Write one record per page to gzipped WARC 1.1 files in the folder `path`, revisits without their payload.

    Of equal payloads of at least `least_bytes` the row with the smallest id (null ids last; of repeated rows the first by url) is
    the response. Headers (id, url, digest, size) alone are shuffled to find these; hot digests are joined apart. Revisits are
    written from their headers. Payloads stay where they are read, but for responses whose digest may stand twice: these, one of
    each group, meet their headers once. Spark's text writer makes the files (its line end is the record end), so they go to any store it
    can write; no file has more than `file_bytes` before compression, or one record. Null html is an empty payload, null url an
    empty target; null ids write `null`. Empty tables write no record; other columns are not read.
    """
    pages = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.unhex(F.sha2(F.col("html").cast("binary"), 256))).withColumn("bytes", F.octet_length("html").cast("long"))
    name = ["digest", "page_id", "url"]
    headers = cut(pages.groupBy(*name, "bytes").agg(F.count(F.lit(1)).alias("copies")), "warc-headers")
    shared = headers.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.sum("copies").alias("n")).where("n > 1")
    found = join_shared(headers, shared, "digest")
    first = F.coalesce(F.col("first.page_id").eqNullSafe(F.col("page_id")) & (F.col("first.url") == F.col("url")), F.lit(False))
    again = F.col("copies") - F.when(first, 1).otherwise(0)
    revisits = found.where(F.col("first").isNotNull() & (again > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1), again.cast("int"))))
    revisits = revisits.select(*name, F.lit("").alias("html"), F.lit(False).alias("response"), F.col("first.page_id").alias("original"))

    # Which payloads move: responses of digests that may stand twice. The same filter decides for headers and pages.
    twice = bitmap(shared.select(F.xxhash64("digest")))
    by_digest = lambda df: may_have(df.withColumn("hash", F.xxhash64("digest")), twice, "hash").withColumn("may", F.col("__may") & (F.col("bytes") >= least_bytes)).drop("__may", "hash")
    wanted = cut(by_digest(found).where(F.col("may") & (F.col("first").isNull() | first)).select(*name), "warc-responses")
    marked = by_digest(pages)
    moving = may_have(marked.where("may").withColumn("hash", F.xxhash64(*name)), bitmap(wanted.select(F.xxhash64(*name))), "hash").where("__may")
    null = F.coalesce(F.col("page_id"), F.lit(0)), F.col("page_id").isNull()
    keyed = lambda df: df.withColumn("p", null[0]).withColumn("none", null[1])
    moved = keyed(moving).join(keyed(wanted).select("digest", "url", "p", "none"), ["digest", "url", "p", "none"], "left_semi").dropDuplicates(["digest", "url", "p", "none"])
    responses = marked.where(~F.col("may")).select(*name, "html").union(moved.select(*name, "html"))
    rows = responses.select("*", F.lit(True).alias("response"), F.lit(None).cast("long").alias("original")).union(revisits)

    show = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    response, digest = F.col("response"), F.lower(F.hex("digest"))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.col("html"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), show("page_id")),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), show("original"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    longest = headers.agg(F.max(F.col("bytes") + F.octet_length("url"))).first()[0] or 0
    out = rows.select(F.concat(header, F.lit("\r\n\r\n"), block).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip")
    with frees_shuffles(pages.sparkSession):
        out.option("maxRecordsPerFile", str(max(1, file_bytes // (longest + 1024)))).text(path)


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an uncompressed WARC stream; holds one record at a time."""
    held = bytearray()
    more = iter(chunks)

    def fill(n: int) -> bool:
        while len(held) < n:
            x = next(more, None)
            if x is None:
                return False
            held.extend(x)
        return True

    while True:
        at = held.find(b"\r\n\r\n")
        while at < 0:
            if not fill(len(held) + 1):
                if held.strip():
                    raise ValueError("a WARC file ends inside a header")
                return
            at = held.find(b"\r\n\r\n")
        lines = bytes(held[:at]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        size = int(head["Content-Length"])
        if not fill(at + 4 + size + 4):
            raise ValueError("a WARC file ends inside a payload")
        yield head, bytes(held[at + 4 : at + 4 + size])
        del held[: at + 8 + size]


def inflate(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Gzip members one after another, a step at a time."""
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data, step)
        while z.unconsumed_tail:
            yield z.decompress(z.unconsumed_tail, step)
        yield z.flush()
        data = z.unused_data


def read_archives(spark, path: str) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest, refers_to of every record, in any file of the folder.

    The payload's own digest is computed and must equal the header's. Revisits have no payload here; see `resolved`.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        number = lambda x: None if x is None or x == "<urn:page:null>" else int(x[10:-1])
        for batch in batches:
            rows = []
            for data in batch["content"]:
                for head, block in records(inflate(data)):
                    payload = block.split(b"\r\n\r\n", 1)[1]
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: the payload differs from its digest")
                    rows.append((number(head["WARC-Record-ID"]), kind, len(payload), digest, number(head.get("WARC-Refers-To"))))
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=t) for i, (n, t) in enumerate((("page_id", "Int64"), ("record_type", object), ("payload_bytes", "Int64"), ("payload_digest", object), ("refers_to", "Int64")))})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInPandas(parse, "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def resolved(archive: DataFrame) -> DataFrame:
    """Revisits get the full payload's size from the response that has their digest. Digests that only responses have don't
    take part in the join, and those that very many revisits have are joined apart."""
    kind = F.col("record_type")
    sizes = archive.groupBy("payload_digest").agg(F.max(F.when(kind == "response", F.col("payload_bytes"))).alias("full"), F.count(F.when(kind == "revisit", 1)).alias("n")).where("n > 0")
    found = join_shared(archive, sizes, "payload_digest")
    size = F.when(kind == "response", F.col("payload_bytes")).otherwise(F.col("full"))
    return found.select("page_id", size.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives, read them back and resolve the revisits: one row per page.

    Nulls, ties and repeated rows: see write_archives. Empty tables give no rows; long
    payloads are held one at a time by the reader.
    """
    path = path or new_path(pages.sparkSession, "warc")
    with scratch(pages.sparkSession) as made:
        write_archives(pages, path, **options)
        archive = made.keep(read_archives(pages.sparkSession, path), "warc-records")
    return resolved(archive)


SQL = """
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND rn > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND rn > 1 THEN first_id END AS refers_to
FROM (SELECT page_id, h, row_number() OVER w AS rn, first_value(page_id) OVER w AS first_id
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages) WINDOW w AS (PARTITION BY h ORDER BY page_id NULLS LAST))
"""
