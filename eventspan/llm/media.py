"""Media columns: payloads stored as content-defined chunks, each distinct chunk once."""

from __future__ import annotations

import bz2
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, frees_shuffles, join_shared, map_texts, new_path, small

UNIT = 576
LEAST, MOST, CUT_BITS = 2048, 32768, 12
HOT_USES = 1000
BUCKET_BYTES = 64 << 20
MAGIC = b"ESCL1"
#: A 32-bit number for each byte value, from a rule.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


def payload_of(text: str) -> bytes:
    """UTF-8, filled up with bytes 255 to a positive multiple of UNIT."""
    data = text.encode("utf-8", "replace")
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the rolling gear hash of the last 32 bytes has its top bits zero, at least LEAST and at most
    MOST bytes after the last cut. The hash is the sum of shifted byte numbers, so it doubles its window in five steps."""
    n = len(data)
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):
        if n > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    ends, last = [], 0
    for c in (np.nonzero(h >> np.uint32(32 - CUT_BITS) == 0)[0] + 1).tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            last = c
            ends.append(c)
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def chunk_key(chunk: bytes) -> bytes:
    """128 bits of its SHA-256; the whole payload is verified by all 256 of its own."""
    return hashlib.sha256(chunk).digest()[:16]


def recipe(n_bytes: int, digests: list[bytes]) -> bytes:
    return MAGIC + struct.pack("<QI", n_bytes, len(digests)) + b"".join(digests)


def feature_of(payload: bytes) -> str:
    """Of the payload as 8-bit samples around 128."""
    x = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    y = x.astype(np.int16) - 128
    rms = np.sqrt((y.astype(np.int64) ** 2).mean())
    crossings = int(((y[1:] < 0) != (y[:-1] < 0)).sum())
    return f"mean={x.mean():.4f};rms={rms:.4f};crossings={crossings};entropy={entropy:.4f}"


def manifests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload (its SHA-256), digests (of its chunks, in order) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                data = payload_of(text)
                rows.append((len(text.encode("utf-8", "replace")), hashlib.sha256(data).digest(), [chunk_key(c) for c in chunks_of(data)]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": pd.Series([r[0] for r in rows], dtype="int64"), "payload": [r[1] for r in rows], "digests": [r[2] for r in rows]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_texts(rows, run, "doc_id long, n_bytes long, payload binary, digests array<binary>")


def write_chunks(docs: DataFrame, path: str, buckets: int, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> str:
    """Write each distinct chunk once, compressed, to a table bucketed by digest in the folder `path`; returns its name.

    A task sends a digest once; what tasks have in common meets by digest. known: a store's digests, left out by an anti
    join. The buckets let later joins by digest read the bytes where they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for batch in small(batches):
            rows, held = [], 0
            for text in batch["text"]:
                for c in chunks_of(payload_of(text)):
                    d = chunk_key(c)
                    if d not in seen:
                        seen.add(d)
                        rows.append((d, bz2.compress(c)))
                        held += len(c)
                if held > 8 << 20:
                    yield pd.DataFrame(rows, columns=["digest", "data"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["digest", "data"])

    spark, name = docs.sparkSession, f"eventspan_chunks_{uuid.uuid4().hex}"
    found = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).mapInPandas(run, "digest binary, data binary")
    if known is not None:
        found = found.join(known.select("digest"), "digest", "left_anti")
    with frees_shuffles(spark):
        found.repartition(buckets, "digest").dropDuplicates(["digest"]).write.bucketBy(buckets, "digest").option("path", path).option("compression", "none").saveAsTable(name)
    return name


def rebuild(entries: DataFrame, store: DataFrame, hot_uses: int = HOT_USES) -> DataFrame:
    """entries: payload, n_bytes, n, seq, digest. Returns a row per payload with n and what its rebuilt bytes and stored form show.

    Entries meet the store's buckets by digest; the bytes move once, to their payload. Digests of more than hot_uses entries and
    of more than a partition's share of them are at most as many as partitions: their chunks are broadcast. Chunks are put in
    order and the whole is verified by its digest, one payload at a time.
    """
    spark = entries.sparkSession
    uses = cut(entries.groupBy("digest").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") > hot_uses), "hot-chunks")
    share = F.col("uses") > (uses.agg(F.sum("uses")).first()[0] or 0) / int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = uses.where(share).select("digest")
    cold = entries.join(F.broadcast(hot), "digest", "left_anti").hint("shuffle_hash").join(store, "digest")
    many = entries.join(F.broadcast(store.join(F.broadcast(hot), "digest", "left_semi")), "digest")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["payload", "n", "payload_bytes", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        at, n_bytes, many, digests, parts, stored, rows = None, 0, 0, [], [], [], []

        def close():
            data = b"".join(parts)
            if hashlib.sha256(data).digest() != at:
                raise ValueError("a payload rebuilt from its chunks differs from its digest")
            form = recipe(n_bytes, digests) + b"".join(stored)
            rows.append((at, many, len(data), zlib.crc32(data[-32:]), len(form), hashlib.sha256(form).hexdigest(), feature_of(data)))

        for batch in batches:
            for payload, n, count, data in zip(batch["payload"], batch["n_bytes"], batch["n"], batch["data"]):
                payload, data = bytes(payload), bytes(data)
                if payload != at:
                    if at is not None:
                        close()
                    at, n_bytes, many, digests, parts, stored = payload, n, count, [], [], []
                chunk = bz2.decompress(data)
                digests.append(chunk_key(chunk))
                parts.append(chunk)
                stored.append(data)
            yield pd.DataFrame(rows, columns=columns)
            rows = []
        if at is not None:
            close()
            yield pd.DataFrame(rows, columns=columns)

    columns = ["payload", "n_bytes", "n", "seq", "data"]
    ordered = cold.select(columns).union(many.select(columns)).repartition("payload").sortWithinPartitions("payload", "seq")
    return ordered.mapInPandas(run, "payload binary, n long, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The stored form is the ordered chunk list followed by its stored chunks; chunks that payloads share are stored once.
    Equal texts have one payload: it is rebuilt once and its row joined to all of them, hot ones apart. Null text counts as empty and is 576
    filling bytes. Repeated rows and null ids each give a row; empty tables none. Only two columns are read.
    """
    spark = docs.sparkSession
    lists = cut(manifests(docs, id_col, text_col), "manifests")
    total = lists.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    name = write_chunks(docs, new_path(spark, "chunks"), buckets, id_col, text_col)
    store = spark.table(name)
    entries = lists.groupBy("payload").agg(F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"), F.first("digests").alias("digests")).select("payload", "n_bytes", "n", F.posexplode("digests").alias("seq", "digest"))
    found = join_shared(lists.drop("digests"), rebuild(entries, store), "payload")
    spark.sql(f"DROP TABLE {name}")
    return found.select("doc_id", "n_bytes", "payload_bytes", F.lower(F.hex("payload")).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature")
