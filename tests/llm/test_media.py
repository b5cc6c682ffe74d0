import hashlib
import random
import zlib

import pytest

from eventspan.llm import media


def test_cuts_follow_the_plain_gear_rule():
    r = random.Random(3)
    for n in (0, 1, 31, 33, 2047, 2048, 5000, 200_000):
        data = bytes(r.choice(b"abcdefgh ") for _ in range(n)) if n != 5000 else b"a" * n
        ends, last, h = [], 0, 0
        for i, b in enumerate(data):
            h = (h << 1) + int(media.GEAR[b]) & 0xFFFFFFFF
            if i + 1 - last >= media.LEAST and h >> 20 == 0 or i + 1 - last == media.MOST:
                last = i + 1
                ends.append(last)
        if last < n:
            ends.append(n)
        assert media.cuts(data) == ends
        assert b"".join(media.chunks_of(data)) == data


@pytest.mark.parametrize("hot", [1, 1000])
def test_round_trip(spark, monkeypatch, hot):
    monkeypatch.setattr(media, "HOT_USES", hot)
    monkeypatch.setattr(media.rebuild, "__defaults__", (hot,))
    r = random.Random(4)
    shared = "".join(r.choice("abcdefgh éñ") for _ in range(60_000))
    texts = [None, "", "a", shared, shared, shared + "tail", "head " + shared, "ñ" * 576, "x" * 576]
    rows = [(i if i else None, t, b"x", 1) for i, t in enumerate(texts)] + [(3, shared, b"x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest binary, seq int").repartition(3)
    got = media.media(df).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        pay = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        want.setdefault(i, []).append((len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])))
    for x in got:
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) in want[x.doc_id]
    by = {}
    for x in got:
        by.setdefault(x.payload_sha256, set()).add((x.media_bytes, x.media_sha256, x.feature))
    assert all(len(v) == 1 for v in by.values())
    assert media.media(df.limit(0)).count() == 0


def test_known_chunks_are_not_stored_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc"), (2, "abd")], "doc_id long, text string")
    known = spark.createDataFrame([(bytearray(media.chunk_key(media.payload_of("abc"))),)], "digest binary")
    name = media.write_chunks(df, str(tmp_path / "store"), 2, known=known)
    assert spark.table(name).count() == 1
    spark.sql(f"DROP TABLE {name}")
