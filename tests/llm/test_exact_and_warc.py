import hashlib

from eventspan.llm import exact_dedup, warc


def test_exact_dedup_edges(spark):
    rows = [(1, "a"), (5, "a"), (5, "a"), (None, "a"), (2, None), (3, ""), (None, "only"), (None, "only"), (9, "A"), (7, "x" * 300_000)]
    df = spark.createDataFrame([(i, t, "d", 3, True) for i, t in rows], "doc_id long, text string, digest string, n int, salt boolean").repartition(4)
    got = exact_dedup.exact_dedup(df).collect()
    assert len(got) == len(rows)
    want = []
    for t in {x[1] or "" for x in rows}:
        ids = [i for i, x in rows if (x or "") == t]
        best = max((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            want.append((i, best, len(ids), i == best and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != best
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_hot_group_is_whole(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text").repartition(6)
    got = exact_dedup.exact_dedup(df)
    assert got.where("keep_id = 2997 AND group_size = 1000").count() == 1000 and got.where("kept").count() == 2001


def test_warc_round_trip(spark, tmp_path):
    big, odd = "<p>" + "ñ" * 80, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\0" * 5
    rows = [(4, "http://a", big), (2, "http://b\r\nX: y", big), (2, "http://b", big), (7, None, odd), (8, "u", odd), (1, "u", "short"), (3, "u", "short"), (5, "u", None), (None, "u", big), (6, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "page_id long, url string, html string, digest int, salt string").repartition(3)
    got = warc.round_trip(df, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    size = lambda t: len((t or "").encode())
    want = [
        (4, size(big), digest(big), "revisit", 2), (2, size(big), digest(big), "response", None), (2, size(big), digest(big), "revisit", 2), (None, size(big), digest(big), "revisit", 2),
        (7, size(odd), digest(odd), "response", None), (8, size(odd), digest(odd), "revisit", 7), (1, 5, digest("short"), "response", None), (3, 5, digest("short"), "response", None),
        (5, 0, digest(""), "response", None), (6, 3_000_000, digest("z" * 3_000_000), "response", None),
    ]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    files = [f for f in (tmp_path / "w").iterdir() if f.suffix == ".gz"]
    kinds = [h["WARC-Type"] for f in files for h, _ in warc.records(warc.inflate(f.read_bytes()))]
    assert sorted(kinds) == sorted(w[3] for w in want)
    assert warc.round_trip(df.limit(0), str(tmp_path / "none")).count() == 0
