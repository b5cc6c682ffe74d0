import random

import pytest

from eventspan.functions import labels
from eventspan.operators import folds, frames, islands, joins, metrics
from eventspan.plans import catalog
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def series(spark, values):
    return spark.createDataFrame([("c", i, float(v)) for i, v in enumerate(values)], "clip string, frame_idx long, value double")


def test_median_smooth(spark):
    got = frames.median_smooth(series(spark, [0.1, 0.1, 0.9, 0.1, 0.1]), ["clip"], "frame_idx", "value", 3)
    assert got.agg(F.max("smooth")).first()[0] < 0.2


@pytest.mark.parametrize(("values", "want"), [([0, 0.4, 0.2, 0.45, 0], [(1, 3)]), ([0, 0.2, 0.25, 0.2, 0], [])])
def test_hysteresis(spark, values, want):
    got = islands.hysteresis(series(spark, values), ["clip"], "frame_idx", "value", 0.35, 0.15).collect()
    assert [(r.first_idx, r.last_idx) for r in got] == want


def test_hysteresis_against_the_walk(spark):
    r = random.Random(1)
    values = [r.random() for _ in range(300)]
    want, i = set(), 0
    for i, v in enumerate(values):
        if v >= 0.8:
            a = b = i
            while a and values[a - 1] >= 0.4:
                a -= 1
            while b + 1 < len(values) and values[b + 1] >= 0.4:
                b += 1
            want.add((a, b))
    got = islands.hysteresis(series(spark, values), ["clip"], "frame_idx", "value", 0.8, 0.4).collect()
    assert {(x.first_idx, x.last_idx) for x in got} == want


def test_sustained_merge(spark):
    rows = [("c", 6500, 7000, 6600, 1), ("c", 7200, 7700, 7300, 2), ("c", 8800, 9300, 8900, 1)]
    got = islands.sustained_merge(spark.createDataFrame(rows, "clip string, s long, e long, p long, w int"), ["clip"], "s", "e", "p", "w", 350).orderBy("s").collect()
    assert [(x.s, x.e, x.p) for x in got] == [(6500, 7700, 7300), (8800, 9300, 8900)]


def test_one_to_one_and_prf(spark):
    refs = spark.createDataFrame([("c", 10000), ("c", 11500)], "clip string, r long")
    dets = spark.createDataFrame([("c", 10050), ("c", 10120)], "clip string, d long")
    got = folds.one_to_one(refs, dets, "clip", "r", "d", 200).orderBy("r").collect()
    assert [(x.r, x.d) for x in got] == [(10000, 10050), (11500, None)]
    prf = metrics.with_prf(spark.createDataFrame([(1, 1, 1), (0, 0, 0)], "tp int, fp int, fn int")).collect()
    assert (prf[0].precision, prf[0].recall, prf[0].f1) == (0.5, 0.5, 0.5) and prf[1].f1 == 0


def test_coverage(spark):
    marks = spark.createDataFrame([("v", 6000), ("v", 24000), ("v", 48000)], "k string, t long")
    spans = spark.createDataFrame([("v", 5000, 7000)], "k string, s long, e long")
    got = metrics.coverage(marks, spans, "k", "t", "s", "e", 350, 2000).first()
    assert (got.n_marks, got.covered, got.recall) == (3, 1, 0.3333)


def test_folds_against_plain_rules(spark):
    r = random.Random(2)
    rows = [("c", r.randrange(3000), r.randrange(50)) for _ in range(200)]
    rows = list({t: (c, t, s) for c, t, s in rows}.values())
    df = spark.createDataFrame(rows, "clip string, t long, s long")
    kept = []
    for _, t, s in sorted(rows, key=lambda x: (-x[2], x[1])):
        if all(abs(t - k) >= 40 for k in kept):
            kept.append(t)
    assert sorted(x.t for x in folds.greedy_spacing(df, ["clip"], "t", "s", 40).collect()) == sorted(kept)
    left = []
    for x in sorted(rows, key=lambda x: (x[1], -x[2])):
        if left and x[1] - left[-1][1] <= 15:
            if x[2] > left[-1][2]:
                left[-1] = x
            continue
        left.append(x)
    assert sorted(map(tuple, folds.dedupe_by_peak(df, ["clip"], "t", "s", 15).collect())) == sorted(left)


def test_joins_against_all_pairs(spark):
    r = random.Random(4)
    a = [("c", i, t, t + r.randrange(1, 90)) for i, t in enumerate(r.randrange(1000) for _ in range(60))]
    b = [("c", i, t, t + r.randrange(1, 90)) for i, t in enumerate(r.randrange(1000) for _ in range(60))]
    da = spark.createDataFrame(a, "clip string, a long, s long, e long")
    db = spark.createDataFrame(b, "clip string, b long, s2 long, e2 long")
    band = {(x.a, x.b) for x in joins.band_join(da, db, ["clip"], "s", "s2", 25).collect()}
    assert band == {(x[1], y[1]) for x in a for y in b if abs(x[2] - y[2]) <= 25}
    over = [(x.a, x.b) for x in joins.overlap_join(da, db, ["clip"], "s", "e", "s2", "e2", 50).collect()]
    want = {(x[1], y[1]) for x in a for y in b if x[2] < y[3] and y[2] < x[3]}
    assert len(over) == len(set(over)) and set(over) == want


def test_labels(spark):
    rows = [("Gunshot, gunfire", "gunshot"), ("  MACHINE   gun", "gunshot"), ("Smash", "smash"), ("tank", "vehicle"), ("Music", None), ("", None)]
    df = spark.createDataFrame([(x,) for x, _ in rows], "x string").select(labels.label_category(F.col("x")).alias("c"))
    assert [r.c for r in df.collect()] == [c for _, c in rows]
    rules = spark.createDataFrame([(150.0, 0.0, 120.0), (0.0, 80.0, 40.0), (0.0, 0.0, 10.0)], "l double, r double, a double")
    got = rules.select(labels.rule_window(F.col("l"), F.col("r"), F.col("a"), 30, 120, 40).alias("w")).select("w.*").collect()
    assert [tuple(x) for x in got] == [("thunder_both", 255), ("rain", 80), ("none", 0)]


def test_every_query_runs(spark):
    for name, q in catalog.queries().items():
        assert q(spark, SF).columns, name
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_adaptive_floor_splits_a_rhythm(spark):
    from eventspan.operators import adaptive

    rhythm = ([1.0] * 4 + [0.6] * 4) * 6
    lull = [1.0] * 20 + [0.6] * 4 + [1.0] * 20
    for values, mode in ((rhythm, "split"), (lull, "keep")):
        got = adaptive.adaptive_floor(series(spark, values), ["clip"], "frame_idx", "value").first()
        assert got["mode"] == mode, got


def test_wav_round_trip(spark, tmp_path):
    import numpy as np

    from eventspan.sources import wav

    x = np.sin(np.arange(10_000) / 9).astype(np.float32) * 0.5
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000))
    rows = wav.read_wav(spark, str(tmp_path), 4096).orderBy("block_id").collect()
    assert [r.sr for r in rows] == [8000] * 3
    assert np.abs(np.concatenate([r.samples for r in rows]) - x).max() < 1e-3


def test_config():
    from eventspan import config

    base = {"detector": {"name": "a", "params": {"x": 1}}, "generators": ["g", {"name": "h", "params": {"y": 2}}], "synthesis": {"continuous": {}}}
    p = config.pipeline(base, {"detector": {"params": {"z": 3}}, "generators": ["k"]})
    assert p.detector.params == {"x": 1, "z": 3} and [c.name for c in p.generators] == ["k"]
    assert config.pipeline(base, {"detector": {"name": "b"}}).detector == config.Component("b")
    assert config.pipeline(base, {"detector": None}).detector is None
    with pytest.raises(ValueError, match="unknown"):
        config.pipeline(base, {"synthesis": {"nope": 1}})
    with pytest.raises(ValueError, match="there are"):
        config.Registry().make(config.Component("missing"))
