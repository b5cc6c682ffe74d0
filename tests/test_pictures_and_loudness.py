import random

import numpy as np
from pyspark.sql import functions as F

from eventspan.operators import folds, loud, picture, promote, render, spectrum

K = ["clip"]


def series(spark, values, name="value"):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], f"clip string, i long, {name} double")


def test_segments_bridge_and_drop(spark):
    got = loud.segments_above(series(spark, [0, 5, 5, 0, 6, 0, 0, 0, 5, 0]), K, "i", "value", 5, 1, 3).collect()
    assert [(r["first_idx"], r["last_idx"], r["peak_idx"]) for r in got] == [(1, 4, 4)]


def test_loud_islands_against_a_walk(spark):
    rng = random.Random(4)
    values = [rng.choice([0, 2, 3, 4, 5, 6]) for _ in range(200)]
    df = series(spark, values).withColumn("floor", F.lit(4.0))
    got = sorted((r["lo_idx"], r["peak_idx"], r["hi_idx"]) for r in loud.loud_islands(df, K, "i", "value", "value", "floor", 3, 1, 0.5, 0.75, 2).collect())
    on = [i for i, v in enumerate(values) if v >= 4]
    cores = []
    for i in on:
        if cores and i - cores[-1][-1] <= 2:
            cores[-1].append(i)
        else:
            cores.append([i])
    spans = []
    for c in cores:
        a, b = c[0], c[-1]
        if b - a + 1 < 3 or len(c) / (b - a + 1) < 0.5:
            continue
        lo, hi = a, b
        while lo > max(0, a - 2) and values[lo - 1] >= 3:
            lo -= 1
        while hi < min(199, b + 2) and values[hi + 1] >= 3:
            hi += 1
        if spans and lo <= spans[-1][1]:
            p = spans.pop()
            spans.append((p[0], max(p[1], hi), p[0], max(p[1], hi)))
        else:
            spans.append((lo, hi, a, b))
    assert got == [(lo, max(range(a, b + 1), key=lambda i: (values[i], -i)), hi) for lo, hi, a, b in spans]


def test_scenes_cut_at_a_lasting_step_only(spark):
    steps = loud.scenes(series(spark, [1.0] * 40 + [4.0] * 40), K, "i", "value", 4, 3, 12, 2.5, 2.0).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"]) for r in steps] == [(0, 40), (40, 80)]
    burst = loud.scenes(series(spark, [1.0] * 40 + [4.0] * 4 + [1.0] * 40), K, "i", "value", 4, 3, 12, 2.5, 2.0).collect()
    assert [(r["start_idx"], r["end_idx"]) for r in burst] == [(0, 84)]


def test_crop_stays_near_its_mark(spark):
    marks = spark.createDataFrame([("a", 1, 5)], "clip string, id long, at long")
    got = loud.crop_to_loud(marks, series(spark, [9, 9, 9, 9, 9, 5, 9, 0, 9, 9]), K, "id", "at", "i", "value", F.lit(4.0), 3).first()
    assert (got["lo_idx"], got["peak_idx"], got["hi_idx"]) == (2, 2, 6)


def test_flashes_reject_cuts_and_fires_pass_dips(spark):
    warm = [0, 0, 9, 9, 0, 0, 9, 0, 0, 0, 9, 9, 9, 9]
    df = series(spark, warm, "warm").withColumn("cut", F.col("i").isin(5, 9))
    got = picture.flashes(df, K, "i", "warm", 5.0, 5.0, F.col("cut"), 1, 2).select("i").collect()
    assert sorted(r["i"] for r in got) == [2]
    spans = picture.fire_spans(spark.createDataFrame([("a", 2), ("a", 4)], "clip string, at long"), df, K, "at", "i", "warm", 5.0, 20, 2)
    assert sorted((r["at"], r["end_idx"]) for r in spans.collect()) == [(2, 6), (4, 6)]


def test_one_to_one_against_lists(spark):
    rng = random.Random(8)
    for later in (False, True):
        refs, dets = ([rng.randrange(60) for _ in range(25)] for _ in range(2))
        df = lambda x, c: spark.createDataFrame([("a", t) for t in x], f"clip string, {c} long")
        got = sorted((r["r"], -1 if r["d"] is None else r["d"]) for r in folds.one_to_one(df(refs, "r"), df(dets, "d"), "clip", "r", "d", 3, later).collect())
        free, want = sorted(dets), []
        for r in sorted(refs):
            near = [t for t in free if abs(t - r) <= 3]
            best = min(near, key=lambda t: (abs(t - r), -t if later else t)) if near else -1
            if near:
                free.remove(best)
            want.append((r, best))
        assert got == sorted(want)


def test_merge_windows_keeps_the_stronger_centre(spark):
    rows = [("a", 0, 10, 5, 1), ("a", 12, 20, 8, 3), ("a", 21, 30, 25, 9)]
    df = spark.createDataFrame(rows, "clip string, s long, e long, c long, v long")
    assert [tuple(r)[1:] for r in folds.merge_windows(df, K, "s", "e", "c", "v", 3, 10).orderBy("s").collect()] == [(0, 20, 8, 3), (21, 30, 25, 9)]


def test_promotion_needs_backing_and_distance(spark):
    peaks = spark.createDataFrame([("a", 10, "impact"), ("a", 12, "impact"), ("a", 14, None), ("a", 30, "flux"), ("a", 33, "flux")], "clip string, i long, rule string")
    known = spark.createDataFrame([("a", 31)], "clip string, m_at long")
    assert sorted(r["i"] for r in promote.promote(peaks, known, K, "i", 2).collect()) == [10]


def test_duck_and_mix(spark):
    df = series(spark, [1.0] * 8)
    gains = [r["gain"] for r in render.duck(df, spark.createDataFrame([("a", 3, 5)], "clip string, s long, e long"), K, "i", "s", "e", 0.28, 2).orderBy("i").collect()]
    assert np.allclose(gains, [1, 1, 0.28, 0.28, 0.28, 0.28, 1, 1])
    placed = spark.createDataFrame([("a", 6, 4, 0.5), ("a", 0, 2, -3.0)], "clip string, s long, n long, g double")
    got = [r["value"] for r in render.mix(df, placed, K, "i", "value", "s", "n", F.col("g") * F.lit(1.0)).orderBy("i").collect()]
    assert got == [-1.0, -1.0, 1, 1, 1, 1, 1.0, 1.0]


def test_flux_is_the_same_in_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=5000) * np.r_[np.full(2500, 0.05), np.full(2500, 1.0)]
    rows = [("long", 8000, i, x[i * 700 : i * 700 + 700].tolist()) for i in range(8)] + [("short", 8000, 0, [0.5] * 30)]
    got = spectrum.spectral_flux(spark.createDataFrame(rows, "path string, sr int, block_id long, samples array<double>")).orderBy("path", "frame_idx").collect()
    mags = [np.abs(np.fft.rfft(x[a : a + 512] * np.hanning(512))) * spectrum.band_weights(8000) for a in range(0, 5000 - 511, 40)]
    want = [0.0] + [float(np.maximum(b - a, 0).sum()) for a, b in zip(mags, mags[1:])]
    flux = [r["flux"] for r in got if r["path"] == "long"]
    assert np.allclose(flux, want) and abs(got[int(np.argmax(flux))]["t"] - 2500 / 8000) < 0.05
    assert [r["flux"] for r in got if r["path"] == "short"] == [0.0]


def test_generator(spark):
    clips = spark.createDataFrame([(1, 4, [1.0, 2.0]), (2, 4, None)], "id long, sr int, samples array<double>")
    assert [r["rendered"] for r in spectrum.run_generator(clips, lambda x, sr: x[::-1] / sr).orderBy("id").collect()] == [[0.5, 0.25], None]
