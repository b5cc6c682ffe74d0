import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventspan import config
from eventspan.sources import pictures


def frame(rgb):
    return bytes(np.ascontiguousarray(rgb, dtype=np.uint8).tobytes())


def test_picture_scan(spark):
    r = np.random.default_rng(1)
    ground = r.integers(0, 120, (24, 32, 3))
    moved = np.roll(ground, (2, -3), axis=(0, 1))
    fire = ground.copy()
    fire[:12] = (240, 120, 30)
    white = np.full((24, 32, 3), 250)
    seq = [ground, moved, fire, white, white]
    rows = [("a", i, 32, 24, frame(x)) for i, x in enumerate(seq)] + [("b", 0, 32, 24, frame(fire))] + [("c", i, 32, 24, frame(ground)) for i in range(3)]
    df = spark.createDataFrame(rows, "clip string, frame_idx long, width int, height int, data binary").repartition(3)
    got = {(x.clip, x.frame_idx): x for x in pictures.scan(df, 2).collect()}
    assert got["a", 2].warm == 0.5 and got["a", 3].hot == 1.0 and got["a", 0].warm == 0 and got["b", 0].delta is None
    assert (got["a", 1].dx, got["a", 1].dy) == (-3.0, 2.0) and got["a", 0].dx is None
    assert got["a", 1].continuity is None and got["c", 2].continuity == pytest.approx(1.0) and 0 < got["a", 2].continuity < 1 and got["a", 4].continuity is None
    assert got["a", 3].delta > 0 and got["a", 4].motion == 0.0
    bins = pictures.timeline(df, 25.0).where("clip = 'a'").orderBy("bin").collect()
    assert len(bins) == 20 and bins[-1].frame_idx == 4 and bins[0].frame_idx == 0
    measured = pictures.scan(df, 2).select("clip", "frame_idx", "brightness")
    cuts = {(x.clip, x.start_idx, x.end_idx) for x in pictures.scenes(measured, "brightness", 60.0).collect()}
    assert ("b", 0, 1) in cuts and ("a", 3, 5) in cuts


def test_settings_from_files_and_running_them(spark, tmp_path):
    at = tmp_path / "p.json"
    at.write_text(json.dumps({"detector": {"name": "loud", "params": {"level": 3}}, "generators": ["half", {"name": "math_like", "params": {}}], "synthesis": {"continuous": {"a": 1}}}))
    p = config.pipeline(at, {"detector": {"params": {"level": 5}}, "generators": ["half"]})
    assert p.detector == config.Component("loud", {"level": 5}) and p.generators == (config.Component("half"),) and p.synthesis == {"continuous": {"a": 1}}
    assert config.pipeline(at, {"detector": "other"}).detector == config.Component("other")
    for wrong in ({"detektor": "x"}, {"generators": [""]}, {"generators": [3]}, {"detector": {"params": {}}}, {"synthesis": 3}):
        with pytest.raises(ValueError):
            config.pipeline(wrong)
    known = config.Registry()
    known.add("loud", lambda level: lambda signal: signal.where(F.col("v") >= level))
    known.add("half", lambda: lambda signal, events: signal.join(events, "i", "left_semi").withColumn("v", F.col("v") / 2))
    with pytest.raises(ValueError):
        known.add("half", dict)
    signal = spark.createDataFrame([(i, float(i)) for i in range(8)], "i long, v double")
    out = config.run(p, known, signal)
    assert set(out) == {"events", "half"} and sorted(r.v for r in out["half"].collect()) == [2.5, 3.0, 3.5]
    given = config.run(config.pipeline(at, {"detector": None, "generators": ["half"]}), known, signal, signal.where("i = 4"))
    assert [r.v for r in given["half"].collect()] == [2.0]
    with pytest.raises(ValueError):
        config.run(config.pipeline({"generators": ["half", "half"]}), known, signal, signal)
    with pytest.raises(ValueError):
        config.run(config.pipeline({"generators": ["half"]}), known, signal)
    assert known.make(config.Component("collections:OrderedDict", {"a": 1})) == {"a": 1}
