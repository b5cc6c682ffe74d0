import random

import pytest
from pyspark.sql import functions as F

from eventspan.functions import vocabulary
from eventspan.operators import folds, joins, metrics
from eventspan.sources import event_json


def test_distance_to_spans_at_any_reach(spark):
    r = random.Random(1)
    marks = [(k, i, r.randrange(1000)) for i, k in enumerate(r.choice("abc") for _ in range(200))] + [("z", 900, 5)]
    spans = [(k, a := r.randrange(1000), a + r.randrange(30)) for k in (r.choice("ab") for _ in range(20))]
    got = metrics.span_distance(spark.createDataFrame(marks, "k string, i long, t long"), spark.createDataFrame(spans, "k string, s long, e long"), "k", "t", "s", "e")
    want = {i: min((max(s - t, t - e, 0) for c, s, e in spans if c == k), default=None) for k, i, t in marks}
    assert {x.i: x.distance for x in got.collect()} == want


def test_nearest_at_any_distance(spark):
    r = random.Random(2)
    left = [(k, i, r.randrange(500)) for i, k in enumerate(r.choice("abc") for _ in range(200))]
    right = [(r.choice("ab"), r.randrange(500), r.randrange(5)) for _ in range(40)]
    got = joins.nearest_any(spark.createDataFrame(left, "k string, i long, t long"), spark.createDataFrame(right, "k string, x long, v long"), "k", "t", "x", [F.col("v").alias("v")])
    want = {i: min(((abs(x - t), x, v) for c, x, v in right if c == k), default=None) for k, i, t in left}
    assert {g.i: g.nearest and (g.nearest.dist, g.nearest.t, g.nearest.v) for g in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_collars_match_as_one_by_one(spark, seed):
    r = random.Random(seed)
    rows = lambda n: [(r.choice("ab"), r.randrange(300)) for _ in range(n)]
    refs, dets = (spark.createDataFrame(rows(60), f"k string, {c} long") for c in ("r", "d"))
    many = folds.one_to_one_collars(refs, dets, "k", "r", "d", [2, 7, 40])
    for collar in (2, 7, 40):
        one = folds.one_to_one(refs, dets, "k", "r", "d", collar).where("r IS NOT NULL")
        show = lambda df: sorted(map(tuple, df.select("k", "r", "d").collect()), key=repr)
        assert show(many.where(F.col("collar") == collar)) == show(one)


def test_replies(spark):
    said = {
        '{"categories": ["gunshot", "GUNSHOT", "Engine Start"]} [1, "vehicle"]': ["gunshot", "engine_start", "vehicle"], '{"category": "car-crash"}': ["car_crash"], "Smash, Vehicle ,other": ["smash", "vehicle"],
        "{broken [} smash": [], "": [], '{"categories": {"a": 1}}': [], '["rain"]': [], '{"x": [1]} {"categories": "smash"}': ["smash"],
    }
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "x string")
    got = {r.x: r.y for r in df.select("x", vocabulary.reply_names(F.col("x")).alias("y")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == said and got[None] is None


def test_labels_by_source(spark):
    rows = [("Gunshot, gunfire", "audio", "gunshot"), ("shooting gun", "audio", None), ("shooting gun", "video", "gunshot"), ("Driving  CAR", "kinetics", "vehicle"), ("cannon", "context_token", "explosion"), ("Fireworks", "context_token", None), ("cannon", "anything", "explosion"), ("", "audio", None), (None, "audio", None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "label string, source string")
    got = {(r.label, r.source): r.category for r in vocabulary.match_labels(df, "label", "source").collect()}
    assert {(a, b): c for a, b, c in rows if a is not None} == {k: v for k, v in got.items() if k[0] is not None}


def test_event_documents(spark, tmp_path):
    docs = {"a": '[{"category": "smash", "peak_sec": 2.5}, {"event_id": "x", "start_sec": 1, "end_sec": 0.5, "sources": ["audio"]}]', "b": '{"events": []}', "c": ' {"category": "vehicle", "peak_sec": 3, "start_sec": 1} ', "d": '{"n": 1, "events": [{"label": "q"}]}'}
    for k, v in docs.items():
        (tmp_path / f"{k}.json").write_text(v)
    got = {(r.path[-6], r.event_id): r for r in event_json.read_events(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", "event_001"), ("a", "x"), ("c", "event_001"), ("d", "event_001")}
    a, x, c = got["a", "event_001"], got["a", "x"], got["c", "event_001"]
    assert (a.start_sec, a.peak_sec, a.end_sec, a.duration_sec) == (0.0, 2.5, 2.5, 2.5) and (x.peak_sec, x.duration_sec, x.sources) == (1.0, 0.0, ["audio"])
    assert (c.category, c.end_sec, c.included_in_gate, c.label) == ("vehicle", 3.0, False, "")
    (tmp_path / "e.json").write_text('{"version": 2}')
    with pytest.raises(Exception, match="no events in this JSON"):
        event_json.read_events(spark, str(tmp_path)).collect()
