import datetime
import random

import pytest
from pyspark.sql import functions as F

from eventspan.streaming import tumbling

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """2,080 events of a month in 260 files, in no order of time."""
    r = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=r.randrange(30 * 86400)), r.randrange(12) or None, r.choice("abc"), r.randrange(10_000) / 100) for i in range(2080)]
    at = str(tmp_path_factory.mktemp("stream") / "events.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(260, "event_id").write.parquet(at)
    return at


def test_files_in_any_order_lose_nothing(spark, folder):
    assert len(spark.read.parquet(folder).inputFiles()) > 200
    got = {(r.category, r.hour): (r.n, r.cents) for r in tumbling.hourly_totals(spark, folder, "*.parquet").collect()}
    rows = spark.read.parquet(folder).groupBy("event_type", F.floor(F.unix_micros("ts") / F.lit(3_600_000_000)).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    assert got == {(r.event_type, r.hour): (r.n, r.cents) for r in rows.collect()} and sum(n for n, _ in got.values()) == 2080


def test_late_rows_stop_the_job(spark, folder):
    with pytest.raises(ValueError, match="later than the watermark"):
        tumbling.hourly_totals(spark, folder, "*.parquet", "1 hour")


def test_sessions_are_written_once(spark, folder):
    got = sorted(((r.clip, r.start_us, r.end_us, r.n, r.cents) for r in tumbling.sessions(spark, folder, "*.parquet").collect()), key=repr)
    events = {}
    for r in spark.read.parquet(folder).select("user_id", F.unix_micros("ts").alias("t"), F.round(F.col("value") * 100).cast("long").alias("c")).collect():
        events.setdefault(r.user_id, []).append((r.t, r.c))
    want, gap = [], 3 * 3_600_000_000
    for clip, es in events.items():
        run = []
        for t, c in [*sorted(es), (2**62, 0)]:
            if run and t - run[-1][0] > gap:
                want.append((clip, run[0][0], run[-1][0] + gap, len(run), sum(x for _, x in run)))
                run = []
            run.append((t, c))
    assert got == sorted(want, key=repr)
