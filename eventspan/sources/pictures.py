"""Measures of picture frames that come as pixels: rows of clip, frame_idx, width, height and RGB bytes. Decoding video is a plug-in's
work: whatever gives such rows can be read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pixels(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3).astype(np.int16)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def blurred(x: np.ndarray, size: int = 5) -> np.ndarray:
    """Mean over a square, edges repeated."""
    pad = np.pad(x, size // 2, mode="edge")
    rows = np.lib.stride_tricks.sliding_window_view(pad, size, axis=0).mean(axis=-1)
    return np.lib.stride_tricks.sliding_window_view(rows, size, axis=1).mean(axis=-1)


# What counts as orange, as bright, and the least share of background that a comparison needs.
ORANGE_RED, ORANGE_OVER_GREEN, ORANGE_OVER_BLUE, BRIGHT, LEAST_BACKGROUND = 160, 15, 20, 230, 0.15


def orange(rgb: np.ndarray) -> np.ndarray:
    r, g, b = rgb[..., 0], rgb[..., 1], rgb[..., 2]
    return (r > ORANGE_RED) & (r > g + ORANGE_OVER_GREEN) & (r > b + ORANGE_OVER_BLUE)


def continuity(now: np.ndarray, then: np.ndarray) -> float | None:
    """Correlation of the blurred luma of two frames where neither is orange; None with too little such background or a flat one."""
    keep = ~(orange(now) | orange(then))
    if keep.mean() < LEAST_BACKGROUND:
        return None
    a, b = blurred(luma(now))[keep], blurred(luma(then))[keep]
    if a.std() < 1e-6 or b.std() < 1e-6:
        return None
    return float(np.corrcoef(a, b)[0, 1])


def shift(now: np.ndarray, then: np.ndarray) -> tuple[float, float]:
    """Whole pixels that `now` has moved against `then`, by phase correlation."""
    a, b = np.fft.rfft2(luma(now)), np.fft.rfft2(luma(then))
    cross = a * np.conj(b)
    peak = np.fft.irfft2(cross / np.maximum(np.abs(cross), 1e-12), s=now.shape[:2])
    y, x = np.unravel_index(int(np.argmax(peak)), peak.shape)
    h, w = peak.shape
    return float(x - w if x > w // 2 else x), float(y - h if y > h // 2 else y)


SCHEMA = "clip string, frame_idx long, warm double, hot double, continuity double, dx double, dy double, brightness double, delta double, motion double"


def scan(frames: DataFrame, lag: int) -> DataFrame:
    """Per frame the share of orange and of bright pixels, the continuity with the frame `lag` before, the shift, the mean luma with
    its change and the share of changed pixels against the frame before. Null where there is no such frame.

    Clips are dealt whole and sorted; a task holds the last `lag` frames only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, held = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.clip != clip:
                    clip, held = r.clip, []
                now = pixels(bytes(r.data), int(r.width), int(r.height))
                grey = luma(now)
                old = held[-lag] if len(held) >= lag else None
                last = held[-1] if held else None
                dx, dy = shift(now, last) if last is not None else (None, None)
                out.append((
                    r.clip, r.frame_idx, float(orange(now).mean()), float((now.min(axis=-1) > BRIGHT).mean()), continuity(now, old) if old is not None else None, dx, dy,
                    float(grey.mean()), float(grey.mean() - luma(last).mean()) if last is not None else None, float((np.abs(grey - luma(last)) > 25).mean()) if last is not None else None,
                ))
                held = [*held[-(max(lag, 1) - 1) :], now] if lag > 1 else [now]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = frames.select(F.col("clip").cast("string").alias("clip"), "frame_idx", "width", "height", "data")
    return rows.repartition("clip").sortWithinPartitions("clip", "frame_idx").mapInPandas(run, SCHEMA)


def timeline(frames: DataFrame, fps: float, rate: int = 100) -> DataFrame:
    """clip, bin, frame_idx: for each of `rate` bins a second the nearest frame, the last one at the end."""
    ends = frames.groupBy("clip").agg(F.max("frame_idx").alias("last"))
    bins = ends.select("clip", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), F.bround((F.col("last") + 1) / fps * rate).cast("long")) - 1)).alias("bin"))
    return bins.select("clip", "bin", F.least(F.col("last"), F.bround(F.col("bin") / rate * fps).cast("long")).alias("frame_idx"))


def scenes(frames: DataFrame, brightness: str, threshold: float) -> DataFrame:
    """clip, start_idx, end_idx: scenes between frames whose measure changes by more than the threshold; without any the whole clip."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    cut = F.abs(F.col(brightness) - F.lag(brightness).over(w)) > threshold
    n = frames.withColumn("scene", F.sum(F.when(cut, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return n.groupBy("clip", "scene").agg(F.min("frame_idx").alias("start_idx"), (F.max("frame_idx") + 1).alias("end_idx")).drop("scene")
