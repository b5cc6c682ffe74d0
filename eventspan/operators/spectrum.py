"""Spectral flux from sample blocks, and user-made generators on clips."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frame length, and weights of the bands from each frequency up.
FRAME = 512
BANDS = [(0.0, 0.35), (80.0, 1.0), (500.0, 1.5), (2000.0, 1.875)]


def band_weights(sr: int, size: int = FRAME) -> np.ndarray:
    starts, weights = np.array(BANDS).T
    return weights[np.searchsorted(starts, np.fft.rfftfreq(size, 1 / sr), side="right") - 1]


def spectral_flux(blocks: DataFrame, hop_sec: float = 0.005, size: int = FRAME) -> DataFrame:
    """path, frame_idx, t, flux from rows (path, sr, block_id, samples): the weighted rise of the magnitudes from the frame
    before, 0 for a file's first one. Blocks come sorted and only a frame's worth of samples is carried from one to the next,
    so a file's length has no bound. A file shorter than a frame has one frame, filled up with zeros; a null block is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, sr, carry, last, i = None, 0, np.zeros(0), None, 0

        def frames_of(buffer: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
            nonlocal last, i
            hop = max(1, int(sr * hop_sec))
            n = 1 + (len(buffer) - size) // hop if len(buffer) >= size else 0
            if not n:
                return pd.DataFrame(), buffer
            cut = np.lib.stride_tricks.sliding_window_view(buffer, size)[::hop][:n]
            mags = np.abs(np.fft.rfft(cut * np.hanning(size))) * band_weights(sr, size)
            before = np.vstack([mags[:1] if last is None else last[None], mags[:-1]])
            idx = np.arange(i, i + n)
            out = pd.DataFrame({"path": path, "frame_idx": idx, "t": (idx * hop + size / 2) / sr, "flux": np.maximum(mags - before, 0).sum(axis=1)})
            last, i = mags[-1], i + n
            return out, buffer[n * hop :]

        def rest() -> pd.DataFrame:
            return frames_of(np.pad(carry, (0, size - len(carry))))[0] if path is not None and i == 0 else pd.DataFrame()

        for batch in batches:
            for p, rate, samples in zip(batch["path"], batch["sr"], batch["samples"]):
                if p != path:
                    tail = rest()
                    if len(tail):
                        yield tail
                    path, sr, carry, last, i = p, int(rate), np.zeros(0), None, 0
                out, carry = frames_of(np.concatenate([carry, np.asarray([] if samples is None else samples, dtype=float)]))
                if len(out):
                    yield out
        tail = rest()
        if len(tail):
            yield tail

    rows = blocks.where("path IS NOT NULL").select("path", "sr", "block_id", "samples").repartition("path").sortWithinPartitions("path", "block_id")
    return rows.mapInPandas(run, "path string, frame_idx long, t double, flux double")


def run_generator(clips: DataFrame, generate: Callable[[np.ndarray, int], np.ndarray], samples: str = "samples", sr: str = "sr", out: str = "rendered") -> DataFrame:
    """Adds what a generator makes of each clip's samples. One row is one clip, a few seconds long; a null one stays null."""
    udf = F.pandas_udf(lambda x, r: pd.Series([None if a is None else np.asarray(generate(np.asarray(a, dtype=float), int(b)), dtype=float) for a, b in zip(x, r)]), "array<double>")
    return clips.withColumn(out, udf(samples, sr))
