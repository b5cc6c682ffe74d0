"""Mono signals in and out of WAV files, at any rate, one row per block of samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, sr int, block_id long, samples array<float>"


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1 to 1, channels averaged, and the rate. Samples may have 8 (unsigned), 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, sr = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128
    elif width == 3:
        # The three bytes become the upper ones of four, so the sign is right; the scale is taken back.
        wide = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
        wide[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        x = wide.view("<i4").ravel() / 256
    elif width in (2, 4):
        x = np.frombuffer(raw, dtype=f"<i{width}")
    else:
        raise ValueError(f"8, 16, 24 or 32 bits a sample expected, got {8 * width}")
    return (x.reshape(-1, channels).mean(axis=1) / 2.0 ** (8 * width - 1)).astype(np.float32), sr


def resample(x: np.ndarray, sr: int, to: int, zeros: int = 32, step: int = 1 << 14) -> np.ndarray:
    """x at another rate, by a Hann-windowed sinc of `zeros` zero crossings on each side that cuts above the lower of both
    rates' halves. ceil(len(x) * to / sr) samples; outside the signal is silence; equal rates change nothing. A `step` of
    output samples is made at a time, so memory does not grow with the length."""
    if sr == to or not len(x):
        return x
    pass_ = min(1.0, to / sr)
    reach = int(np.ceil(zeros / pass_))
    padded = np.concatenate([np.zeros(reach), x.astype(np.float64), np.zeros(reach + 1)])
    near = np.arange(-reach + 1, reach + 1)
    out = np.empty(-(-len(x) * to // sr), dtype=np.float32)
    for at in range(0, len(out), step):
        n = np.arange(at, min(at + step, len(out)))
        whole, part = n * sr // to, (n * sr % to) / to
        gap = near - part[:, None]
        window = 0.5 + 0.5 * np.cos(np.pi * np.clip(gap / reach, -1, 1))
        out[n] = (padded[whole[:, None] + near + reach] * np.sinc(gap * pass_) * window).sum(axis=1) * pass_
    return out


def prepared(data: bytes, sr: int = 44100) -> bytes:
    """A WAV file as a mono one of 16 bits at the rate, clipped to -1 to 1."""
    x, rate = decode(data)
    return encode(resample(x, rate, sr), sr)


def encode(samples: np.ndarray, sr: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def read_wav(spark: SparkSession, folder: str, block: int = 65536, rate: int | None = None) -> DataFrame:
    """Every *.wav under the folder, resampled to `rate` if one is given; a file is read by one task and split into blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                x, sr = decode(data)
                if rate:
                    x, sr = resample(x, sr, rate), rate
                starts = range(0, max(1, len(x)), block)
                yield pd.DataFrame({"path": path, "sr": sr, "block_id": list(range(len(starts))), "samples": [x[a : a + block] for a in starts]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(run, SCHEMA)
