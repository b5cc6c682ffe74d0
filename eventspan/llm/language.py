"""Language identification by a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, map_texts

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, DIMS = 12, 8
STEPS, BATCH, RATE = 500, 128, 0.01
#: Bound of the fit: about so many rows of each language, with so many windows of each.
ROWS_PER_LANGUAGE, WINDOWS_PER_ROW = 1500, 3
UNKNOWN = "und"
has_letter = regex.compile(r"\p{L}").search
MARGIN = max(WIDTHS) - 1
BLOCK = 64


def windows(data: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one filled with zeros; each row ends with zeros for the widest filter."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros((n, WINDOW + MARGIN), dtype=np.uint8)
    out[:, :WINDOW] = np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)
    return out


@dataclass
class ByteNet:
    """Byte embeddings, filters of several widths, maximum over the window, softmax. For use, embedding and filters are folded
    into one table per byte pair."""

    languages: list[str]
    emb: np.ndarray
    filters: np.ndarray  # (widest, DIMS, all filters), zero beyond a filter's own width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        t = [(self.emb @ self.filters[j]).astype(np.float32) for j in range(MARGIN + 1)]
        return [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, MARGIN + 1, 2)]

    def probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Of each window (row of x) for each language."""
        top = np.empty((len(x), len(self.bias)), dtype=np.float32)
        for at in range(0, len(x), BLOCK):
            b = x[at : at + BLOCK].astype(np.int32)
            pair = b[:, :-1] << 8 | b[:, 1:]
            h = tables[0].take(pair[:, :WINDOW], axis=0)
            for j, t in enumerate(tables[1:], 1):
                h += t.take(pair[:, 2 * j : 2 * j + WINDOW], axis=0)
            top[at : at + BLOCK] = h.max(axis=1)
        z = np.maximum(top + self.bias.astype(np.float32), 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 7, steps: int = STEPS) -> ByteNet:
    """x: windows; y: numbers of languages. Adam on the cross entropy; the gradient of the maximum goes to its place only."""
    r = np.random.default_rng(seed)
    wide, nf, c = MARGIN + 1, FILTERS * len(WIDTHS), len(languages)
    own = np.zeros((wide, 1, nf))
    for i, k in enumerate(WIDTHS):
        own[:k, :, i * FILTERS : (i + 1) * FILTERS] = 1
    p = {"emb": r.normal(0, 0.3, (256, DIMS)), "filters": r.normal(0, 0.3, (wide, DIMS, nf)) * own, "bias": np.zeros(nf), "out": r.normal(0, 0.3, (nf, c)), "out_bias": np.zeros(c)}
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        pick = r.integers(0, len(x), BATCH)
        xb, yb = x[pick].astype(np.int64), y[pick]
        e = p["emb"].astype(np.float32)[xb]
        h = sum(e[:, j : j + WINDOW] @ p["filters"][j].astype(np.float32) for j in range(wide))
        place = h.argmax(axis=1)
        top = np.take_along_axis(h, place[:, None, :], axis=1)[:, 0].astype(np.float64) + p["bias"]
        a = np.maximum(top, 0)
        z = a @ p["out"] + p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        dz = z / z.sum(axis=1, keepdims=True)
        dz[np.arange(BATCH), yb] -= 1
        dz /= BATCH
        g = {"out": a.T @ dz, "out_bias": dz.sum(axis=0)}
        da = (dz @ p["out"].T) * (top > 0)
        g["bias"] = da.sum(axis=0)
        g["emb"], g["filters"] = np.zeros_like(p["emb"]), np.zeros_like(p["filters"])
        row = np.arange(BATCH)[:, None]
        for j in range(wide):
            seen = xb[row, place + j]  # (BATCH, nf)
            g["filters"][j] = np.einsum("bf,bfd->df", da, p["emb"][seen]) * own[j]
            np.add.at(g["emb"], seen.ravel(), (da[:, :, None] * p["filters"][j].T[None]).reshape(-1, DIMS))
        for k in p:
            first[k] += 0.1 * (g[k] - first[k])
            second[k] += 0.001 * (g[k] ** 2 - second[k])
            p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return ByteNet(languages, **p)


def fit(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, windows_per_row: int = WINDOWS_PER_ROW) -> ByteNet | None:
    """labelled: text, lang. Trains on about rows_per_language rows of each language, chosen by text hash, and
    windows_per_row windows of each at places that the hash chooses too; the driver gets these windows only. None where there
    is nothing to learn from."""
    known = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for k in sorted(sizes) for x in (F.lit(k), F.lit(min(1.0, rows_per_language / sizes[k])))])[F.col("lang")]
    turns = [F.substring("text", (F.pmod(F.xxhash64("text", F.lit(i)), F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1).cast("int"), F.lit(WINDOW)) for i in range(windows_per_row)]
    chosen = known.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20)).where(F.col("text").rlike(r"\p{L}"))
    got = chosen.select("lang", F.xxhash64("text").alias("h"), F.array(*turns).alias("parts")).distinct().collect()
    got = sorted(((r.lang, r.h, r.parts) for r in got), key=lambda r: (r[1], r[0]))
    languages = sorted({r[0] for r in got})
    if not languages:
        return None
    data = [(part.encode("utf-8", "replace")[:WINDOW], languages.index(lang)) for lang, _, parts in got for part in dict.fromkeys(parts)]
    return train(np.concatenate([windows(b) for b, _ in data]), np.array([y for _, y in data]), languages)


def predict(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row. All windows of the whole text count, by their bytes. A null text, or one without a
    letter, is `und` with score 0; so is every text where nothing was learned."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = net.tables()
        for batch in batches:
            lang, score = [UNKNOWN] * len(batch), [0.0] * len(batch)
            held, size, where = [], 0, []

            def flush():
                p = net.probabilities(np.concatenate(held), tables)
                at = 0
                for i, n, length in where:
                    share = np.full(n, float(WINDOW))
                    share[-1] = length - WINDOW * (n - 1)
                    q = share @ p[at : at + n] / length
                    at += n
                    best = int(q.argmax())
                    lang[i], score[i] = net.languages[best], float(min(1.0, q[best]))

            for i, text in enumerate(batch["text"]):
                if text is None or not has_letter(text):
                    continue
                data = text.encode("utf-8", "replace")
                held.append(windows(data))
                where.append((i, len(held[-1]), len(data)))
                size += len(held[-1])
                if size > 20_000:
                    flush()
                    held, size, where = [], 0, []
            if held:
                flush()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": lang, "score": score})

    return map_texts(rows, run, "doc_id long, lang_pred string, score double")


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Learns from rows whose crc32(doc_id) mod 3 is not 1 and whose lang is not null."""
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    net = fit(docs.where(~held_out).select("lang", "text"))
    return predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
