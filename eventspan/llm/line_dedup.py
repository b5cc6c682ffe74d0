"""Removal of repeated runs of lines by winnowing."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_path, fresh, join_shared, n_words, new_path, row_key, scratch, small

#: A run of at least this many words that stood earlier is removed; fingerprints are of half as many.
RUN_WORDS = 50
GRAM_WORDS = 25
#: windows: those that chose the gram, as digest, first and last line.
SCHEMA = "key binary, k1 long, k2 binary, windows array<struct<name: binary, a: int, b: int>>"
#: Digests of runs of lines are polynomials over the digests of lines, modulo a prime: those of all runs follow from one pass.
PRIME = (1 << 127) - 1
POINT = int.from_bytes(hashlib.sha256(b"runs of lines").digest()[:15], "little")


def ends(total: np.ndarray, least: int) -> np.ndarray:
    """For each line the first line at whose end `least` words are reached, or the number of lines; total: words before each."""
    return np.searchsorted(total[1:], total[:-1] + least)


def fingerprints(text: str, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> list[tuple]:
    """Winnowed fingerprints of a text: (digest, windows); see SCHEMA.

    A gram is the shortest run of whole lines from some line on with at least gram_words words. A window is the shortest run
    of lines from some line on, or up to some line, with at least run_words words; of the grams inside it the one with the
    smallest digest is selected. Equal runs of run_words words or more hold equal windows, which cover them and select equal
    grams, also where one line is the run. Lines are compared without outer white space. Takes time in proportion to the text:
    windows in order neither start nor end before the one before them, so their minima come from a queue of rising grams.
    """
    lines = [x.strip() for x in text.split("\n")]
    words = np.array([len(x.encode("utf-8", "replace").split()) for x in lines], dtype=np.int64)
    if words.sum() < run_words:
        return []
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(lines)
    gram_end, window_end = ends(total, gram_words).tolist(), ends(total, run_words).tolist()
    window_start = (np.searchsorted(total, total[1:] - run_words, side="right") - 1).tolist()
    before, power = [0], [1]
    for x in lines:
        before.append((before[-1] * POINT + int.from_bytes(hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=15).digest(), "little") + 1) % PRIME)
        power.append(power[-1] * POINT % PRIME)
    digest = lambda a, b: ((before[b + 1] - before[a] * power[b + 1 - a]) % PRIME).to_bytes(16, "big")
    windows = {(i, b) for i, b in enumerate(window_end) if b < n} | {(i, b) for b, i in enumerate(window_start) if i >= 0}
    chosen: dict[bytes, list[tuple]] = {}
    rising: deque[tuple[bytes, int]] = deque()
    at, counted = 0, words.tolist()
    for a, b in sorted(windows):
        while at < n and gram_end[at] <= b:
            if counted[at]:
                gram = digest(at, gram_end[at])
                while rising and rising[-1][0] >= gram:
                    rising.pop()
                rising.append((gram, at))
            at += 1
        while rising[0][1] < a:
            rising.popleft()
        chosen.setdefault(rising[0][0], []).append((digest(a, b), a, b))
    return list(chosen.items())


def merged(runs: Column) -> Column:
    """Runs of lines, sorted, with those that meet or overlap as one."""
    start = F.slice(runs, 1, 1)
    last = lambda done: F.element_at(done, -1)
    longer = lambda done, r: F.struct(last(done)["a"].alias("a"), F.greatest(last(done)["b"], r["b"]).alias("b"))
    add = lambda done, r: F.when(r["a"] <= last(done)["b"] + 1, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer(done, r)))).otherwise(F.concat(done, F.array(r)))
    return F.aggregate(runs, start, add)


def repeated_runs(docs: DataFrame, run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """docs: k1, k2, text. Returns k1, k2, runs: the runs of lines (first, last) of each text that stood earlier, in a text with
    a smaller (k1, k2) or further up in the same one.

    Windows whose gram is repeated are held against the first equal window, found by a minimum that is combined before the
    shuffle, so a passage that a third of the texts share costs a row for each of its windows and no pairs. An earlier part of
    under run_words words is no window and hides nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches):
            rows = [(key, k1, k2, [{"name": x, "a": a, "b": b} for x, a, b in windows]) for k1, k2, text in zip(batch["k1"], batch["k2"], batch["text"]) for key, windows in fingerprints(text, run_words, gram_words)]
            yield pd.DataFrame(rows, columns=["key", "k1", "k2", "windows"])

    spark = docs.sparkSession
    path = new_path(spark, "line-marks")
    marks = cut(docs.select("k1", "k2", "text").mapInPandas(run, SCHEMA), "line-marks", path)
    # A gram that stands twice in one text is one mark with several windows.
    again = marks.groupBy("key").agg(F.sum(F.size("windows")).alias("uses"), F.count(F.lit(1)).alias("n")).where("uses > 1").select("key", F.lit(True).alias("again"), "n")
    shared = join_shared(marks, again, "key").where("again").drop("again")
    named = cut(shared.select("k1", "k2", F.inline("windows")), "line-shared")
    drop_path(spark, path)
    first = named.groupBy("name").agg(F.min(F.struct("k1", "k2", "a")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = join_shared(named, first, "name").where(F.col("f").isNotNull() & (F.struct("k1", "k2", "a") > F.struct("f.k1", "f.k2", "f.a")))
    return later.groupBy("k1", "k2").agg(merged(F.array_sort(F.collect_set(F.struct("a", "b")))).alias("runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS, gram_words: int = GRAM_WORDS) -> DataFrame:
    """All columns of docs with the text's later repeated runs removed, and __lines, __removed_lines, __removed_words.

    The first occurrence of a run stays: order is by id, then by text digest, null ids last. Whole lines go, the other lines
    and their order stay. Rows with equal id and text count as one text and are treated alike. Null texts stay null, texts
    of under run_words words, empty ones too, are never changed; texts of any length are read whole. An empty table gives an
    empty one. Extra columns pass through; one with the name of a column added here is replaced.
    """
    docs = docs.drop("__lines", "__removed_lines", "__removed_words")
    n1, n2, named = fresh(docs.columns, "k1", "k2", "runs")
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.withColumn(n1, k1).withColumn(n2, k2)
    texts = docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with scratch(docs.sparkSession) as made:
        runs = made.keep(repeated_runs(texts, run_words, gram_words), "line-runs")
    marked = runs.select(F.col("k1").alias(n1), F.col("k2").alias(n2), F.col("runs").alias(named)).hint("merge")  # no size bound: never broadcast
    found = keyed.join(marked, [n1, n2], "left")
    lines = F.split(F.col(text_col), "\n")
    inside = lambda i: F.exists(named, lambda r: (r["a"] <= i) & (i <= r["b"]))
    gone = F.filter(lines, lambda _, i: inside(i))
    left = F.filter(lines, lambda _, i: ~inside(i))
    changed = F.col(named).isNotNull()
    return found.select(
        *[F.when(changed, F.array_join(left, "\n")).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size(lines), F.lit(0)).alias("__lines"),
        F.when(changed, F.size(gone)).otherwise(0).alias("__removed_lines"),
        F.when(changed, n_words(F.array_join(gone, "\n"))).otherwise(0).cast("long").alias("__removed_words"),
    )


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_lines, removed_lines, removed_words, text."""
    return line_dedup(docs.select("doc_id", "text")).select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed_lines").alias("removed_lines"), F.col("__removed_words").alias("removed_words"), "text")
