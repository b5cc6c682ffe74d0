"""Toxicity by nearest labelled examples under exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, map_texts, scratched

#: Bounds of the fit; scoring has none.
MAX_FIT_ROWS = 20_000
MAX_TERMS = 8192
MAX_EXAMPLES = 2048
#: Terms that would say something about the label by chance, as expected: whatever the number of rows and of terms.
BY_CHANCE = 1.0
#: The share of its TF-IDF weight that a term keeps which says nothing about the label.
QUIET = 0.005
BLOCK = 64
NEIGHBOURS = 15
STEMS = (4, 5)
words_of = re.compile(r"[^\W_]+").findall


def term_counts(text: str) -> Counter:
    """Lower-case words, and the first letters of longer ones, with their counts."""
    words = Counter(words_of(text.lower()))
    out: Counter = Counter()
    for w, n in words.items():
        out[w] += n
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


@dataclass
class Index:
    """A block-max inverted index over unit TF-IDF vectors of examples of both labels. Postings lie by term and then by example,
    so those of a term in a block are a slice; peak holds the largest weight of each term in each block. stands: how many
    labelled rows an example of each label stands for, relative to the other."""

    terms: dict[str, int]
    weight: np.ndarray
    labels: np.ndarray
    ids: list
    names: dict
    example: np.ndarray
    posting: np.ndarray
    cut: np.ndarray
    peak: np.ndarray
    prior: float
    bare: float
    stands: tuple[float, float] = (1.0, 1.0)
    slope: float = 0.0
    offset: float = 0.0

    def __post_init__(self):
        self.heads = {t[: STEMS[0]] for t in self.terms if t.endswith("*")}

    @staticmethod
    def build(terms: dict[str, int], weight: np.ndarray, examples: list[tuple], prior: float, bare: float, stands: tuple[float, float] = (1.0, 1.0)) -> Index:
        """examples: (id, label, term numbers, counts, name). They are ordered by their heaviest term, so blocks are coherent."""
        vectors = [(i, y, np.array(t, dtype=np.int64), unit(np.array(t, dtype=np.int64), np.array(c), weight), name) for i, y, t, c, name in examples]
        vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]), v[1], str(v[0]), v[2].tolist()))
        blocks = max(1, -(-len(vectors) // BLOCK))
        none = np.zeros(0)
        term = np.concatenate([none.astype(np.int64), *(v[2] for v in vectors)])
        example = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
        posting = np.concatenate([none, *(v[3] for v in vectors)])
        order = np.lexsort((example, term))
        example, posting = example[order], posting[order]
        at = term[order] * blocks + example // BLOCK
        peak = np.zeros(len(terms) * blocks)
        np.maximum.at(peak, at, posting)
        cut = np.searchsorted(at, np.arange(len(terms) * blocks + 1))
        names = {v[4]: n for n, v in enumerate(vectors)}
        return Index(terms, weight, np.array([v[1] for v in vectors], dtype=np.int64), [v[0] for v in vectors], names, example, posting, cut, peak.reshape(len(terms), blocks), prior, bare, stands)

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        blocks = self.peak.shape[1]
        lo, hi = self.cut[term * blocks], self.cut[(term + 1) * blocks]
        return self.example[lo:hi], self.posting[lo:hi]

    def open(self, t: np.ndarray, w: np.ndarray, blocks: np.ndarray, scores: np.ndarray) -> None:
        """Adds what the postings of the terms in some blocks give to the scores."""
        at = (t[:, None] * self.peak.shape[1] + blocks).ravel()
        lo = self.cut[at]
        n = self.cut[at + 1] - lo
        if total := int(n.sum()):
            here = np.arange(total) + np.repeat(lo - (np.cumsum(n) - n), n)
            scores += np.bincount(self.example[here], weights=self.posting[here] * np.repeat(np.repeat(w, len(blocks)), n), minlength=len(scores))

    def search(self, t: np.ndarray, w: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The exact k best (cosine to 9 digits, example), best first, smaller example numbers first among equals. Blocks are
        opened by falling bound, some more each time, until the bound can't beat the k-th best."""
        bound = w @ self.peak[t] + 1e-9
        order = np.argsort(-bound, kind="stable")
        scores = np.zeros(len(self.labels))
        done, step, kth = 0, 2, 1e-8
        while done < len(order) and bound[order[done]] >= kth:
            more = order[done : done + step]
            self.open(t, w, more[bound[more] >= kth], scores)
            if without >= 0:
                scores[without] = 0
            done, step = done + step, step * 2
            if len(scores) > k:
                kth = max(1e-8, np.partition(scores, -k)[-k] - 1e-8)
        found = np.nonzero(scores >= kth)[0]
        s = np.round(scores[found], 9)
        best = np.lexsort((found, -s))[:k]
        return [(float(s[b]), int(found[b])) for b in best if s[b] > 0]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Labels weighted by one over the distance and by the rows they stand for, drawn to the prior by one neighbour's weight
        at distance one."""
        y = self.labels[[e for _, e in near]]
        weights = np.array([1 / (1.05 - s) for s, _ in near]) * np.array(self.stands)[y]
        return float(((weights * y).sum() + self.prior) / (weights.sum() + 1))

    def nearest(self, counts: dict[int, int], k: int = NEIGHBOURS, without: int = -1) -> list[tuple[float, int]]:
        if not counts or not len(self.labels):
            return []
        t = np.fromiter(counts, dtype=np.int64, count=len(counts))
        c = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
        order = np.argsort(t)
        return self.search(t[order], unit(t[order], c[order], self.weight), k, without)

    def score(self, counts: dict[int, int], k: int = NEIGHBOURS) -> tuple[float, list[tuple[float, int]]]:
        near = self.nearest(counts, k)
        if not near:
            return self.bare, []
        x = self.vote(near)
        return (1 / (1 + np.exp(-(self.slope * x + self.offset))) if self.slope else x), near

    def match(self, text: str) -> dict[int, int]:
        """Counts of the index's terms in the whole text."""
        terms, heads, out = self.terms, self.heads, {}
        for w, n in Counter(words_of(text.lower())).items():
            if (i := terms.get(w)) is not None:
                out[i] = n + out.get(i, 0)
            if w[: STEMS[0]] in heads:
                for k in STEMS:
                    if len(w) > k and (i := terms.get(w[:k] + "*")) is not None:
                        out[i] = n + out.get(i, 0)
        return out


def unit(t: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * weight[t]
    return w / np.sqrt((w * w).sum())


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit with Platt's smoothed targets, by Newton steps. A falling fit is refused."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    m = np.stack([x, np.ones(len(x))], axis=1)
    c = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ c, -30, 30)))
        grad = m.T @ (weight * (p - goal)) + 1e-3 * c
        step = np.linalg.solve((m * (weight * p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2), grad)
        c -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(c[0]), float(c[1])) if c[0] > 0 else (0.0, 0.0)


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """doc_id, text, toxic of about max_rows documents, chosen by id hash, for whose doc_id `learn` holds.

    The choice is made among the slim labels, so what is broadcast to find the texts has a bound and no text is shuffled.
    An id that labels repeat counts once for each label it has.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(learn).distinct()
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(max_rows / n * (1 << 20)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")


def testable(sizes: list[tuple[int, int]], share: float) -> tuple[int, float]:
    """sizes: (df, terms of it). The least df with which a term can show more than chance, and the surprise that takes: the
    logarithm of the number of terms with that df or more (Tarone's correction), so few rows can give terms too."""
    most = -np.log(min(share, 1 - share))
    left = sum(n for _, n in sizes)
    for df, n in sorted(sizes):
        if df * most >= np.log(left / BY_CHANCE):
            return df, float(np.log(left / BY_CHANCE))
        left -= n
    return 2**62, float("inf")


@scratched
def fit(labelled: DataFrame, max_terms: int = MAX_TERMS, max_examples: int = MAX_EXAMPLES) -> Index:
    """labelled: doc_id, text, toxic (0 or 1), of a bounded number of rows (see training_rows).

    Equal texts of a label count once; among rows of equal text and label the smallest id is the evidence. Terms are the words
    and word stems that go with a label more than by chance, then the most frequent words, at most max_terms and all of two rows or more. A term's weight is its inverse
    document frequency times what it says about the label (the divergence of the label's share among its rows from the share among all), or QUIET if that may be chance. Examples are at most max_examples rows by
    text hash, no more than half of them of one label unless the other has fewer. What the driver gets is bounded by these numbers. An empty table, or one of a single label, gives an index without examples: every score is the share of toxic rows.
    """
    rows = labelled.select(F.xxhash64("text").alias("h"), "doc_id", "text", "toxic")
    rows = cut(rows.groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text")), "toxicity-fit")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            df: Counter = Counter()
            bad: Counter = Counter()
            for text, y in zip(batch["text"], batch["toxic"]):
                t = list(term_counts(text))
                df.update(t)
                if y:
                    bad.update(t)
            yield pd.DataFrame({"term": list(df), "df": list(df.values()), "bad": [bad[t] for t in df]})

    total = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n, n1 = sum(total.values()), total.get(1, 0)
    prior = (n1 + 0.5) / (n + 2)  # nothing learned speaks for clean
    if not n1 or n1 == n:
        return Index.build({}, np.zeros(0), [], prior, prior)
    stats = rows.select("text", "toxic").mapInPandas(count, "term string, df long, bad long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("bad").alias("bad"))
    stats = cut(stats.where(F.col("df") >= 2), "toxicity-terms")
    share = n1 / n
    least, level = testable([(r.df, r.n) for r in stats.groupBy("df").agg(F.count(F.lit(1)).alias("n")).collect()], share)
    df, bad = F.col("df").cast("double"), F.col("bad").cast("double")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (df * p))).otherwise(0.0)
    surprise = part(bad, share) + part(df - bad, 1 - share)
    marked = stats.withColumn("surprise", surprise).withColumn("says", (df >= float(least)) & (F.col("surprise") >= level))
    chosen = marked.where(F.col("says") | ~F.col("term").endswith("*")).orderBy(F.desc("says"), F.desc(F.when(F.col("says"), F.col("surprise"))), F.desc("df"), "term").limit(max_terms).collect()
    terms = {r.term: i for i, r in enumerate(chosen)}
    weight = np.array([np.log((n + 1) / (r.df + 0.5)) * (r.surprise / r.df if r.says else QUIET) for r in chosen])
    matcher = Index.build(terms, weight, [], prior, prior)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(matcher.match(t).items()) for t in batch["text"]]
            yield pd.DataFrame({"h": batch["h"], "doc_id": batch["doc_id"], "toxic": batch["toxic"], "terms": [[t for t, _ in f] for f in found], "counts": [[c for _, c in f] for f in found]})

    few = {y: min(total[y], max(max_examples // 2, max_examples - total[1 - y])) for y in (0, 1)}
    stands = tuple(total[y] / few[y] for y in (0, 1))
    stands = tuple(x / min(stands) for x in stands)
    picked = rows.where("toxic = 0").select("toxic", "h").orderBy("h").limit(few[0]).union(rows.where("toxic = 1").select("toxic", "h").orderBy("h").limit(few[1]))
    seen = cut(rows.join(F.broadcast(picked), ["toxic", "h"], "left_semi").select("h", "doc_id", "toxic", "text").mapInPandas(vectors, "h long, doc_id long, toxic int, terms array<int>, counts array<int>"), "toxicity-vectors")
    examples = [(r.doc_id, r.toxic, r.terms, r.counts, (r.h, r.toxic)) for r in seen.where(F.size("terms") > 0).collect()]
    index = Index.build(terms, weight, examples, prior, prior, stands)

    # Calibrated on each example's vote without itself.
    def votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = zip(batch["h"], batch["toxic"], batch["terms"], batch["counts"])
            near = [(index.nearest(dict(zip(t.tolist(), c.tolist())), without=index.names[(h, y)]), y) for h, y, t, c in rows]
            yield pd.DataFrame([(index.vote(x), y) for x, y in near if x], columns=["vote", "toxic"])

    got = seen.where(F.size("terms") > 0).repartition(seen.sparkSession.sparkContext.defaultParallelism, "h").mapInPandas(votes, "vote double, toxic int").orderBy("vote", "toxic").collect()
    if got:
        # Both ends of the scale count as one seen row each, so one-sided examples still give a rising curve.
        y = np.array([r.toxic for r in got] + [0, 1])
        index.slope, index.offset = calibrate(np.array([r.vote for r in got] + [0.0, 1.0]), y, np.array(stands)[y])
    return index


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, score, predicted, evidence (ids of the nearest examples, best first), similarity.

    The index is a bounded model and travels to the executors once. The whole text is read. Null text counts as empty and, as
    any text without a term of the index, gets the share of toxic rows; its evidence is empty. Equal texts score alike, repeated
    rows each give a row, an empty table none; only the columns named are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    extra = docs.select(*(keep or []))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            found = [index.score(index.match(text)) for text in batch.pop("text")]
            batch["score"] = [float(s) for s, _ in found]
            batch["predicted"] = pd.Series([int(s >= 0.5) for s, _ in found], dtype="int32")
            batch["evidence"], batch["similarity"] = [[index.ids[e] for _, e in x[:5]] for _, x in found], [[s for s, _ in x[:5]] for _, x in found]
            yield batch

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(keep or []), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in extra.schema)
    return map_texts(rows, run, f"doc_id long, {kinds}score double, predicted int, evidence array<long>, similarity array<double>")


def reject(docs: DataFrame, index: Index, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score is below `limit`, all columns untouched. Null text is scored as empty. Equal texts go or stay
    together, repeated rows each count, an empty table gives an empty one, and no name of a column can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # what is made of a batch is larger than it
                batch = whole.slice(at, 500)
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                yield batch.filter(pa.array([index.score(index.match(t or ""))[0] < limit for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, similarity. Learns from rows whose crc32(doc_id) mod 5 is not 0."""
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    index = fit(training_rows(docs, labels, ~held_out))
    return score(docs, index).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence", "similarity")
