"""SimHash fingerprints and their links by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import jaccard
from .common import cut, drop_path, fresh, join_shared, map_texts, new_path, row_key, scratch
from .components import components
from .shingles import BITS, fingerprint

MOST = 4
SEGMENTS = MOST + 1
#: First bit of each segment; 13, 13, 13, 13 and 12 bits.
STARTS = [round(i * BITS / SEGMENTS + 0.4) for i in range(SEGMENTS)] + [BITS]
#: Buckets of up to so many rows are compared row by row; of up to so many by balls; larger ones are split by the third segment.
PAIRWISE, BALLS = 12, 256


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """doc_id, h (tells rows apart that have one id), fp (the fingerprint's bits as a signed long) of every row. Null text counts as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t, words) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "h": batch["h"], "fp": fp.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col)[1].alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_texts(rows, run, "doc_id long, h binary, fp long")


def segments(fp: np.ndarray) -> np.ndarray:
    """The segments of each fingerprint, a column each."""
    return np.stack([(fp >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(STARTS, STARTS[1:])], axis=1)


def keys_of(fp: np.ndarray) -> np.ndarray:
    """70 or so keys per fingerprint: for each segment as a chain's first, that segment and the next one, the next one as it
    is (first column of each) and with each of its bits changed."""
    s, out = segments(fp), []
    for i in range(SEGMENTS):
        j = (i + 1) % SEGMENTS
        width = STARTS[j + 1] - STARTS[j]
        head = np.uint64(i << 32) | s[:, i] << np.uint64(16)
        out += [head | s[:, j]] + [head | (s[:, j] ^ np.uint64(1 << b)) for b in range(width)]
    return np.stack(out, axis=1)


def own_key(fp: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a row's key is its fingerprint's as it is, without a changed bit."""
    s, i = segments(fp), (key >> np.uint64(32)).astype(np.int64)
    at = np.arange(len(fp))
    return (s[at, i] << np.uint64(16) | s[at, (i + 1) % SEGMENTS]) == (key & np.uint64(0xFFFFFFFF))


def chain_holds(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """x: differing bits of pairs; first: the chain's first segment. True where the first l consecutive segments, around the
    ring, differ in at most l * MOST / SEGMENTS bits, for every l. The last l is the full Hamming check."""
    d = np.bitwise_count(segments(x)).astype(np.int64)
    total, ok, at = np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool), np.arange(len(x))
    for length in range(1, SEGMENTS + 1):
        total = total + d[at, (first + length - 1) % SEGMENTS]
        ok &= total <= length * MOST // SEGMENTS
    return ok


class Forest:
    """Says of each link whether it joins two trees; the others need not be passed on."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x], x = top, y
        return top

    def joins(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bucket_links(fp: np.ndarray, first: int, forest: Forest, most: int = MOST) -> list[tuple[int, int]]:
    """Links that connect, within one large bucket, whatever is connected by chains from the segment `first`, without looking at
    all pairs: balls around hubs first; two balls are compared only if their hubs are near enough and nothing joins them yet."""
    out, hubs, balls, reach, rest = [], [], [], [], fp
    while len(rest):
        x = rest ^ rest[0]
        near = chain_holds(x, np.full(len(x), first))
        ball = rest[near]
        hub = int(rest[0])
        out += [(hub, y) for y in ball[1:].tolist() if forest.joins(hub, y)]
        hubs.append(rest[0])
        balls.append(ball)
        reach.append(int(np.bitwise_count(x[near]).max()))
        rest = rest[~near]
    hub, reach_ = np.array(hubs, dtype=np.uint64), np.array(reach)
    for i in range(len(hubs)):
        near = np.nonzero(np.bitwise_count(hub[i + 1 :] ^ hub[i]) <= most + reach_[i + 1 :] + reach_[i])[0] + i + 1
        for j in near.tolist():
            if forest.root(int(hub[i])) == forest.root(int(hub[j])):
                continue
            for x in balls[i]:
                hit = np.nonzero(chain_holds(balls[j] ^ x, np.full(len(balls[j]), first)))[0]
                if len(hit):
                    forest.joins(int(x), y := int(balls[j][hit[0]]))
                    out.append((int(x), y))
                    break
    return out


def flips(width: int, most: int) -> np.ndarray:
    """Zero, and all numbers of that many bits of which 1 to `most` are set."""
    out = {0}
    for _ in range(most):
        out |= {x | 1 << b for x in out for b in range(width)}
    return np.array(sorted(out), dtype=np.uint64)


def split_links(fp: np.ndarray, first: int, forest: Forest) -> list[tuple[int, int]]:
    """As bucket_links, for a bucket of any size: a chain's third step allows two differing bits, so rows meet by their third
    segment as it is and with up to two bits changed."""
    third = (first + 2) % SEGMENTS
    s = segments(fp)[:, third]
    masks = flips(STARTS[third + 1] - STARTS[third], 3 * MOST // SEGMENTS)
    out = []
    for at in range(0, len(masks), 8):  # a few masks at a time bound the memory
        part = masks[at : at + 8]
        key = np.concatenate([s, *(s ^ m for m in part)])
        who = np.tile(np.arange(len(fp)), len(part) + 1)
        own = np.arange(len(key)) < len(fp)
        order = np.lexsort((who, key))
        key, who, own = key[order], who[order], own[order]
        edge = np.nonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))[0]
        for a, b in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
            if own[a:b].any():
                out += bucket_links(fp[np.unique(who[a:b])], first, forest)
    return out


def run_links(key: np.ndarray, fp: np.ndarray, forest: Forest) -> list[tuple[int, int]]:
    """Links of whole buckets; rows come sorted by key."""
    edge = np.nonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))[0]
    start, size = edge[:-1], np.diff(edge)
    out = []
    for a, n in zip(start[size > PAIRWISE].tolist(), size[size > PAIRWISE].tolist()):
        out += (bucket_links if n <= BALLS else split_links)(np.unique(fp[a : a + n]), int(key[a] >> np.uint64(32)), forest)
    small = np.repeat((size > 1) & (size <= PAIRWISE), size)
    key, fp = key[small], fp[small]
    own = own_key(fp, key)
    for step in range(1, PAIRWISE):
        if step >= len(key):
            break
        at = np.nonzero((key[step:] == key[:-step]) & (own[step:] | own[:-step]))[0]
        if not len(at):
            continue
        x = fp[at] ^ fp[at + step]
        at = at[chain_holds(x, (key[at] >> np.uint64(32)).astype(np.int64)) & (x != 0)]
        out += [(a, b) for a, b in zip(fp[at].tolist(), fp[at + step].tolist()) if forest.joins(a, b)]
    return out


def links(fps: DataFrame) -> DataFrame:
    """fps: fp, distinct. Returns u, v: true links (at most MOST differing bits) that connect the same fingerprints as all
    such links do. Two fingerprints within MOST bits have a chain (see chain_holds) that starts at some segment; its first
    two steps, no bit and then at most one, are an equality of keys, so rows meet by key, sorted within partitions, and the
    later steps prune before the full check. Buckets are read as a stream; a bucket is bounded by the distinct fingerprints
    that share 26 bits, and is not expanded into pairs."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                k = keys_of(part)
                yield pd.DataFrame({"key": k.ravel().view(np.int64), "fp": np.repeat(part, k.shape[1]).view(np.int64)})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, held = Forest(), []
        show = lambda x: pd.DataFrame({n: np.array([p[i] for p in x], dtype=np.uint64).view(np.int64) for i, n in enumerate("uv")})
        for batch in batches:
            key, fp = (batch[c].to_numpy(dtype=np.int64).view(np.uint64) for c in ("key", "fp"))
            if not len(key):
                continue
            cut_at = int(np.searchsorted(key, key[-1]))
            if cut_at:
                k, f = (np.concatenate(x) for x in zip(*held, (key[:cut_at], fp[:cut_at])))
                held = []
                yield show(run_links(k, f, forest))
            held.append((key[cut_at:], fp[cut_at:]))
        if held:
            yield show(run_links(*(np.concatenate(x) for x in zip(*held)), forest))

    return fps.select("fp").mapInPandas(deal, "key long, fp long").repartition("key").sortWithinPartitions("key").mapInPandas(find, "u long, v long")


def place(rows: DataFrame, groups: DataFrame, links_: DataFrame, key: str) -> DataFrame:
    """rows: doc_id, h, key. groups: key, least (the smallest row), n (rows). Adds top (the smallest row of the component), null
    where a row is alone."""
    with scratch(rows.sparkSession) as made:
        roots = components(links_).withColumnRenamed("node", key)
        placed = groups.join(roots, key, "left").withColumn("root", F.coalesce("root", key))
        tops = placed.groupBy("root").agg(F.min("least").alias("top"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("n")).where("members > 1")
        shared = made.keep(join_shared(placed, tops, "root").where("top IS NOT NULL").select(key, "top", "n"), "components")
    return join_shared(rows, shared, key)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, similarity: bool = False) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 lower-case hex digits), component_id, h, kept.

    Equal fingerprints are collapsed first (a minimum per fingerprint), so copies cost nothing after that; the distinct ones
    are linked and their components found by distributed rounds; rows get their component by a join that keeps hot
    components apart. component_id is the smallest doc_id reachable over links; kept holds for that row (of rows with that id, for
    those with the smallest text hash h). Null text counts as empty: fingerprint zero, linked like any other; so do texts
    without words. Texts of any length are read whole. Null ids take part but are no component's id
    unless all its ids are null. Repeated rows each give a row, an empty table none. Only two columns are read.

    With `similarity` rows are linked if the Jaccard similarity of their sets of word shingles is 0.8 or more: links of
    fingerprints are checked for that, and the pairs whose fingerprints are further apart are found by jaccard.rest.
    """
    if similarity:
        return similar_duplicates(docs, id_col, text_col, words)
    rows = cut(fingerprints(docs, id_col, text_col, words), "fingerprints")
    groups = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least"), F.count(F.lit(1)).alias("n"))
    return shown(place(rows, groups, links(rows.select("fp").distinct()), "fp"))


def shown(found: DataFrame) -> DataFrame:
    alone = F.col("top").isNull()
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("component_id"),
        "h",
        (alone | F.col("top.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("top.h") == F.col("h"))).alias("kept"),
    )


def similar_duplicates(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """See near_duplicates. Rows with one set of shingles are collapsed to a set s, and links are between sets."""
    with scratch(docs.sparkSession) as made:
        path = new_path(docs.sparkSession, "near-wide")
        wide = cut(jaccard.rows_of(docs, id_col, text_col, words), "near-wide", path)
        sets = cut(wide.select("s", "n", "t", "fp", "sketch", "prefix").dropDuplicates(["s"]), "near-sets")
        rows = made.keep(wide.select("doc_id", "h", "fp", "s"), "near-rows")
        drop_path(docs.sparkSession, path)
        # Links of fingerprints, and sets of one fingerprint, as pairs of sets.
        heads = cut(sets.groupBy("fp").agg(F.min("s").alias("head"), F.count(F.lit(1)).alias("n")), "near-heads")
        head = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
        near = links(heads.select("fp")).join(head("u"), "u").join(head("v"), "v").select(F.col("u_head").alias("u"), F.col("v_head").alias("v"))
        same = join_shared(sets.select("s", "fp"), heads.where("n > 1"), "fp").where("s != head").select(F.col("head").alias("u"), F.col("s").alias("v"))
        near = cut(near.union(same).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-pairs")
        found = cut(jaccard.similar(near, sets, docs, text_col, words), "near-links")
        found = made.keep(jaccard.rest(found, sets, docs, text_col, words), "near-links")
    groups = rows.groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("least"), F.count(F.lit(1)).alias("n"))
    return shown(place(rows, groups, found, "s"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, similarity: bool = False) -> DataFrame:
    """docs without all but one row of each component (see near_duplicates), all columns as they are, whatever their names. Of repeated rows one
    stays, an empty table stays empty."""
    k1, k2, turn = fresh(docs.columns, "k1", "k2", "turn")
    names = dict(zip((k1, k2), row_key(id_col, text_col)))
    near = near_duplicates(docs, id_col, text_col, words, similarity)
    # h tells a null id from the number that stands for it. With plain equality the texts are dealt once, for join and window.
    kept = near.where("kept").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias(k1), F.col("h").alias(k2)).distinct()
    keyed = docs.withColumn(k1, names[k1]).withColumn(k2, names[k2])
    one = keyed.join(kept, [k1, k2], "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.col(id_col))))
    return one.where(F.col(turn) == 1).select(docs.columns)
