"""Exact links of sets of word shingles by Jaccard similarity: prefix and position filters, then the full sets. The part of
near-duplicate search that fingerprints can't do: at this similarity they differ in about ten bits."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, map_texts, may_have, row_key, scratch, small
from .components import components
from .shingles import majority, shingles

#: Least similarity as a fraction, so that bounds are whole numbers: two sets of a and b shingles are similar if they share at
#: least NUM / (NUM + DEN) * (a + b).
NUM, DEN = 4, 5
#: Texts from which it is learned which shingles are common, and in how many of them one is. Only the order depends on it.
SAMPLE, COMMON, MOST_COMMON = 5000, 3, 1 << 20
#: Buckets up to this size give all their pairs at once.
PAIRWISE = 32
#: Ratio of sizes within which a band of a large bucket lies; more than that of two similar sets.
BAND = 1.3
#: Counters of a set's sketch, of four bits each.
COUNTERS = 64
#: Rows that are dealt at once, for each set there is: of pairs with sketches, with a prefix, with a full set, and of large buckets
#: with sketches; LEAST in any case. So what lies on disk at a time grows with the sets, however many pairs they make.
SKETCHES, PREFIXES, FULL, ROWS = 8, 0.5, 0.25, 6
LEAST = 1 << 16


def shingle_set(text: str, words: int) -> np.ndarray:
    return distinct(shingles(text, words))


def distinct(found: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles; a text without words has one of its own."""
    out = np.unique(found)
    return out if len(out) else np.zeros(1, dtype="<u8")


def name_of(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), 7)


def signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def sketch(found: np.ndarray) -> bytes:
    """How many of the set's elements fall in each of COUNTERS ranges, modulo 16, two in a byte."""
    n = np.bincount((found >> np.uint64(58)).astype(np.int64), minlength=COUNTERS) & 15
    return (n[::2] | n[1::2] << 4).astype(np.uint8).tobytes()


def unpacked(sketches) -> np.ndarray:
    """A row of counters for each sketch."""
    x = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, COUNTERS // 2)
    return np.stack([x & 15, x >> 4], axis=2).reshape(-1, COUNTERS)


def may_agree(n, m, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of n and m elements with counters x and y can be similar: each counter's difference, around the ring of 16, is
    no more than the elements of that range which one of them lacks."""
    d = (x - y) & 15
    apart = np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
    return (NUM + DEN) * (n + m - apart) >= 2 * NUM * (n + m)


def in_parts(rows: DataFrame, by: str, most: float, work: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """work(rows), done and written for so many rows at a time at most, about, split by a hash of `by`: disk is freed in between."""
    parts = max(1, math.ceil(rows.count() / max(most, LEAST)))
    part = lambda i: rows if parts == 1 else rows.where(F.pmod(F.xxhash64(by, F.lit(11)), F.lit(parts)) == i)
    return functools.reduce(DataFrame.union, [cut(work(part(i)), name) for i in range(parts)])


def text_of(col: str):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def common_shingles(docs: DataFrame, text_col: str, words: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and in how many; at most MOST_COMMON, the most frequent ones."""
    n = docs.count()
    texts = docs.select(text_of(text_col).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"key": signed(shingle_set(text, words))})

    got = texts.mapInPandas(run, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()
    key, count = got["key"].to_numpy(dtype=np.int64).view(np.uint64), got["n"].to_numpy(dtype=np.int64)
    order = np.argsort(key)
    return key[order], count[order]


def rows_of(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """doc_id, h (tells rows apart that have one id), t (a hash of the text), fp (fingerprint), s (name of the set of shingles),
    n (its size), its sketch and its prefix, of every row."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            all_ = [shingles(t, words) for t in batch["text"]]
            found = [distinct(x) for x in all_]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "h": batch["h"], "t": batch["t"], "fp": signed([majority(x) for x in all_]), "s": signed([name_of(x) for x in found]),
                "n": np.array([len(x) for x in found], dtype=np.int32), "sketch": [sketch(x) for x in found], "prefix": [signed(prefix(x, common.value)) for x in found],
            })

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col)[1].alias("h"), F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text"))
    return map_texts(texts, run, "doc_id long, h binary, t long, fp long, s long, n int, sketch binary, prefix array<long>")


def prefix(found: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's first elements in an order that all sets share, rare ones first: so many that two similar sets have one in common."""
    key, count = common
    most = len(found) - -(-NUM * len(found) // DEN) + 1
    if not len(key):
        return found[:most]
    at = np.minimum(np.searchsorted(key, found), len(key) - 1)
    return found[np.lexsort((found, np.where(key[at] == found, count[at], 0)))[:most]]


def may_link(n, at, m, by) -> np.ndarray:
    """Whether sets of n and m elements whose first common element stands at places `at` and `by` can be similar."""
    shared = np.minimum(n - at, m - by)
    return ((NUM + DEN) * shared >= NUM * (n + m)) & (DEN * np.minimum(n, m) >= NUM * np.maximum(n, m))


def bucket_pairs(s: np.ndarray, n: np.ndarray, at: np.ndarray, root: np.ndarray, star: bool) -> list[tuple[int, int]]:
    """Pairs of one bucket, whose rows come by place, that pass the filters and have different roots; if star, only those with
    the first row."""
    out = []
    for i in range(min(1, len(s)) if star else len(s)):
        hit = np.nonzero(may_link(n[i], at[i], n[i + 1 :], at[i + 1 :]) & (root[i + 1 :] != root[i]))[0] + i + 1
        x = int(s[i])
        out += [(x, y) if x < y else (y, x) for y in s[hit].tolist()]
    return out


def runs(batches: Iterator[pd.DataFrame], by: str = "key") -> Iterator[pd.DataFrame]:
    """Batches sorted by a column, dealt anew so that no value is split."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[by].to_numpy()
        cut_at = int(np.searchsorted(key, key[-1]))
        if cut_at:
            yield pd.concat([*held, batch.iloc[:cut_at]], ignore_index=True)
            held = []
        held.append(batch.iloc[cut_at:])
    if held:
        yield pd.concat(held, ignore_index=True)


def edges(key: np.ndarray) -> np.ndarray:
    return np.nonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))[0]


def candidates(sets: DataFrame) -> DataFrame:
    """sets: s, n, root, prefix. Returns key, u, v, n, at: pairs u < v where key is null, and the rows (u alone) of buckets too large for
    all their pairs, of which only those with the first row are given."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in runs(batches):
            key, s, n, at, root = (rows[c].to_numpy(dtype=np.int64) for c in ("key", "s", "n", "at", "root"))
            edge = edges(key)
            pairs: set = set()
            large = np.zeros(len(key), dtype=bool)
            for a, size in zip(edge[:-1][np.diff(edge) > 1].tolist(), np.diff(edge)[np.diff(edge) > 1].tolist()):
                here = slice(a, a + size)
                pairs.update(bucket_pairs(s[here], n[here], at[here], root[here], size > PAIRWISE))
                large[here] = size > PAIRWISE
            if pairs:
                u, v = (np.array(x, dtype=np.int64) for x in zip(*pairs))
                yield pd.DataFrame({"key": pd.array([None] * len(u), dtype="Int64"), "u": u, "v": v, "n": 0, "at": 0})
            if large.any():
                yield pd.DataFrame({"key": pd.array(key[large], dtype="Int64"), "u": s[large], "v": s[large], "n": n[large], "at": at[large]})

    dealt = sets.select("s", "n", "root", F.posexplode("prefix").alias("at", "key")).select("key", "s", "n", "root", "at")
    return dealt.repartition("key").sortWithinPartitions("key", "at", "s").mapInPandas(find, "key long, u long, v long, n int, at int")


def across(large: DataFrame) -> DataFrame:
    """large: key, s, n, at, root. The pairs of its buckets that pass the filters and have different roots; given a column sketch,
    only those whose sketches may agree.

    A bucket is dealt by bands of sizes. Similar sets differ less in size than a band is wide, so a row meets those of its own band
    and is a guest in the next one; two guests have met in theirs. The number of partitions is given, since few bytes are much work.
    """

    extra = ["sketch"] if "sketch" in large.columns else []

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for rows in runs(batches):
            key, s, n, at, root = (rows[c].to_numpy(dtype=np.int64) for c in ("key", "s", "n", "at", "root"))
            own = rows["own"].to_numpy(dtype=bool)
            edge = edges(key)
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                names, place, size = np.unique(root[a:b], return_inverse=True, return_counts=True)
                if len(names) == 1 or not own[a:b].any():
                    continue
                other = place != np.argmax(size)
                counts = unpacked(rows["sketch"].iloc[a:b]) if extra else None
                for i in np.nonzero(other)[0].tolist():
                    ok = may_link(n[a + i], at[a + i], n[a:b], at[a:b]) & (place != place[i]) & (own[a:b] | own[a + i])
                    ok[: i + 1] &= ~other[: i + 1]  # met before
                    if extra and ok.any():
                        ok[ok] = may_agree(n[a + i], n[a:b][ok], counts[ok], counts[i])
                    y = s[a:b][ok]
                    if len(y):
                        held.append((np.minimum(y, s[a + i]), np.maximum(y, s[a + i])))
                    if len(held) >= 256:
                        yield pd.DataFrame(dict(zip("uv", map(np.concatenate, zip(*held)))))
                        held = []
        if held:
            yield pd.DataFrame(dict(zip("uv", map(np.concatenate, zip(*held)))))

    band = F.floor(F.log(F.col("n").cast("double")) / math.log(BAND))
    ways = F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own"))))
    # Buckets whose keys clash are compared as one, which gives more candidates and loses none.
    dealt = large.withColumn("way", ways).select(F.xxhash64("key", "way.band").alias("key"), "s", "n", "at", "root", "way.own", *extra)
    parts = int(large.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "key").sortWithinPartitions("key", "at", "s").mapInPandas(find, "u long, v long").distinct()


def hopeful(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs whose sketches may agree."""
    end = lambda c: sets.select(F.col("s").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                n, m = (b[c].to_numpy(dtype=np.int64) for c in ("u_n", "v_n"))
                yield b.loc[may_agree(n, m, unpacked(b["u_sketch"]), unpacked(b["v_sketch"])), ["u", "v"]]

    return pairs.join(end("u"), "u").join(end("v"), "v").mapInPandas(run, "u long, v long")


def similar(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """Those of the distinct pairs of sets, a written table, that are similar. First by their prefixes: what two sets share beyond both
    prefixes is no more than the longer rest. Then by the full sets, read again from a text of each; a filter of a fixed size keeps
    other texts out. Both in parts, since a pair travels with a prefix or a set; what is written on the way is removed."""
    spark, n = docs.sparkSession, sets.count()
    end = lambda c: sets.select(F.col("s").alias(c), F.col("n").alias(f"{c}_n"), F.col("prefix").alias(f"{c}_prefix"))

    def by_prefix(pairs: DataFrame) -> DataFrame:
        both = pairs.join(end("u"), "u").join(end("v"), "v")
        beyond = F.greatest(*[F.col(f"{c}_n") - F.size(f"{c}_prefix") for c in "uv"])
        most = F.size(F.array_intersect("u_prefix", "v_prefix")) + beyond
        return both.where((NUM + DEN) * most >= NUM * (F.col("u_n") + F.col("v_n"))).select("u", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in small(batches):
            found = [shingle_set(x, words) for x in batch["text"]]
            yield pd.DataFrame({"t": batch["t"], "name": signed([name_of(x) for x in found]), "found": [signed(x) for x in found]})

    with scratch(spark) as made:
        some = in_parts(pairs, "u", PREFIXES * n, by_prefix, "near-some")
        ends = some.select(F.col("u").alias("s")).union(some.select(F.col("v").alias("s"))).distinct()
        need = cut(sets.select("s", "t").join(ends, "s", "left_semi"), "near-need")
        texts = may_have(docs.select(F.xxhash64(text_of(text_col)).alias("t"), text_of(text_col).alias("text")), bitmap(need.select("t")), "t").where("__may").select("t", "text")
        # A text with another one's hash has another name, unless it is the same set.
        read = texts.mapInPandas(run, "t long, name long, found array<long>")
        full = cut(need.join(read, (need["s"] == read["name"]) & (need["t"] == read["t"])).select("s", "found").dropDuplicates(["s"]), "near-full")

        def by_sets(pairs: DataFrame) -> DataFrame:
            # A hub's slim pairs in one task cost less disk than copies of full sets.
            both = pairs.join(full.select(F.col("s").alias("u"), F.col("found").alias("x")), "u").join(full.select(F.col("s").alias("v"), F.col("found").alias("y")), "v")
            shared = F.size(F.array_intersect("x", "y"))
            return both.where((NUM + DEN) * shared >= NUM * (F.size("x") + F.size("y"))).select("u", "v")

        return made.keep(in_parts(some, "u", FULL * n, by_sets, "near-checked"), "near-links")


def rest(links: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, words: int) -> DataFrame:
    """The links given and others that connect, with them, what all similar pairs of sets connect.

    Every similar pair shares a shingle of both prefixes, and passes the filters at the first such. Pairs are compared in full, but
    for those whose ends are connected already. Large buckets first give the pairs with one row, then those that are left.
    """
    rooted = lambda df, found: df.join(components(found).withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("root", "s"))
    found = cut(candidates(rooted(sets.select("s", "n", "prefix"), links)), "near-buckets")
    first = cut(found.where("key IS NULL").select("u", "v").distinct(), "near-pairs")
    n = sets.count()
    first = in_parts(first, "u", SKETCHES * n, lambda pairs: hopeful(pairs, sets), "near-hopeful")
    links = cut(links.union(similar(first, sets, docs, text_col, words)), "near-links")
    large = found.where("key IS NOT NULL").select("key", F.col("u").alias("s"), "n", "at")
    if not large.isEmpty():
        roots = components(links).withColumnRenamed("node", "s")
        # A large bucket lies in one part.
        pairs = lambda part: across(part.join(sets.select("s", "sketch"), "s").join(roots, "s", "left").withColumn("root", F.coalesce("root", "s")))
        more = in_parts(large, "key", ROWS * n, pairs, "near-across")
        more = cut(more.distinct().join(first, ["u", "v"], "left_anti"), "near-rest")
        if not more.isEmpty():
            links = links.union(similar(more, sets, docs, text_col, words))
    return links
