"""Ordered folds: each step depends on what survived so far. Rows are dealt by key and sorted by Spark, and a fold reads them as
a stream: it holds the survivors of one key, not its rows, and small keys cost no call of their own."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_sorted(df: DataFrame, keys: list[str], order: list[Column], fold: Callable) -> DataFrame:
    """fold(): returns a pair of functions for one key: step(row) gives rows to pass on, end() the last ones. Rows are tuples in
    the order of df's columns."""
    at = [df.columns.index(k) for k in keys]
    names = df.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, step, end = None, None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != now:
                    if end:
                        out += end()
                    now, (step, end) = key, fold()
                out += step(row)
            yield pd.DataFrame(out, columns=names)
        if end:
            yield pd.DataFrame(end(), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, df.schema)


def greedy_spacing(df: DataFrame, keys: list[str], t: str, strength: str, spacing: int, later: bool = False) -> DataFrame:
    """Strongest first (the earlier of equals, or the later), rows at least `spacing` away from all kept ones are kept."""
    at = df.columns.index(t)

    def fold():
        kept: list[int] = []

        def step(row):
            x = row[at]
            i = bisect_left(kept, x)
            if (i == len(kept) or kept[i] - x >= spacing) and (i == 0 or x - kept[i - 1] >= spacing):
                insort(kept, x)
                return [row]
            return []

        return step, list

    return fold_sorted(df, keys, [F.desc(strength), F.desc(t) if later else F.asc(t)], fold)


def dedupe_by_peak(df: DataFrame, keys: list[str], t: str, strength: str, margin: int) -> DataFrame:
    """In time order a row within `margin` of the current survivor replaces it if it is stronger, else goes."""
    at, how = df.columns.index(t), df.columns.index(strength)

    def fold():
        held: list[tuple] = []

        def step(row):
            if held and row[at] - held[0][at] <= margin:
                if row[how] > held[0][how]:
                    held[0] = row
                return []
            out = held[:]
            held[:] = [row]
            return out

        return step, lambda: held

    return fold_sorted(df, keys, [F.asc(t), F.desc(strength)], fold)


def merge_windows(df: DataFrame, keys: list[str], start: str, end: str, centre: str, score: str, gap: int, apart: int) -> DataFrame:
    """Windows by start: one that begins within `gap` of the current one's end joins it, unless their centres are `apart` or
    more. The stronger one's centre and score stay, the earlier of equals. Other columns are those of the first member."""
    s, e, c, v = (df.columns.index(x) for x in (start, end, centre, score))

    def fold():
        held: list[list] = []

        def step(row):
            if held and row[s] <= held[0][e] + gap and row[c] - held[0][c] < apart:
                now = held[0]
                now[e] = max(now[e], row[e])
                if row[v] > now[v]:
                    now[c], now[v] = row[c], row[v]
                return []
            out = [tuple(x) for x in held]
            held[:] = [list(row)]
            return out

        return step, lambda: [tuple(x) for x in held]

    return fold_sorted(df, keys, [F.asc(start), F.asc(centre), F.desc(score)], fold)


NONE = -(2**63)


def one_to_one(refs: DataFrame, dets: DataFrame, key: str, ref_t: str, det_t: str, collar: int, later: bool = False) -> DataFrame:
    """key, ref_t, det_t: references in time order each take the nearest unused detection within the collar, the earlier (or the
    later) of equals; det_t is null for a miss. Both come as one stream by time: a reference is settled once the stream has
    passed its collar, so only the times within a collar or two are held."""
    r = refs.select(key, F.col(ref_t).alias("t"), F.lit(1).alias("ref"), F.lit(NONE).alias("det"))
    both = r.unionByName(dets.select(key, F.col(det_t).alias("t"), F.lit(0).alias("ref"), F.lit(NONE).alias("det")))
    names = both.columns
    k, t, is_ref = names.index(key), names.index("t"), names.index("ref")

    def fold():
        free: list[int] = []
        waiting: list[tuple] = []

        def settle(row):
            at, best = row[t], None
            for j in range(bisect_left(free, at - collar), len(free)):
                far = abs(free[j] - at)
                if free[j] > at + collar:
                    break
                if best is None or far < abs(free[best] - at) or (later and far == abs(free[best] - at)):
                    best = j
            return (row[k], at, 1, free.pop(best) if best is not None else NONE)

        def step(row):
            done = 0
            while done < len(waiting) and waiting[done][t] + collar < row[t]:
                done += 1
            out = [settle(x) for x in waiting[:done]]
            del waiting[:done]
            first = waiting[0][t] if waiting else row[t]
            del free[: bisect_left(free, first - collar)]
            if row[is_ref]:
                waiting.append(row)
            else:
                free.append(row[t])
            return out

        return step, lambda: [settle(x) for x in waiting]

    out = fold_sorted(both, [key], [F.asc("t"), F.asc("ref")], fold)
    return out.select(key, F.col("t").alias(ref_t), F.when(F.col("det") != NONE, F.col("det")).alias(det_t))


def one_to_one_collars(refs: DataFrame, dets: DataFrame, key: str, ref_t: str, det_t: str, collars: list[int]) -> DataFrame:
    """collar, key, ref_t, det_t: one_to_one at several collars over one sorted stream, the earlier of equals first."""
    r = refs.select(F.lit(0).cast("long").alias("collar"), key, F.col(ref_t).alias("t"), F.lit(1).alias("ref"), F.lit(NONE).alias("det"))
    both = r.unionByName(dets.select(F.lit(0).cast("long").alias("collar"), key, F.col(det_t).alias("t"), F.lit(0).alias("ref"), F.lit(NONE).alias("det")))
    names = both.columns
    k, t, is_ref = names.index(key), names.index("t"), names.index("ref")

    def fold():
        free: list[list[int]] = [[] for _ in collars]
        waiting: list[list[tuple]] = [[] for _ in collars]

        def settle(i, row):
            at, mine, best = row[t], free[i], None
            for j in range(bisect_left(mine, at - collars[i]), len(mine)):
                if mine[j] > at + collars[i]:
                    break
                if best is None or abs(mine[j] - at) < abs(mine[best] - at):
                    best = j
            return (collars[i], row[k], at, 1, mine.pop(best) if best is not None else NONE)

        def step(row):
            out = []
            for i, collar in enumerate(collars):
                done = 0
                while done < len(waiting[i]) and waiting[i][done][t] + collar < row[t]:
                    out.append(settle(i, waiting[i][done]))
                    done += 1
                del waiting[i][:done]
                first = waiting[i][0][t] if waiting[i] else row[t]
                del free[i][: bisect_left(free[i], first - collar)]
                if row[is_ref]:
                    waiting[i].append(row)
                else:
                    free[i].append(row[t])
            return out

        return step, lambda: [settle(i, x) for i in range(len(collars)) for x in waiting[i]]

    out = fold_sorted(both, [key], [F.asc("t"), F.asc("ref")], fold)
    return out.select("collar", key, F.col("t").alias(ref_t), F.when(F.col("det") != NONE, F.col("det")).alias(det_t))


def keep_apart(df: DataFrame, keys: list[str], t: str, apart: int) -> DataFrame:
    """In time order rows more than `apart` after the last row kept."""
    at = df.columns.index(t)

    def fold():
        last: list[int] = []

        def step(row):
            if last and row[at] - last[0] <= apart:
                return []
            last[:] = [row[at]]
            return [row]

        return step, list

    return fold_sorted(df, keys, [F.asc(t)], fold)
