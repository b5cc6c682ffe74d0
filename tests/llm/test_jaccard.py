import random

import numpy as np

from eventspan.llm import jaccard, simhash


def brute(texts, words=5, least=0.8):
    """Smallest index reachable over pairs whose word shingles are similar, for each text."""

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or {tuple(w)}

    sets, root = [grams(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and len(a & sets[j]) >= least * len(a | sets[j]) - 1e-12:
                x, y = sorted((root[i], root[j]))
                root = [x if r == y else r for r in root]
    return root


def word(r):
    return r.choice("abcdefghijkl") + str(r.randrange(1000))


def test_components_of_all_similar_pairs(spark):
    r = random.Random(6)
    common = [word(r) for _ in range(12)]
    texts = [None, "", "a B", "A b", "one two three four"]
    for family in range(12):
        base = [word(r) for _ in range(r.randint(20, 150))]
        for _ in range(r.randint(2, 9) if family else 90):  # one group larger than a bucket whose pairs are all compared
            w = list(base)
            for _ in range(r.randint(0, max(2, len(w) // 30))):
                w[r.randrange(len(w))] = word(r)
            texts.append(" ".join(w + common * (r.random() < 0.5)))
    for _ in range(80):
        texts.append(" ".join(common + [word(r) for _ in range(r.randint(0, 4))]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, words=5, similarity=True).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(texts)
    left = [x.doc_id for x in simhash.drop_near_duplicates(df, words=5, similarity=True).collect()]
    assert sorted(left) == sorted(set(want))
    # SimHash at four bits keeps many of these copies.
    assert simhash.near_duplicates(df).where("kept").count() > len(left)
    assert simhash.near_duplicates(df.limit(0), words=5, similarity=True).count() == 0


def test_across_gives_every_pair_of_a_large_bucket_whatever_the_sizes(spark):
    """Sets of 1 to 400 shingles in two buckets, one root holding most of them: all pairs that pass the filters and have different
    roots, none twice and no others."""
    rng = np.random.default_rng(5)
    rows, s = [], 0
    for key in (11, -7):
        for n in [1, 4, 5, *rng.integers(1, 401, 150).tolist()]:
            s += 1
            rows.append((key, s, int(n), int(rng.integers(0, max(1, n // 5 + 1))), int(rng.choice([1, 1, 1, 2, 3, s]))))
    found = [tuple(r) for r in jaccard.across(spark.createDataFrame(rows, "key long, s long, n int, at int, root long")).collect()]
    want = set()
    for k, a, n, at, root in rows:
        for k2, b, m, by, root2 in rows:
            if k == k2 and a < b and root != root2 and jaccard.may_link(n, at, m, by):
                want.add((a, b))
    assert len(found) == len(set(found)) and set(found) == want and len(want) > 100


def test_across_of_nothing_gives_nothing(spark):
    assert jaccard.across(spark.createDataFrame([], "key long, s long, n int, at int, root long")).isEmpty()


def test_sketches_part_no_similar_sets_and_most_others():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 500, 5000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        most = n // 9  # elements that differ on each side, so that 4 in 5 are shared
        near = np.unique(np.concatenate([a[most:], rng.integers(0, 2**64, most, dtype=np.uint64)]))
        sub = a[: -(-4 * len(a) // 5)]
        other = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        agree = lambda x, y: bool(jaccard.may_agree(len(x), np.array([len(y)]), jaccard.unpacked([jaccard.sketch(y)]), jaccard.unpacked([jaccard.sketch(x)])[0])[0])
        assert agree(a, a) and agree(a, near) and agree(a, sub) and agree(sub, a)
        assert n > 500 or not agree(a, other) or jaccard.sketch(a) == jaccard.sketch(other)


def test_pairs_are_compared_in_parts_and_sketches_keep_unlike_pairs_of_large_buckets_out(spark, monkeypatch):
    """Texts that share a rare phrase and little else: their pairs grow with the square of the texts, and none may go further than a
    few bytes. The result is the same in many parts."""
    r = random.Random(2)
    phrase = [word(r) for _ in range(30)]
    texts = [" ".join([word(r) for _ in range(40)] + phrase + [word(r) for _ in range(40)]) for _ in range(150)]
    texts += [t + " end" for t in texts[:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    # A sample that does not show the phrase to be common, so that it comes into prefixes.
    monkeypatch.setattr(jaccard, "common_shingles", lambda *_: (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
    monkeypatch.setattr(jaccard, "LEAST", 400)
    for name in ("SKETCHES", "PREFIXES", "FULL", "ROWS"):
        monkeypatch.setattr(jaccard, name, 0.1)
    tried, parts, plain, whole = [], [], jaccard.similar, jaccard.in_parts

    def counted(pairs, *args):
        tried.append(pairs.count())
        return plain(pairs, *args)

    def split(rows, by, most, *args):
        parts.append(rows.count() > max(most, jaccard.LEAST))
        return whole(rows, by, most, *args)

    monkeypatch.setattr(jaccard, "similar", counted)
    monkeypatch.setattr(jaccard, "in_parts", split)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(df, words=5, similarity=True).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts) and any(parts)
    assert sum(tried) < 100
