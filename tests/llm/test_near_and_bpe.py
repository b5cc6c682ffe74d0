import hashlib
import random

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from eventspan.llm import bpe, components, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def brute_roots(fps, most=4):
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= most:
                a_, b_ = root(a), root(b)
                up[max(a_, b_)] = min(a_, b_)
    return {f: root(f) for f in fps}


def sets(roots):
    out = {}
    for k, v in roots.items():
        out.setdefault(v, set()).add(k)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("first", range(5))
def test_large_buckets_follow_the_chains(first):
    """Balls and the split by the third segment connect what all pairs with a chain from the bucket's segment connect."""
    r = np.random.default_rng(first)
    base = r.integers(0, 2**64, 6, dtype=np.uint64)
    fp = np.concatenate([base, *(base ^ np.uint64(sum(1 << int(b) for b in r.choice(64, r.integers(0, 4), replace=False))) for _ in range(90))])
    fp = np.unique(fp)
    pairs = [(int(a), int(b)) for i, a in enumerate(fp) for b in fp[i + 1 :][simhash.chain_holds(fp[i + 1 :] ^ a, np.full(len(fp) - i - 1, first))]]
    want = simhash.Forest()
    for a, b in pairs:
        want.joins(a, b)
    for find in (simhash.bucket_links, simhash.split_links):
        got = simhash.Forest()
        out = find(fp, first, simhash.Forest())
        assert all(simhash.chain_holds(np.array([a ^ b], dtype=np.uint64), np.array([first])).all() for a, b in out)
        for a, b in out:
            got.joins(a, b)
        assert [got.root(int(x)) for x in fp] == [want.root(int(x)) for x in fp]


@pytest.mark.parametrize("shape", ["scattered", "dense", "drifting"])
def test_links_join_what_all_pairs_join(spark, shape):
    r = random.Random(shape)
    fps = set()
    for _ in range(40 if shape == "scattered" else 3):
        base = r.getrandbits(64)
        for _ in range(8 if shape == "scattered" else 250):
            x = base
            for _ in range(r.randint(0, 6 if shape == "scattered" else 4)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
            if shape == "drifting" and r.random() < 0.1:
                base = x
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long").repartition(3)
    links = simhash.links(df).collect()
    un = lambda x: int(np.int64(x).view(np.uint64))
    assert all(bin(un(a) ^ un(b)).count("1") <= 4 for a, b in links)
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(un(a)), root(un(b))
        up[max(a, b)] = min(a, b)
    assert sets({f: root(f) for f in fps}) == sets(brute_roots(fps))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7), (7, 8)] + [(500, 1000 + i) for i in range(300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {i: 500 for i in (500, *range(1000, 1300))}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates(spark):
    r = random.Random(5)
    base = [r.choice(["the", "On", "ñu", "re\x0bal", "x"]) + str(r.randrange(50)) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t"), (4, "A b"), (5, "a B"), (None, "a b"), (6, " ".join(base)), (7, " ".join(base[:150] + ["zz"] + base[150:])), (7, " ".join(base)), (9, "solo words that stand quite alone here " * 3)]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 0, i) for i, t in rows], DOC + ", fp int, __K1 long")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    root = brute_roots(fps)
    least = {}
    for i, t in rows:
        k = root[plain_fingerprint(t)]
        least[k] = min(x for x in (i, least.get(k)) if x is not None) if (i is not None or k in least) else None
    want = sorted(((i, f"{plain_fingerprint(t):016x}", least[root[plain_fingerprint(t)]]) for i, t in rows), key=repr)
    assert sorted((tuple(x)[:3] for x in got), key=repr) == want
    left = simhash.drop_near_duplicates(df).collect()
    assert len(left) == len({x[2] for x in want}) and {x.doc_id for x in left} == {x[2] for x in want} and left[0].fp == 0
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_bpe_equals_the_library(spark):
    lib = Tokenizer.from_file(bpe.default_path())
    mine = bpe.codec(bpe.default_path())
    r = random.Random(1)
    letters = [" ", "  ", "\n", "\t", "\x85", " ", " ", "a", "b", "é", "1", "٣", "½", "🙂", "<|endoftext|>", "<|endof", "'s", "'S", ".", "#", "中", "́", "﻿", "\0"]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 15))) for _ in range(3000)] + ["abcdefgh" * 20_000, ""]
    for t in texts:
        e = lib.encode(t, add_special_tokens=False)
        assert mine.encode(t) == e.ids
        assert mine.decode(e.ids) == lib.decode(e.ids, skip_special_tokens=False)
    rows = spark.createDataFrame([(1, "Hello <|endoftext|> wörld", 0), (1, None, 0), (None, "x", 0)], "doc_id long, text string, n_tokens int")
    got = bpe.tokenize(rows, with_ids=True).collect()
    ids = lib.encode("Hello <|endoftext|> wörld", add_special_tokens=False).ids
    assert got[0].ids == ids and got[0].n_tokens == len(ids)
    assert got[0].decoded_sha256 == hashlib.sha256("Hello <|endoftext|> wörld".encode()).hexdigest()
    assert (got[1].n_tokens, got[1].ids_sha256) == (0, hashlib.sha256(b"").hexdigest()) and got[2].doc_id is None
    assert bpe.tokenize(rows.limit(0)).count() == 0
