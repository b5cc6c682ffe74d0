import random
import time

from pyspark.sql import functions as F

from eventspan.llm import line_dedup


def brute(texts, run_words=50):
    """texts in order of their ids. Lines that lie in a run of at least run_words words which stood earlier."""
    lines = [[x.strip() for x in t.split("\n")] for t in texts]
    gone = [set() for _ in texts]
    for d, mine in enumerate(lines):
        for c in range(d + 1):
            theirs = lines[c]
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    if (c, j) >= (d, i) or (i and j and mine[i - 1] == theirs[j - 1]):
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in mine[i : i + n]) >= run_words:
                        gone[d] |= set(range(i, i + n))
    return gone


def words(r, n):
    return " ".join(r.choice("abcdefghijkl") + str(r.randrange(1000)) for _ in range(n))


def test_planted_passages(spark):
    r = random.Random(2)
    one, many, short = words(r, 60), "\n".join(words(r, 9) for _ in range(7)), words(r, 20)
    texts = []
    for k in range(30):
        parts = [words(r, r.randint(3, 30)) for _ in range(6)]
        parts.insert(r.randint(0, 6), r.choice([one, many, short]))
        if k % 7 == 0:
            parts.insert(r.randint(0, 6), many)
        texts.append("\n".join(parts))
    texts += [texts[4], "", words(r, 200), one + "\n\n" + one]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, None, 0), (None, texts[2], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs int").repartition(4)
    got = {r.doc_id: r for r in line_dedup.line_dedup(df).where("doc_id is not null").collect()}
    gone = brute(texts)
    for i, t in enumerate(texts):
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i])
        assert got[i].text == left, i
        assert got[i]["__removed_lines"] == len(gone[i])
    last = line_dedup.line_dedup(df).where("doc_id is null").orderBy(F.col("text").asc_nulls_first()).collect()
    assert [x.text for x in last] == [None, ""]
    assert line_dedup.report(df.limit(0)).count() == 0
    assert any(gone) and not any(gone[i] and one not in t and many not in t and i != len(texts) - 4 for i, t in enumerate(texts))


def test_random_lines_lose_only_what_stood_earlier(spark):
    r = random.Random(9)
    pool = [words(r, r.randint(1, 30)) for _ in range(12)]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()}
    gone = brute(texts)
    for i, t in enumerate(texts):
        lines = t.split("\n")
        must = [x for k, x in enumerate(lines) if k not in gone[i]]
        left = got[i].split("\n") if got[i] else []
        it = iter(left)
        assert all(any(x == y for y in it) for x in must), "a line went that is in no repeated run"
    assert set(x for t in texts for x in t.split("\n")) == set(x for t in got.values() for x in t.split("\n") if x)


def lost(spark, texts):
    """What line_dedup leaves of each text, and what is left where every repeated run goes."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()}
    gone = brute(texts)
    return [got[i] for i in range(len(texts))], ["\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in enumerate(texts)]


def test_random_lines_lose_all_that_stood_earlier(spark):
    r = random.Random(9)
    pool = [words(r, r.randint(1, 30)) for _ in range(12)] + ["", " ", words(r, 70)]
    got, want = lost(spark, ["\n".join(r.choice(pool) for _ in range(r.randint(1, 12))) for _ in range(60)])
    assert got == want


def test_an_earlier_part_hides_no_full_copy(spark):
    r = random.Random(4)
    texts = []
    for _ in range(20):
        passage = [words(r, 5) for _ in range(r.choice([10, 11, 12]))]
        at = r.randint(0, len(passage) - 9)
        texts.append("\n".join([words(r, 5), *passage[at : at + 9], words(r, 5)]))
        texts += ["\n".join([words(r, 5), *passage, words(r, 5)]) for _ in range(5)]
    got, want = lost(spark, texts)
    assert got == want


def test_blank_lines_and_clashing_names(spark):
    r = random.Random(6)
    passage = "\n".join(words(r, 8) + "\n" * r.randint(0, 2) for _ in range(9))
    texts = ["\n" * 40 + passage + "\n\n\n" + words(r, 5), words(r, 7) + "\n\n" + passage + "\n\n" + words(r, 70), passage + "\n" * 100_000 + passage]
    got, want = lost(spark, texts[:2])
    assert got == want and passage not in got[1]
    start = time.time()
    assert len(line_dedup.fingerprints("\n" * 300_000 + passage)) > 0 and time.time() - start < 15
    df = spark.createDataFrame([(i, t, 7, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, __k1 int, __RUNS string, __lines int")
    out = line_dedup.line_dedup(df)
    assert out.columns == ["doc_id", "text", "__k1", "__RUNS", "__lines", "__removed_lines", "__removed_words"]
    rows = {x.doc_id: x for x in out.collect()}
    assert rows[2].text.strip() == "" and rows[2]["__k1"] == 7 and rows[2]["__lines"] == texts[2].count("\n") + 1


def test_null_id_beside_the_largest_id(spark):
    r = random.Random(8)
    one = "\n".join(words(r, 10) for _ in range(8))
    df = spark.createDataFrame([(2**63 - 1, one), (None, one + "\n" + words(r, 3)), (None, one)], "doc_id long, text string")
    got = line_dedup.line_dedup(df).collect()
    assert {x.text for x in got if x.doc_id is not None} == {one} and all(one not in x.text for x in got if x.doc_id is None)
