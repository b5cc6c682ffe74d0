import random

import corpus_pipeline
from eventspan.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, path):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    passage = " ".join(word() for _ in range(60))
    rows, labels = [], []
    for i in range(300):
        words = [word() for _ in range(r.randint(60, 120))]
        if i % 5 == 0:
            words.insert(r.randrange(len(words)), r.choice(["zzidiot", "zzmoron"]))
        text = " ".join(words)
        if i % 7 == 0:
            text = text + "\n" + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(1000 + i, rows[i][1] + " tail", "en", "s0", 0) for i in (1, 2, 3)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, "only me here and now", "en", "s1", None), rows[4]]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, passage


def test_stages(spark, tmp_path):
    rows, passage = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs = corpus_pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows if not r[1] or "zz" not in r[1]}
    assert docs.where("doc_id = 4").count() == 2
    after = corpus_pipeline.drop_repeated_runs(spark, docs, str(tmp_path))
    assert after.columns == docs.columns and after.count() == docs.count()
    got = {r.doc_id: r for r in after.collect()}
    assert [i for i in got if got[i].text and passage in got[i].text] == [7] and all(r.text is None or r.n_chars == len(r.text) for r in got.values())
    left = corpus_pipeline.drop_near_duplicates(spark, after, str(tmp_path))
    ids = [r.doc_id for r in left.collect()]
    assert len(ids) == len(set(ids)) and {1, 2, 3, 4, None} <= set(ids) and len({2000, 2001} & set(ids)) == 1
    sizes = {r.doc_id: len((r.text or "").split()) for r in left.collect()}
    plan = {r.doc_id: r for r in mixing.mix(left).collect()}
    mixed = corpus_pipeline.mix_sources(spark, left, str(tmp_path)).collect()
    taken = {}
    for r in mixed:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split())
    assert taken == {i: p.taken for i, p in plan.items() if p.taken} and all(p.size == sizes[i] for i, p in plan.items())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == len(mixed) and all(len(r.ids) == r.n_tokens for r in out)


def brute_mix(rows):
    import hashlib

    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        rate = left / sum(weight[s] for s in free)
        over = {s for s in free if rate * weight[s] > 2 * size[s]}
        if not over:
            target |= {s: rate * weight[s] for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    out = {}
    for s in names:
        mine = sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), len((t or "").split()), i) for i, t, x in rows if x == s)
        todo = int(target[s] + 1e-9)
        while todo and size[s]:
            for _, n, i in mine:
                take = min(n, todo)
                out[(i, s)] = out.get((i, s), 0) + take
                todo -= take
    return out, target


def test_mixture_against_the_plain_rule(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 40))), r.choice(["a", "a", "a", "b", "ä", None])) for i in range(200)] + [(None, "x y", "b"), (500, None, "z")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, size int").repartition(5)
    for bucket_rows in (10, 50_000):
        got = mixing.mix(df, bucket_rows=bucket_rows).collect()
        want, target = brute_mix(rows)
        by = {i: s for i, _, s in rows}
        assert len(got) == len(rows)
        assert all(abs(x.target - target[by[x.doc_id]]) < 1e-6 for x in got)
        assert {(x.doc_id, by[x.doc_id]): x.taken for x in got if x.taken} == {k: v for k, v in want.items() if v}
        assert all(x.taken <= 2 * x.size for x in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_empty_tables_long_texts_and_clashing_names(spark, tmp_path):
    long = "\n".join(f"word{i} other{i % 97} end" for i in range(30_000))
    rows = [(i, long if i == 5 else f"text number {i} of {i * 7}", "en", "s", i, "k", 7, 1) for i in range(12)]
    docs = spark.createDataFrame(rows, SCHEMA + ", __k1 string, __turn int, __COPY int")
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    for part, n in ((docs, 12), (docs.limit(0), 0)):
        at = f"{tmp_path}/a"
        for name, stage in corpus_pipeline.STAGES[:3]:
            part = stage(spark, part, at)
            assert part.columns == docs.columns and part.count() == n, name
            assert n == 0 or {(r["__k1"], r["__turn"], r["__COPY"]) for r in part.collect()} == {("k", 7, 1)}
        mixed = corpus_pipeline.mix_sources(spark, part, at)
        assert mixed.columns == docs.columns and {r["__turn"] for r in mixed.collect()} <= {7}
        assert corpus_pipeline.encode(spark, mixed, at).count() == mixed.count() >= n
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
