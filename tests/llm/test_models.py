import random

import numpy as np
import pytest

from eventspan.llm import language, toxicity


def dense_of(index):
    out = np.zeros((len(index.labels), len(index.terms)))
    for term in range(len(index.terms)):
        e, w = index.postings(term)
        out[e, term] = w
    return out


def test_search_is_exact():
    r = np.random.default_rng(1)
    terms = {f"t{i}": i for i in range(60)}
    weight = r.uniform(0.5, 4, 60)
    examples = []
    for i in range(700):
        t = np.sort(r.choice(60, r.integers(1, 7), replace=False))
        examples.append((i, int(r.integers(0, 2)), t.tolist(), r.integers(1, 5, len(t)).tolist(), i))
    index = toxicity.Index.build(terms, weight, examples, 0.1, 0.05)
    dense = dense_of(index)
    assert np.allclose((dense**2).sum(axis=1), 1) and sorted(index.names.values()) == list(range(700))
    opened, plain = [], toxicity.Index.open
    index.open = lambda t, w, blocks, scores: (opened.append(len(blocks)), plain(index, t, w, blocks, scores))
    for turn in range(300):
        t = np.sort(r.choice(60, r.integers(1, 9), replace=False))
        w = toxicity.unit(t, r.integers(1, 5, len(t)), weight)
        q = np.zeros(60)
        q[t] = w
        without = int(r.integers(0, 700)) if turn % 2 else -1
        s = np.round(dense @ q, 8)
        s[without] *= without < 0
        want = [(float(s[e]), e) for e in np.lexsort((np.arange(700), -s))[:15] if s[e] > 0]
        got = [(round(a, 8), b) for a, b in index.search(t, w, 15, without)]
        assert [a for a, _ in got] == pytest.approx([a for a, _ in want], abs=2e-8)
        assert without not in [b for _, b in got]
    assert sum(opened) < 300 * index.peak.shape[1]
    assert index.score({}) == (0.05, [])


def test_scores_against_a_plain_nearest_neighbour_vote(spark):
    """The whole operator: TF-IDF vectors of all texts held side by side, sorted, voted and calibrated without an index."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 4)))
    make = lambda bad: " ".join([word() for _ in range(r.randint(5, 60))] + [r.choice(["Nasty", "nastier", "vile"])] * bad)
    rows = [(i, make(int(i % 4 == 0)), int(i % 4 == 0)) for i in range(300)]
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"), max_examples=100)
    assert set(index.labels.tolist()) == {0, 1} and len(index.labels) == 100 and index.labels.sum() == 50
    assert index.stands == pytest.approx((3.0, 1.0), rel=0.02)
    dense = dense_of(index)
    fresh = [(1000 + i, make(int(i % 3 == 0))) for i in range(60)] + [(2000, "Vile " * 50_000), (2001, "?!"), (2002, None)]
    got = {x.doc_id: x for x in toxicity.score(spark.createDataFrame(fresh, "doc_id long, text string"), index).collect()}
    for i, text in fresh:
        q = np.zeros(len(index.terms))
        for w in {w for w in toxicity.words_of((text or "").lower())}:
            n = toxicity.words_of(text.lower()).count(w)
            for key in {w, *(w[:k] + "*" for k in (4, 5) if len(w) > k)}:
                if key in index.terms:
                    q[index.terms[key]] += n
        q = np.where(q > 0, (1 + np.log(np.maximum(q, 1))) * index.weight, 0)
        if not q.any():
            assert got[i].score == index.bare and got[i].evidence == []
            continue
        s = np.round(dense @ (q / np.sqrt(q @ q)), 9)
        near = [e for e in np.lexsort((np.arange(len(s)), -s))[:15] if s[e] > 0]
        w = np.array([(index.stands[1] if index.labels[e] else index.stands[0]) / (1.05 - s[e]) for e in near])
        vote = ((w * index.labels[near]).sum() + index.prior) / (w.sum() + 1)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-(index.slope * vote + index.offset))), abs=1e-4), i
        assert got[i].similarity == pytest.approx(s[near[:5]].tolist(), abs=1e-8)
    assert all(got[1000 + i].predicted == (i % 3 == 0) for i in range(60)) and got[2000].predicted == 1


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 6)))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(50)]
        if bad := i % 6 == 0:
            words.insert(r.randrange(50), r.choice(["zonkers", "Zonkest", "wurp."]))
        rows.append((i, " ".join(words), 1.0))
        labels.append((i, int(bad)))
    rows += [(5000, None, 0.0), (5001, "", 0.0), (None, "wurp", 0.0), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    marks = spark.createDataFrame(labels + [(5000, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    seen = [x for x in got if x.held_out and x.doc_id is not None and x.doc_id < 900]
    assert seen and all(x.predicted == (x.doc_id % 6 == 0) for x in seen)
    by = {x.doc_id: x for x in got}
    assert by[5000].score == by[5001].score < 0.5 and by[5000].evidence == []
    assert by[None].predicted == 1 and all(i % 6 == 0 for i in by[None].evidence)
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert toxicity.toxicity(docs, marks.limit(0)).where("predicted = 1").count() == 0


def test_toxic_documents_of_few_labelled_rows_are_rejected(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioubcdfg") for _ in range(r.randint(2, 6)))
    slurs, rows = ["zonk", "wurp", "zilt", "yarx", "vemp"], []
    for i in range(80):
        words = [word() for _ in range(50)] + ([slurs[i // 8 % 5], slurs[(i // 8 + 1) % 5]] if i % 8 == 0 else [])
        rows.append((i, " ".join(words), int(i % 8 == 0)))
    index = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    loud = {t for t, i in index.terms.items() if index.weight[i] > 0.5}
    assert loud >= set(slurs) and len(loud) <= len(slurs) + 3 * toxicity.BY_CHANCE and set(index.labels.tolist()) == {0, 1}
    fresh = [(100 + i, " ".join([word() for _ in range(40)] + (slurs[i % 4 : i % 4 + 2] if i % 3 == 0 else [])), 1) for i in range(60)]
    left = toxicity.reject(spark.createDataFrame(fresh, "doc_id long, text string, n int"), index)
    assert {x.doc_id for x in left.collect()} == {100 + i for i in range(60) if i % 3}


def test_folded_tables_equal_the_plain_network():
    r = np.random.default_rng(3)
    nf = language.FILTERS * len(language.WIDTHS)
    net = language.ByteNet(["a", "b"], r.normal(size=(256, language.DIMS)), r.normal(size=(4, language.DIMS, nf)), r.normal(size=nf), r.normal(size=(nf, 2)), r.normal(size=2))
    x = language.windows(bytes(r.integers(0, 256, 1000).astype(np.uint8)))
    e = net.emb[x.astype(int)]
    h = sum(e[:, j : j + language.WINDOW] @ net.filters[j] for j in range(4)).max(axis=1)
    z = np.maximum(h + net.bias, 0) @ net.out + net.out_bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.tables()), p / p.sum(axis=1, keepdims=True), atol=1e-3)


def test_language_on_held_out_rows(spark):
    r = random.Random(4)
    make = {"xx": "akotu mire", "yy": "schprtz weng", "zz": "éèçà ñou"}
    rows = [(i, "".join(r.choice(make[k]) for _ in range(r.randint(80, 900))), k) for i, k in enumerate(r.choice(sorted(make)) for _ in range(600))]
    rows += [(9000, None, "xx"), (9001, "", "yy"), (9002, "123 !!", "zz"), (9003, "akotu mire " * 20_000, None), (None, "schprtz weng wengsch", "yy")]
    docs = spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double")
    got = {x.doc_id: x for x in language.language(docs).collect()}
    want = {i: k for i, _, k in rows}
    seen = [x for i, x in got.items() if i is not None and i < 9000 and x.held_out]
    assert len(seen) > 100 and np.mean([x.lang_pred == want[x.doc_id] for x in seen]) > 0.97
    assert all(got[i].lang_pred == "und" for i in (9000, 9001, 9002)) and got[9003].lang_pred == "xx"
    assert all(0 <= x.score <= 1 for x in got.values())
    assert language.language(docs.limit(0)).count() == 0
    assert {x.lang_pred for x in language.language(docs.withColumn("lang", docs["lang"].substr(9, 1)).where("lang IS NULL")).collect()} <= {"und", ""}
