from eventspan.llm import bpe, language, media, simhash, toxicity


def test_large_ids_beside_nulls_stay_exact(spark):
    ids = [2**62 + 1, None, -(2**53) - 1]
    docs = spark.createDataFrame([(i, f"some words here {n}", "en") for n, i in enumerate(ids)], "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(2**62 + 1, 0)], "doc_id long, toxic int")
    for out in (bpe.tokenize(docs), language.language(docs), media.media(docs), simhash.near_duplicates(docs), toxicity.toxicity(docs, labels)):
        assert {r.doc_id for r in out.collect()} == set(ids) and dict(out.dtypes)["doc_id"] == "bigint"
