"""The queries of this package and their SQL."""

from __future__ import annotations

from . import bpe, exact_dedup, language, line_dedup, media, mixing, pii, simhash, toxicity, warc


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_mix(spark, sf_dir):
    return mixing.mix(docs(spark, sf_dir)).drop("text_hash")


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(docs(spark, sf_dir))


def op4_warc(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_line_dedup(spark, sf_dir):
    return line_dedup.report(docs(spark, sf_dir))


def op6_simhash(spark, sf_dir):
    return simhash.near_duplicates(docs(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op7_bpe(spark, sf_dir):
    return bpe.tokenize(docs(spark, sf_dir))


def op8_pii(spark, sf_dir):
    """The key is the session's; this query of synthetic documents has one of its own where none is set."""
    return pii.report(docs(spark, sf_dir), spark.conf.get("spark.eventspan.pii.key", "for synthetic documents only"))


def op9_media(spark, sf_dir):
    return media.media(docs(spark, sf_dir))


def op10_language(spark, sf_dir):
    return language.language(docs(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_mix, op3_exact_dedup, op4_warc, op5_line_dedup, op6_simhash, op7_bpe, op8_pii, op9_media, op10_language)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mix": mixing.SQL, "op3_exact_dedup": exact_dedup.SQL, "op4_warc": warc.SQL}
