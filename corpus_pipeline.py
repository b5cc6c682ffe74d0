"""A training corpus from `documents`, stage by stage: toxic documents go, repeated runs of lines go, one document of each group
of near duplicates stays, sources are mixed to their target weights, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventspan.llm import bpe, line_dedup, mixing, simhash, toxicity
from eventspan.llm.common import drop_path, scratch


def count_chars(docs: DataFrame) -> DataFrame:
    """n_chars as it is now, where the documents have that column."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Learns from all labelled documents, within the fit's bounds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(toxicity.training_rows(docs, labels, F.lit(True))))


def drop_repeated_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines of 50 words or more that stood in an earlier document go; every document stays."""
    return count_chars(line_dedup.line_dedup(docs).select(docs.columns)).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with the
    smallest id stays. Links of SimHash fingerprints are checked for that similarity, and those that fingerprints miss are added."""
    return simhash.drop_near_duplicates(docs, words=5, similarity=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a row for each time."""
    return count_chars(mixing.apply_mix(docs)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids of every row."""
    return bpe.tokenize(docs, with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_runs),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The stages' results rest on a trained model, on XXH64 fingerprints and on BPE: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's output is written to the shared folder; what it was made of, its input included, is removed then. Empty tables
    go through all stages; nulls, ties and repeated rows: see the operators."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as made:
            docs = made.keep(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_path(spark, before)
        before = made.kept[-1]
    return STAGES[-1][1](spark, docs, sf_dir)
