"""A corpus from raw documents to token ids: five stages, each written as Parquet and read again.

Every stage works on all rows that the stage before it kept. Rules, fingerprints and the secret model
are learned or computed on all of a stage's own input; ``labels`` and ``benchmark`` come from the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volumetry.llm import bpe, decontam, near, rules, secret
from volumetry.llm.queries import table, word_vocabulary
from volumetry.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    learned = rules.fit(rules.labelled(docs, table(spark, sf_dir, "labels"), sample=None))
    return rules.judged(docs, learned).where("kept").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class stays; classes link at 0.8 of five-word shingles,
    by SimHash fingerprints first and by MinHash bands what these don't reach."""
    return near.one_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets become a mark, and ``n_chars`` counts the new text."""
    out = secret.redacted(docs, secret.train(docs, sample=None))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the text of their tokens."""
    out = bpe.round_trip(docs, word_vocabulary(), keep=["doc_id", "lang", "source", "n_chars"])
    return out.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_rules", quality), ("simhash_dedup", near_duplicates), ("decontamination", decontaminate),
          ("secret_scan", secrets), ("bpe", tokens)]

# The learned rules, fingerprints and Markov models have no SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
