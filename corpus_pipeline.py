"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` applies them in order,
each written as Parquet to the shared folder and read again.

Edge cases of every stage: an empty table stays empty; a null or empty text is kept, as nothing in it can be
judged, and has size 0 in the mix; columns besides doc_id and text pass through whatever their names (the
mix returns its own); texts of any length are read whole. Of rows that share a doc_id each stage says below
what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, mixing, ngram_join, secret_scan, toxicity
from textloom.llm.common import documents, settle, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that are there; those predicted toxic go.

    Each row is judged by its own text; without labels nothing goes."""
    lexicon, curve = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, lexicon, curve)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked on shingles of five words, from a Jaccard of 0.8 on, the smallest doc_id stays.

    Rows that share a doc_id stay or go together, and rows without one all stay; so do documents without a shingle."""
    return ngram_join.keep_one(docs, 5, 80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A doc_id goes with all its rows if one of them holds an item, and so do the rows without a doc_id; null and empty items find nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; n_chars follows.

    Every row stays; equal texts are scanned once and masked alike; a null text stays null."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document.

    A row each, also for rows that share a doc_id; a null source is a source of its own, last in order."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
]
#: The learned and the fitted stages are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
