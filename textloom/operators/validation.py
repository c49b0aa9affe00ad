"""Contracts of tables as queries for their violations; a check counts and shows a few, never collects all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class EngineError(Exception):
    """What this engine raises itself."""


class ConfigError(EngineError, ValueError):
    """A configuration breaks a rule."""


class ContractError(EngineError, ValueError):
    """A table breaks a rule; the message names it."""


class SourceError(EngineError, ValueError):
    """A file is not of its format."""


class RunError(EngineError):
    """A run could not end."""


def _rows(df: DataFrame, where, rule: str, example) -> DataFrame:
    return df.where(where).select(F.lit(rule).alias("rule"), F.coalesce(F.col(example).cast("string"), F.lit("null")).alias("example"))


def _repeated(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    return _rows(df.groupBy(*keys).count(), "count > 1", rule, keys[-1])


def _unknown(df: DataFrame, key: str, known: DataFrame, rule: str, known_key: str | None = None) -> DataFrame:
    ids = known.select(F.col(known_key or key).alias("_known")).distinct()
    return _rows(df.select(key).distinct().join(ids, F.col(key) == F.col("_known"), "left_anti"), F.lit(True), rule, key)


def _blank(name: str):
    return ~T.text_of(name).rlike(f"[^{T.SPACE}]")


def span_problem(start, end, text, body):
    """Null if ``body`` holds ``text`` at start:end (anywhere, if there is no span), else what is wrong."""
    inside = (start >= 0) & (end > start) & (end <= F.length(body))
    at = F.when(~inside, "span out of bounds").when(F.substring(body, start + 1, end - start) != text, "another text stands there")
    return F.when(body.isNull(), "no such document").when(start.isNull(), F.when(~body.contains(text), "text is nowhere in it")).otherwise(at)


def mapping(bundle) -> DataFrame:
    """query_id, evidence_id, problem (null where the evidence maps onto its document)."""
    docs = bundle.documents.groupBy(F.col("document_id").alias("_doc")).agg(F.first("text").alias("_body"))
    both = bundle.evidence.join(docs, F.col("document_id") == F.col("_doc"), "left")
    return both.select("query_id", "evidence_id", span_problem(F.col("start"), F.col("end"), F.col("text"), F.col("_body")).alias("problem"))


def diagnostics(bundle) -> DataFrame:
    """One row of counts of a bundle."""
    docs, queries = bundle.documents, bundle.queries
    n = lambda df, key, as_: df.agg(F.count("*").alias(f"{as_}_count"), (F.count("*") - F.count_distinct(key)).alias(f"duplicate_{as_}_count"))
    mapped = mapping(bundle).agg(F.count("*").alias("evidence_count"), F.count_if(F.col("problem").isNull()).alias("evidence_mapping_success_count"), F.count("problem").alias("evidence_mapping_failure_count"))
    asked = queries.select(F.explode("relevant_document_ids").alias("_rel"))
    missing = asked.join(docs.select("document_id").distinct(), F.col("_rel") == F.col("document_id"), "left_anti").agg(F.count("*").alias("missing_relevant_document_count"))
    unanswerable = queries.agg((F.count_if("unanswerable") + int(bundle.metadata.get("excluded_unanswerable_count", 0))).alias("unanswerable_query_count"))
    one = reduce(lambda a, b: a.crossJoin(b), [n(docs, "document_id", "document"), n(queries, "query_id", "query"), mapped, missing, unanswerable])  # rows of one
    return one.withColumn("evidence_mapping_rate", F.when(F.col("evidence_count") == 0, 1.0).otherwise(F.col("evidence_mapping_success_count") / F.col("evidence_count")))


def bundle_violations(bundle) -> DataFrame:
    """(rule, example) of everything that breaks the contract of documents, queries and evidence."""
    d, q, e = bundle.documents, bundle.queries, bundle.evidence
    parts = [
        _repeated(d, "duplicate document ids", "document_id"),
        _repeated(q, "duplicate query ids", "query_id"),
        _repeated(e, "duplicate evidence ids of a query", "query_id", "evidence_id"),
        _rows(d, _blank("text"), "documents without text", "document_id"),
        _rows(q, _blank("text"), "queries without text", "query_id"),
        _unknown(q.select(F.explode("relevant_document_ids").alias("document_id")), "document_id", d, "queries reference unknown documents"),
        _rows(e, _blank("text") | (F.col("token_count") <= 0), "evidence without tokens", "evidence_id"),
        _unknown(e, "document_id", d, "evidence references unknown documents"),
        _unknown(e, "query_id", q, "evidence references unknown queries"),
        _rows(e, F.col("token_count") != T.token_count(F.col("text")), "token counts of evidence", "evidence_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def retrieval_violations(data) -> DataFrame:
    """(rule, example) of everything that breaks the contract of normalised retrieval tables."""
    d, p, q, r = data.documents, data.passages, data.queries, data.qrels
    parts = []
    for df, key in ((d, "document_id"), (p, "passage_id"), (q, "query_id")):
        parts += [_rows(df, F.coalesce(F.col(key), F.lit("")) == "", f"{key} null or empty", key), _repeated(df, f"{key} not unique", key)]
    parts += [
        _unknown(p, "document_id", d, "passages reference unknown documents"),
        _unknown(r, "query_id", q, "qrels reference unknown queries"),
        _unknown(r, "passage_id", p, "qrels reference unknown passages"),
        _repeated(r, "qrels repeat a query and passage", "query_id", "passage_id"),
        _rows(r, "relevance IS NULL OR isnan(relevance) OR relevance < 0", "relevance not a non-negative number", "query_id"),
        _rows(p, "passage_position < 0", "passage_position negative", "passage_id"),
        _rows(q, "query_text IS NULL OR split IS NULL", "queries without text or split", "query_id"),
        _rows(d, "text IS NULL", "documents without text", "document_id"),
        _rows(p, "passage_text IS NULL", "passages without text", "passage_id"),
    ]
    if data.query_metadata is not None:
        parts.append(_unknown(data.query_metadata, "query_id", q, "query_metadata references unknown queries"))
    return reduce(DataFrame.unionByName, parts)


def chunk_violations(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_id, text, token_count): unique ids, counts that agree, text that is not blank."""
    return reduce(DataFrame.unionByName, [_repeated(chunks, "duplicate chunk ids", "chunk_id"), _rows(chunks, _blank("text"), "chunks without text", "chunk_id"), _rows(chunks, F.col("token_count") != T.token_count(F.col("text")), "token counts of chunks", "chunk_id")])


def coverage_violations(covered: DataFrame) -> DataFrame:
    """Coverage rows (evidence_id, covered, ev_count) with positions outside the evidence."""
    return _rows(covered, F.exists("covered", lambda i: (i < 0) | (i >= F.col("ev_count"))), "covered positions out of range", "evidence_id")


def protocol_violations(events: DataFrame, choose_on: tuple[str, ...] = ("ms_marco",), diagnostic: tuple[str, ...] = ("nq_hard",)) -> DataFrame:
    """Events (purpose, dataset, split, uses_labels): choices belong on train and dev of ``choose_on`` only."""
    chosen = events.where(F.col("purpose").isin("tune", "select"))
    bad = ~F.col("dataset").isin(*choose_on) | ~F.col("split").isin("train", "dev")
    return reduce(DataFrame.unionByName, [_rows(chosen, bad, "choices outside the training sets", "dataset"), _rows(chosen, "split = 'test' AND uses_labels", "test labels used in a choice", "dataset"), _rows(chosen, F.col("dataset").isin(*diagnostic), "diagnostic sets used in a choice", "dataset")])


def check(violations: DataFrame) -> None:
    """Raise a ``ContractError`` with each broken rule, its count and two examples."""
    rows = violations.groupBy("rule").agg(F.count("*").alias("n"), F.min("example").alias("least"), F.max("example").alias("most")).orderBy("rule").collect()  # a row per rule
    if rows:
        raise ContractError("; ".join(f"{r.rule}: {r.n} (such as {r.least!r}, {r.most!r})" for r in rows))


def check_mapping(bundle, least: float = 0.95, any_fails: bool = True) -> None:
    row = diagnostics(bundle).head()
    if (any_fails and row.evidence_mapping_failure_count) or row.evidence_mapping_rate < least:
        raise ContractError(f"evidence mapping rate {row.evidence_mapping_rate:.4f}, {row.evidence_mapping_failure_count} failures")


def audit(data) -> DataFrame:
    """One row about normalised retrieval tables."""
    title = F.coalesce(F.trim("title"), F.lit(""))
    docs = data.documents.agg(F.count("*").alias("documents"), F.avg((title == "").cast("double")).alias("missing_title_rate"), F.avg((F.length(title) > 300).cast("double")).alias("noisy_title_rate"))
    passages = data.passages.agg(F.count("*").alias("passages"), (F.count("*") / F.count_distinct("document_id")).alias("mean_passages_per_document"))
    queries = data.queries.agg(F.count("*").alias("queries"), F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"))
    qrels = data.qrels.agg(F.count("*").alias("qrels"), F.coalesce(F.max("relevance") > 1, F.lit(False)).alias("graded_qrels"))
    return reduce(lambda a, b: a.crossJoin(b), [docs, passages, queries, qrels])  # rows of one
