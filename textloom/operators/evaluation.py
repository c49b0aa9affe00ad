"""Evidence mapping, the retrieval metrics, statistics of chunks, graded metrics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import settled
from .chunking import kept
from .retrieval import few, parts, small

KS = (3, 5, 10)
BUDGET = 2048
GRAM = 3


def containing(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, start): texts of ``evidence`` that occur word for word in a document, first place.

    The words between a text's first and last stand whole in a document that holds it. Of the runs of up to three of
    them the one in fewest documents names the candidates; only they are compared. Texts of one or two words have no
    such run and are compared with every document, in their own small broadcast."""
    p = F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))
    ev = evidence.select("item_id", "text", p.alias("p")).where(F.length("text") > 0).withColumn("m", F.least(F.lit(GRAM), F.size("p") - 2))
    sizes = sorted(r[0] for r in ev.select("m").distinct().collect())  # few values, none over GRAM
    texts = docs.select("doc_id", T.text_of().alias("body"))
    of_size = lambda m, first, last: F.when(last >= first, F.transform(F.sequence(first, last), lambda i: F.array_join(F.slice("p", i, m), " "))).otherwise(F.array().cast("array<string>"))
    hits = []
    if any(m > 0 for m in sizes):
        own = ev.where("m > 0").select("item_id", "text", F.explode(of_size(F.col("m"), F.lit(2), F.size("p") - F.col("m"))).alias("g"))
        words = docs.select("doc_id", p.alias("p"))
        # documents are cut once: what is found is counted and then read again
        if few(own):
            own = F.broadcast(own)
            found = settled(_runs(words, [r[0] for r in own.select("g").distinct().collect()]).distinct())  # short texts of few items
        else:
            every = F.flatten(F.array(*[of_size(F.lit(m), F.lit(1), F.size("p") - m + 1) for m in sizes if m > 0]))
            grams = kept(words).select("doc_id", F.explode(every).alias("g"))
            found = settled(grams.join(own.select("g").distinct(), "g", "left_semi").distinct())
        held = own.join(found.groupBy("g").agg(F.count("*").alias("n")), "g", "left")
        rarest = held.groupBy("item_id", "text").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("x")).where("x.n > 0").select("item_id", "text", "x.g")
        pairs = found.join(F.broadcast(rarest) if few(ev) else rarest, "g").select("doc_id", "item_id", "text")
        hits.append(texts.join(small(pairs), "doc_id").where(F.col("body").contains(F.col("text"))))
    if any(m <= 0 for m in sizes):
        hits.append(texts.join(small(ev.where("m <= 0").select("item_id", "text").distinct()), F.col("body").contains(F.col("text"))))
    if not hits:
        hits.append(texts.join(ev.select("item_id", "text"), F.lit(False)))
    both = reduce(lambda x, y: x.unionByName(y), [h.select("item_id", "doc_id", "text", "body") for h in hits])
    return both.select("item_id", "doc_id", (F.instr("body", F.col("text")) - 1).alias("start"))


def _runs(words: DataFrame, runs: list[str]) -> DataFrame:
    """(doc_id, g): the ``runs`` of words, joined by a space, that stand in a document's words (doc_id, p), each once.

    Words are numbered, a run is one number made of its words' numbers, and a task looks its own places up among them."""
    vocabulary = sorted({w for g in runs for w in g.split(" ")})
    at, n = {w: i for i, w in enumerate(vocabulary)}, len(vocabulary)
    of_size: dict[int, list] = {}
    for g in runs:
        own = g.split(" ")
        of_size.setdefault(len(own), []).append((reduce(lambda x, w: x * n + at[w], own, 0), g))
    sent = words.sparkSession.sparkContext.broadcast((vocabulary, {m: list(zip(*sorted(x), strict=True)) for m, x in of_size.items()}))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, of_size = sent.value
        known, n = pa.array(vocabulary, pa.string()), len(vocabulary)
        wanted = {m: (np.array(keys, np.int64), pa.array(gs, pa.string())) for m, (keys, gs) in of_size.items()}
        for part in (x for batch in batches for x in parts(batch, 1)):
            word = pc.fill_null(pc.index_in(part.column(1).flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(part.column(1)), 0).to_numpy(zero_copy_only=False))
            for m, (keys, gs) in wanted.items():
                first = np.arange(max(len(word) - m + 1, 0))
                first = first[row[first] == row[first + m - 1]]  # a run lies in one document
                for j in range(m):
                    first = first[word[first + j] >= 0]
                key = reduce(lambda x, j: x * n + word[first + j], range(m), np.zeros(len(first), np.int64))
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = keys[place] == key
                pair = np.unique(row[first[hit]] * len(keys) + place[hit])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(pair // len(keys))), gs.take(pa.array(pair % len(keys)))], names=["doc_id", "g"])

    return words.mapInArrow(find, f"doc_id {words.schema['doc_id'].dataType.simpleString()}, g string")


def coverage(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence (query_id, evidence_id, doc_id, text) onto all chunks of its document: the positions of its tokens that the chunk has."""
    toks = F.array_distinct(T.lexical_tokens(F.col("text")))
    e = evidence.select("query_id", "evidence_id", "doc_id", T.lexical_tokens(F.col("text")).alias("ev"), T.token_count(F.col("text")).alias("ev_count"))
    c = chunks.select("doc_id", "chunk_id", toks.alias("ct"))
    places = F.filter(F.transform("ev", lambda t, i: F.when(F.array_contains("ct", t), i)), lambda i: i.isNotNull())
    return small(e).join(c, "doc_id").select("query_id", "evidence_id", "chunk_id", "ev_count", places.alias("covered"))


def within_budget(hits: DataFrame, budget: int = BUDGET, strict: bool = True) -> DataFrame:
    """Hits (query_id, rank, token_count) until the budget: strict stops before the first overflow."""
    w = W.partitionBy("query_id").orderBy("rank")
    used = F.sum("token_count").over(w.rowsBetween(W.unboundedPreceding, 0))
    return hits.withColumn("used", used).where(F.col("used") <= budget if strict else F.col("used") - F.col("token_count") < budget)


def metrics(queries: DataFrame, evidence: DataFrame, relevant: DataFrame, hits: DataFrame, cover: DataFrame, ks=KS, budget: int = BUDGET) -> DataFrame:
    """One row of all ranked and budget metrics.

    queries (query_id); evidence (query_id, evidence_id, ev_count); relevant (query_id, doc_id);
    hits (query_id, chunk_id, doc_id, rank, token_count, tokens); cover as of ``coverage``. Hits and what they cover
    are written once, as each metric reads them anew."""
    most = max(ks)
    hits = settled(hits.select("query_id", "chunk_id", "doc_id", "rank", "token_count", "tokens"))
    n = queries.agg(F.count("*").alias("n_queries"))
    found = settled(hits.join(cover.select("query_id", "chunk_id", "evidence_id", "ev_count", "covered"), ["query_id", "chunk_id"]))
    in_budget = within_budget(hits, budget, True).select("query_id", "chunk_id", F.lit(True).alias("fits"))
    tokens = found.join(in_budget, ["query_id", "chunk_id"], "left").select("query_id", "evidence_id", "ev_count", "rank", "fits", F.explode("covered").alias("tok"))
    # a token is covered at k if the best rank that covers it is at most k: all k in one pass
    best = tokens.groupBy("query_id", "evidence_id", "ev_count", "tok").agg(F.min("rank").alias("r"), F.coalesce(F.max("fits"), F.lit(False)).alias("fits"))
    at = {f"{k}": F.col("r") <= k for k in ks} | {"b": F.col("fits")}
    per_ev = best.groupBy("query_id", "evidence_id", "ev_count").agg(*[F.sum(c.cast("int")).alias(f"c{k}") for k, c in at.items()])
    all_ev = evidence.select("query_id", "evidence_id", "ev_count").join(per_ev, ["query_id", "evidence_id", "ev_count"], "left")
    c = lambda k: F.coalesce(F.col(f"c{k}"), F.lit(0))
    per_q = all_ev.groupBy("query_id").agg(F.count("*").alias("n_ev"), F.sum("ev_count").alias("tokens"), *[F.sum((c(k) >= F.col("ev_count")).cast("int")).alias(f"full{k}") for k in at], *[F.sum(c(k)).alias(f"cov{k}") for k in at])
    alone = found.where(F.size("covered") >= F.col("ev_count")).groupBy("query_id").agg(F.min("rank").alias("first"))
    rel = relevant.select("query_id", "doc_id").distinct()
    doc_best = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("r"))
    docs = rel.join(doc_best, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.count("*").alias("n_rel"), *[F.sum((F.coalesce("r", F.lit(10**9)) <= k).cast("int")).alias(f"d{k}") for k in ks])
    q = queries.select("query_id").join(per_q, "query_id", "left").join(alone, "query_id", "left").join(docs, "query_id", "left")
    ratio = lambda a, b: F.coalesce(F.avg(F.coalesce(F.col(a) / F.col(b), F.lit(0.0))), F.lit(0.0))
    out = []
    for k in ks:
        out += [
            F.avg((F.coalesce(F.col(f"full{k}"), F.lit(0)) > 0).cast("double")).alias(f"hit_{k}"),
            F.avg(F.when(F.col("first") <= k, 1 / F.col("first")).otherwise(0.0)).alias(f"mrr_{k}"),
            ratio(f"full{k}", "n_ev").alias(f"evidence_recall_macro_{k}"),
            F.coalesce(F.sum(f"full{k}") / F.sum("n_ev"), F.lit(0.0)).alias(f"evidence_recall_micro_{k}"),
            ratio(f"d{k}", "n_rel").alias(f"document_recall_{k}"),
            ratio(f"cov{k}", "tokens").alias(f"evidence_coverage_{k}"),
        ]
    out += [ratio("fullb", "n_ev").alias("evidence_recall_macro_budget"), ratio("covb", "tokens").alias("evidence_coverage_budget")]
    row = q.agg(*out)
    red = reduce(lambda a, b: a.crossJoin(b), [redundancy(hits.where(F.col("rank") <= k)).withColumnRenamed("redundancy", f"redundancy_{k}") for k in ks])  # one row each
    wide = row.crossJoin(red)
    return wide.select(*[F.round(x, 6).alias(x) for x in wide.columns])


def redundancy(hits: DataFrame) -> DataFrame:
    """Mean over queries with hits of the mean Jaccard of their hits' token sets (``tokens``), two at a time."""
    a, b = hits.alias("a"), hits.alias("b")
    both = F.size(F.array_union("a.tokens", "b.tokens"))
    j = F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect("a.tokens", "b.tokens")) / both)
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank"))).groupBy(F.col("a.query_id").alias("query_id")).agg(F.avg(j).alias("j"))  # at most k hits a query
    return hits.select("query_id").distinct().join(pairs, "query_id", "left").agg(F.coalesce(F.avg(F.coalesce("j", F.lit(0.0))), F.lit(0.0)).alias("redundancy"))


def statistics(chunks: DataFrame, scope: str = "within_document") -> DataFrame:
    """Sixteen statistics of chunks (doc_id, text, token_count, is_contiguous)."""
    if scope not in ("within_document", "corpus"):
        raise ValueError(f"unknown duplicate scope {scope!r}")
    key = F.xxhash64(T.squeeze(F.col("text")))
    groups = [key.alias("key")] + ([F.col("doc_id")] if scope == "within_document" else [])
    dup = chunks.groupBy(*groups).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_chunk_count"))
    per_doc = chunks.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.avg("n").alias("chunks_per_doc_mean"), F.percentile("n", 0.5).alias("chunks_per_doc_median"), F.percentile("n", 0.95).alias("chunks_per_doc_p95"))
    t = F.col("token_count")
    over = lambda x: F.avg(F.when(t > x, 100.0).otherwise(0.0))
    sizes = chunks.agg(F.count("*").alias("total_chunks"), F.avg(t).alias("tokens_mean"), F.percentile(t, 0.5).alias("tokens_median"), F.min(t).cast("double").alias("tokens_min"), F.max(t).cast("double").alias("tokens_max"), F.percentile(t, 0.9).alias("tokens_p90"), F.percentile(t, 0.95).alias("tokens_p95"), over(256).alias("pct_over_256"), over(512).alias("pct_over_512"), over(1024).alias("pct_over_1024"), F.avg(F.when(F.col("is_contiguous"), 0.0).otherwise(100.0)).alias("pct_non_contiguous"), F.coalesce(F.sum((F.trim("text") == "").cast("int")), F.lit(0)).alias("empty_chunk_count"))
    wide = sizes.crossJoin(per_doc).crossJoin(dup)  # one row each
    counts = {"total_chunks", "empty_chunk_count", "duplicate_chunk_count"}
    return wide.select(*[F.col(c).cast("long").alias(c) if c in counts else F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in wide.columns])


def graded(qrels: DataFrame, rankings: DataFrame, k: int) -> DataFrame:
    """nDCG and recall at k of every query in ``qrels`` (query_id, item_id, relevance); rankings (query_id, item_id, rank)."""
    gain = lambda rel, rank: (F.pow(F.lit(2.0), rel) - 1) / F.log2(rank + 1)
    ideal_rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance"), "item_id"))
    ideal = qrels.withColumn("ir", ideal_rank).groupBy("query_id").agg(F.sum(F.when(F.col("ir") <= k, gain(F.col("relevance"), F.col("ir"))).otherwise(0.0)).alias("ideal"), F.sum((F.col("relevance") > 0).cast("int")).alias("n_rel"))
    got = qrels.join(rankings.where(F.col("rank") <= k).select("query_id", "item_id", "rank"), ["query_id", "item_id"]).groupBy("query_id").agg(F.sum(gain(F.col("relevance"), F.col("rank"))).alias("dcg"), F.sum((F.col("relevance") > 0).cast("int")).alias("n_got"))
    j = ideal.join(got, "query_id", "left")
    safe = lambda a, b: F.round(F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b)).otherwise(0.0), 6)
    return j.select("query_id", safe("dcg", "ideal").alias("ndcg"), safe("n_got", "n_rel").alias("recall"))


def graded_by_label(items: DataFrame, rankings: DataFrame, k: int, asked) -> DataFrame:
    """``graded`` where each ``asked`` item (item_id, label) is a query and all others of its label are relevant alike.

    The judgements, whose number grows with the square of a label's items, are counted and not made."""
    n = items.where("label IS NOT NULL").groupBy("label").agg((F.count("*") - 1).alias("n_rel")).where("n_rel > 0")
    q = items.where(asked).select(F.col("item_id").alias("query_id"), F.col("label").alias("wanted"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k).cast("long"), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    queries = q.join(n, F.col("wanted") == F.col("label")).select("query_id", "wanted", "n_rel", ideal.alias("ideal"))
    hits = rankings.where((F.col("rank") <= k) & (F.col("query_id") != F.col("item_id"))).select("query_id", "item_id", "rank").join(items, "item_id")
    got = hits.join(q, "query_id").where("label = wanted").groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.count("*").alias("n_got"))
    j = queries.join(got, "query_id", "left")
    share = lambda a, b: F.round(F.coalesce(F.col(a), F.lit(0)) / F.col(b), 6)
    return j.select("query_id", share("dcg", "ideal").alias("ndcg"), share("n_got", "n_rel").alias("recall"))


def rank_methods(results: DataFrame, metric: str) -> DataFrame:
    """method, datasets, mean, place of the methods that completed every data set of ``results`` (dataset, method, status, the metric), the largest mean first."""
    if metric not in results.columns:
        raise KeyError(f"no metric {metric!r}; there are {[c for c in results.columns if c not in ('dataset', 'method', 'status')]}")
    every = results.agg(F.count_distinct("dataset").alias("all_sets"))
    done = results.where("status = 'completed'").groupBy("method").agg(F.count_distinct("dataset").alias("datasets"), F.round(F.avg(metric), 6).alias("mean"))
    whole = done.crossJoin(F.broadcast(every)).where("datasets = all_sets").drop("all_sets")  # one row
    return whole.withColumn("place", F.row_number().over(W.orderBy(F.desc("mean"), "method")))  # a row per method


def unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """``df``, which has one row a ``key``; a second one is raised by whatever job reads the rows.

    Rows are counted within the partitioning by ``key`` that a join by it needs anyway."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    once = F.when(F.col("copies_") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{what} repeat {key} "), F.col(key).cast("string"))).cast("boolean"))
    return df.withColumn("copies_", n).where(once).drop("copies_")


def one_to_one(left: DataFrame, right: DataFrame, key: str, what: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join of two tables that both have one row a ``key``."""
    return unique(left, key, what[0]).join(unique(right, key, what[1]), key, how)


def document_qrels(qrels: DataFrame, passages: DataFrame) -> DataFrame:
    """Largest relevance of a document's passages per query; a judged passage that is unknown is refused."""
    known = qrels.join(passages.select("item_id", "document_id"), "item_id", "left")
    refused = F.raise_error(F.concat(F.lit("judged passage is unknown: "), F.col("item_id"))).cast("string")
    known = known.withColumn("document_id", F.when(F.col("document_id").isNull(), refused).otherwise(F.col("document_id")))
    return known.groupBy("query_id", "document_id").agg(F.max("relevance").alias("relevance"))


def survival(qrels: DataFrame, selected: DataFrame) -> DataFrame:
    """Share of each query's relevant documents that stage one selected."""
    rel = qrels.where(F.col("relevance") > 0).select("query_id", "document_id").distinct()
    sel = selected.select("query_id", "document_id").distinct().withColumn("hit", F.lit(1))
    return rel.join(sel, ["query_id", "document_id"], "left").groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0)).cast("double")), 6).alias("candidate_survival_rate"))


CATEGORIES = ("CR", "MT", "MHR", "AC")


def by_category(per_query: DataFrame, metadata: DataFrame, value: str, categories=CATEGORIES) -> DataFrame:
    """Count and mean of ``value`` overall and per label; a query counts once in each of its labels."""
    spark = per_query.sparkSession
    labels = F.array_distinct(F.split(F.upper("question_type"), r"[,;|\s]+"))
    tagged = per_query.join(metadata, "query_id", "left").select("query_id", value, F.explode(F.array_union(F.array(F.lit("overall")), F.coalesce(labels, F.array().cast("array<string>")))).alias("category"))
    seed = spark.createDataFrame([(c,) for c in ("overall", *categories)], "category string")
    agg = tagged.groupBy("category").agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return seed.join(agg, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean", 6).alias("mean"))
