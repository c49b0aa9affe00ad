"""The two-stage experiments on the synthetic data set."""

from dataclasses import replace
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluation, validation
from textloom.plans import hierarchy
from textloom.sources import tables


def test_configuration(monkeypatch):
    assert len(hierarchy.pairs_of_methods()) == 9
    with pytest.raises(ValueError, match="hashed vectors are for smoke runs"):
        hierarchy.config_for("baseline")
    monkeypatch.setitem(hierarchy.ENCODERS, "model", lambda items, c: None)
    c = hierarchy.config_for("baseline", tuned_split="train", encoder="model", datasets=("miracl", "nq_hard"))
    assert (c.document_k, c.passage_k, c.final_k) == (20, 100, 100)
    with pytest.raises(ValueError) as said:
        hierarchy.Config(name=" ", document_k=0, final_k=9, combined="x", fusion="y", document_weight=2.0, tuned_split="test", methods=("a",), mode="full", frozen=False).check()
    assert str(said.value).count(";") == 10
    with pytest.raises(ValueError) as said:
        hierarchy.Config(datasets=("msmarco",), synthetic=True, encoder="none", dense_index="hnsw", sparse_index="tfidf", latency_queries=-1).check()
    assert str(said.value).count(";") == 5
    with pytest.raises(ValueError, match="unknown mode"):
        hierarchy.config_for("tiny")
    assert hierarchy.run_folder(c, commit="0123456789abcdef") == "outputs/two_stage/baseline/0123456789ab"
    assert hierarchy.run_folder(c, datetime(2020, 1, 2, tzinfo=UTC)) == "outputs/two_stage/baseline/20200102T000000Z"


def test_sampling(spark):
    data = tables.synthetic_retrieval(spark)
    one, again = (hierarchy.sampled(data, 2, 7, "test") for _ in range(2))
    ids = {r[0] for r in one.queries.select("query_id").collect()}
    assert len(ids) == 2 and ids == {r[0] for r in again.queries.select("query_id").collect()} == {r[0] for r in one.qrels.select("query_id").collect()}
    assert one.passages.count() == 7 and hierarchy.sampled(data, None, 7).queries.count() == 4
    with pytest.raises(ValueError, match="no queries of split"):
        hierarchy.sampled(data, 2, 7, "train")
    with pytest.raises(KeyError, match="unknown data set"):
        hierarchy.load_dataset(spark, "nothing", "x")


def test_matrix_and_export(spark, tmp_path):
    methods = ("sparse_sparse", "dense_dense", "combined_combined")
    c = hierarchy.Config(methods=methods, fusion="weighted_sum", output=str(tmp_path))
    data = tables.synthetic_retrieval(spark)
    out, folder = hierarchy.run_matrix(spark, [data], c)
    assert [r.status for r in out] == ["completed"] * 3, [r.error for r in out]
    for r in out:
        chosen = {tuple(x) for x in r.documents.select("query_id", "document_id").collect()}
        got = r.passages.collect()
        assert {(x["query_id"], x["document_id"]) for x in got} <= chosen and max(x["passage_rank"] for x in got) <= 5
        assert r.queries.count() == 4 and r.metrics["passage_ndcg@10"] > 0.6 and r.metrics["storage_bytes"] > 0
        times = [x["latency_ms"] for x in r.queries.collect() if x["latency_ms"] is not None]
        assert len(times) == 3 and len(set(times)) == 3 and r.metrics["mean_query_latency_ms"] == pytest.approx(sum(times) / 3)
        assert r.metrics["p50_query_latency_ms"] == pytest.approx(sorted(times)[1]) and r.metrics["p50_query_latency_ms"] < r.metrics["p95_query_latency_ms"] < max(times)
    meta = data.queries.select("query_id", F.lit("cr; MT").alias("question_type"))
    paths = hierarchy.export(spark, out, replace(c, methods=(*methods, "dense_sparse")), folder, meta)
    assert len(paths) == 11
    rows = tables.read_result(spark, f"{folder}/aggregate_metrics.csv")
    assert {r["method"]: r["status"] for r in rows.collect()} == dict.fromkeys(methods, "completed") | {"dense_sparse": "not_run"}
    cats = tables.read_result(spark, f"{folder}/categories.csv").where("category = 'CR'").collect()
    assert [int(r["query_count"]) for r in cats] == [4, 4, 4]
    with pytest.raises(validation.ContractError, match="latency has"):
        hierarchy.checked(meta, "latency")


def test_failures_stay_apart(spark, tmp_path):
    def broken(queries, hits, passages):
        raise RuntimeError("no reranking")

    c = hierarchy.Config(methods=("sparse_sparse",), output=str(tmp_path))
    out, _ = hierarchy.run_matrix(spark, [tables.synthetic_retrieval(spark)], c, broken)
    assert out[0].status == "failed" and "no reranking" in out[0].error
    data = tables.synthetic_retrieval(spark)
    split = replace(data, name="other", queries=data.queries.withColumn("split", F.lit("dev")))
    out, _ = hierarchy.run_matrix(spark, [split, data], replace(c, split="test", latency_queries=0))
    assert [(r.dataset, r.status) for r in out] == [("other", "failed"), ("synthetic", "completed")] and "no queries of split" in out[0].error
    assert out[1].metrics["p95_query_latency_ms"] is None
    with pytest.raises(ValueError, match="budgets"):
        hierarchy.run(spark, tables.synthetic_retrieval(spark), "sparse_sparse", c, str(tmp_path), budgets=(1, 1))


def test_reranker_order_counts(spark):
    s = hierarchy.Retrievers(tables.synthetic_retrieval(spark), hierarchy.Config(final_k=1))
    chosen = s.documents_by("sparse").cache()
    plain = {r["query_id"]: r["passage_id"] for r in s.passages_by("sparse", chosen).collect()}
    back = s.passages_by("sparse", chosen, lambda q, hits, p: hits.withColumn("rank", -F.col("rank")))
    assert all(plain[r["query_id"]] != r["passage_id"] for r in back.collect())


def test_unknown_judged_passage(spark):
    qrels = spark.createDataFrame([("q", "p9", 1.0)], "query_id string, item_id string, relevance double")
    with pytest.raises(Exception, match="unknown: p9"):
        evaluation.document_qrels(qrels, spark.createDataFrame([("p1", "d")], "item_id string, document_id string")).collect()


def test_one_row_a_query(spark):
    """A table that repeats a query is refused by the job that reads the join, whichever side it is."""
    one = spark.createDataFrame([("a", 1), ("b", 2)], "query_id string, x int")
    two = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "query_id string, y int")
    assert evaluation.one_to_one(one, two.where("y < 3"), "query_id", ("left", "right")).count() == 2
    for pair in ((one, two), (two, one)):
        with pytest.raises(Exception, match="repeat query_id b"):
            evaluation.one_to_one(*pair, "query_id", ("these", "those")).collect()


def test_shared_indexes_and_vectors(spark, tmp_path):
    """A second set of retrievers embeds nothing, and finds what plans without a cache find."""
    data, c = tables.synthetic_retrieval(spark), hierarchy.Config(cache=str(tmp_path))
    first, again, plain = hierarchy.Retrievers(data, c), hierarchy.Retrievers(data, c), hierarchy.Retrievers(data, replace(c, cache=None))
    assert first.embedded == 15 and again.embedded == 0
    for kind in ("sparse", "dense", "combined"):
        d = plain.documents_by(kind).cache()
        for made, want in ((again.documents_by(kind), d), (again.passages_by(kind, d), plain.passages_by(kind, d))):
            assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    # other texts only are embedded
    more = replace(data, documents=data.documents.unionByName(data.documents.limit(1).withColumn("document_id", F.lit("d9")).withColumn("text", F.lit("new"))))
    assert hierarchy.Retrievers(more, c).embedded == 1
