import math

from pyspark.sql import functions as F

from textloom.operators import evaluation, retrieval


def hits(spark, rows):
    return spark.createDataFrame([("q", i, s, r) for i, s, r in rows], "query_id string, item_id string, score double, rank int")


def test_fusion(spark):
    sparse, dense = hits(spark, [("a", 3.0, 1), ("b", 2.0, 2), ("c", 1.0, 3)]), hits(spark, [("b", 0.9, 1), ("c", 0.8, 2), ("d", 0.7, 3)])
    assert [r["item_id"] for r in retrieval.interleave(sparse, dense, 4).orderBy("rank").collect()] == ["a", "b", "c"]
    assert [r["item_id"] for r in retrieval.reciprocal_rank(sparse, dense, 3, 10).orderBy("rank").collect()] == ["b", "c", "a"]


def test_bm25_fills_with_zero_scores(spark):
    q = spark.createDataFrame([("q", "apple"), ("none", "zzz")], "query_id string, text string")
    items = spark.createDataFrame([("10", "pear"), ("2", "apple pie"), ("3", "apple apple")], "item_id string, text string")
    rows = retrieval.bm25(q, items, 3).orderBy("query_id", "rank").collect()
    assert [r["item_id"] for r in rows] == ["10", "2", "3", "3", "2", "10"]
    assert [r["score"] for r in rows[:3]] == [0, 0, 0]


def test_cosine(spark):
    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "item_id string, vector array<double>")
    q = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, vector array<double>")
    assert [r["item_id"] for r in retrieval.cosine_top_k(q, items, 2).orderBy("rank").collect()] == ["a", "c"]
    assert [r["item_id"] for r in retrieval.cosine_top_k(q, items, 2, True).orderBy("rank").collect()] == ["c", "b"]


def test_graded(spark):
    qrels = spark.createDataFrame([("q", "x", 1.0), ("q", "y", 2.0)], "query_id string, item_id string, relevance double")
    ranks = spark.createDataFrame([("q", "x", 1), ("q", "y", 2), ("q", "z", 3)], "query_id string, item_id string, rank int")
    r = evaluation.graded(qrels, ranks, 10).first()
    assert r["ndcg"] == round((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)), 6)
    assert r["recall"] == 1.0
    assert evaluation.graded(qrels, ranks, 1).first()["recall"] == 0.5


def test_budget(spark):
    h = spark.createDataFrame([("q", 1, 2), ("q", 2, 2), ("q", 3, 1)], "query_id string, rank int, token_count int")
    assert [r["rank"] for r in evaluation.within_budget(h, 3).collect()] == [1]
    assert [r["rank"] for r in evaluation.within_budget(h, 3, False).orderBy("rank").collect()] == [1, 2]


def test_containing(spark):
    b = spark.createDataFrame([(1, "two three four five six"), (2, "one")], "item_id long, text string")
    d = spark.createDataFrame([(1, "xtwo three four five sixy"), (2, "none"), (3, None)], "doc_id long, text string")
    assert {(r["item_id"], r["doc_id"], r["start"]) for r in evaluation.containing(b, d).collect()} == {(1, 1, 1), (2, 2, 1)}


def test_categories(spark):
    per = spark.createDataFrame([("a", 1.0), ("b", 0.0)], "query_id string, v double")
    meta = spark.createDataFrame([("a", "cr|MT"), ("b", "MT, mt")], "query_id string, question_type string")
    got = {r["category"]: (r["n"], r["mean"]) for r in evaluation.by_category(per, meta, "v").collect()}
    assert got == {"overall": (2, 0.5), "CR": (1, 1.0), "MT": (2, 0.5), "MHR": (0, None), "AC": (0, None)}


def test_containing_against_brute_force(spark):
    from textloom.operators import evaluation

    bodies = ["the red fox ran over the red hill", "a red  fox ran", "xthe red foxy", "red", "", None, "the red fox the red fox ran over", "the red fox the red fox"]
    texts = ["the red fox", "he red fox ran ov", "red", "d f", "red fox", "the red fox ran over the red hill", " ", "", "fox the red fo", "not there at all", "the red fox ran", "the red fox ran"]
    docs = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    got = sorted(tuple(r) for r in evaluation.containing(items, docs).collect())
    assert got == sorted((i, d, b.find(t)) for i, t in enumerate(texts) if t for d, b in enumerate(bodies) if b and t in b)
    assert evaluation.containing(items.where("false"), docs).count() == 0


def test_bm25_shuffles_no_postings_and_both_ways_agree(spark, monkeypatch):
    import random

    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(f"i{i}", f"d{i % 7}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) if i % 9 else None) for i in range(300)], "item_id string, document_id string, text string").repartition(5)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words) for _ in range(4))) for i in range(20)] + [("none", "")], "query_id string, text string")
    within = spark.createDataFrame([(f"q{i}", f"d{i % 7}") for i in range(20)], "query_id string, document_id string")
    monkeypatch.setattr(retrieval, "AT_ONCE", 500)  # several blocks
    said = lambda df: sorted(map(str, df.select("query_id", "item_id", "score", "rank").collect()))
    few = retrieval.bm25(queries, items, 4)
    assert "hashpartitioning(item_id" not in few._jdf.queryExecution().executedPlan().toString()
    got = [said(few), said(retrieval.bm25(queries, items, 4, within=within))]
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(retrieval, "few", lambda df, rows=0: False)
    assert got == [said(retrieval.bm25(queries, items, 4)), said(retrieval.bm25(queries, items, 4, within=within))]


def test_cosine_in_blocks_against_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (230, 4)).astype(float)  # many ties
    items = spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(v)], "item_id string, vector array<double>").repartition(3)
    q = items.where("item_id % 10 = 0").withColumnRenamed("item_id", "query_id")
    monkeypatch.setattr(retrieval, "AT_ONCE", 100)
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 9)
    want = {(str(a), str(b), r + 1) for a in range(0, 230, 10) for r, b in enumerate(sorted((b for b in range(230) if b != a), key=lambda b: (-s[a, b], str(b)))[:5])}
    assert {(r["query_id"], r["item_id"], r["rank"]) for r in retrieval.cosine_top_k(q, items, 5, True).collect()} == want


def test_graded_by_label_makes_no_judgements(spark):
    from pyspark.sql import functions as F

    items = spark.createDataFrame([("0", 1), ("1", 1), ("2", 2), ("3", None), ("4", 1), ("5", 3)], "item_id string, label int")
    ranks = spark.createDataFrame([("0", "2", 1), ("0", "4", 2), ("2", "0", 1), ("4", "1", 1), ("4", "0", 2)], "query_id string, item_id string, rank int")
    asked = F.col("item_id") % 2 == 0
    qrels = items.where(asked).select(F.col("item_id").alias("query_id"), "label").join(items, "label").where("query_id <> item_id").select("query_id", "item_id", F.lit(1.0).alias("relevance"))
    for k in (1, 2, 10):
        assert sorted(evaluation.graded_by_label(items, ranks, k, asked).collect()) == sorted(evaluation.graded(qrels, ranks, k).collect())


def test_binary_cosine_shuffles_no_terms(spark):
    """Ties by id, queries and items without a term, blocks of one item; the same by the join of more query terms."""
    queries = spark.createDataFrame([("a", "eins zwei zwei drei"), ("b", "!"), ("c", "vier")], "query_id string, text string")
    texts = ["eins zwei", "zwei eins", "", None, "vier vier eins", "sechs"] + ["drei sieben acht"] * 20
    items = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "item_id string, text string").repartition(3)
    want = [("a", "d00", 0.816496581, 1), ("a", "d01", 0.816496581, 2), ("a", "d04", 0.40824829, 3), ("c", "d04", 0.707106781, 1)]
    for most, rows in ((retrieval.AT_ONCE, retrieval.BROADCAST_ROWS), (1, retrieval.BROADCAST_ROWS), (1, 0)):
        was = retrieval.AT_ONCE, retrieval.few.__defaults__
        retrieval.AT_ONCE, retrieval.few.__defaults__ = most, (rows,)
        try:
            got = retrieval.binary_cosine(queries, items, 3)
            assert sorted(tuple(r) for r in got.select("query_id", "item_id", "score", "rank").collect()) == want
            assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (rows == 0)
        finally:
            retrieval.AT_ONCE, retrieval.few.__defaults__ = was


def _counting(spark, df, column):
    """``df`` whose ``column`` counts how many of its rows were made."""
    n = spark.sparkContext.accumulator(0)

    def passed(x):
        n.add(1)
        return x

    return df.withColumn(column, F.udf(passed, df.schema[column].dataType).asNondeterministic()(column)), n


def test_metrics_make_hits_once_and_evidence_is_looked_for_in_two_passes(spark):
    d, n = _counting(spark, spark.createDataFrame([(1, "zz one two three four five yy"), (2, "one two three"), (3, "none of it")], "doc_id long, text string"), "text")
    ev = spark.createDataFrame([(7, "one two three four five")], "item_id long, text string")
    assert [tuple(r) for r in evaluation.containing(ev, d).collect()] == [(7, 1, 3)]
    assert n.value <= 2 * 3  # cut into runs of words, then compared
    hits = spark.createDataFrame([("q", "a:fixed:0", 1, 1, 3, ["x", "y"]), ("q", "a:fixed:1", 1, 2, 3, ["y"])], "query_id string, chunk_id string, doc_id long, rank int, token_count int, tokens array<string>")
    hits, n = _counting(spark, hits, "chunk_id")
    cover = spark.createDataFrame([("q", "e", "a:fixed:0", 2, [0, 1])], "query_id string, evidence_id string, chunk_id string, ev_count int, covered array<int>")
    e = spark.createDataFrame([("q", "e", 2)], "query_id string, evidence_id string, ev_count int")
    got = evaluation.metrics(e.select("query_id"), e, spark.createDataFrame([("q", 1)], "query_id string, doc_id long"), hits, cover).head()
    assert (got["hit_3"], got["mrr_3"], got["redundancy_3"]) == (1.0, 1.0, 0.5)
    assert n.value == 2


def test_runs_of_words_are_found_alike_by_lookup_and_by_join(spark, monkeypatch):
    texts = ["a b c d e f", "c d\te f g", None, "", "x", "b c d", "é b c d e zz", "b c d e b c d e f"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    ev = spark.createDataFrame(list(enumerate(["a b c d e", "b c d", "b c d e", "c d e f", "d e", "q r s t u v", "d e b c d e"])), "item_id long, text string")
    found = lambda: sorted(tuple(r) for r in evaluation.containing(ev, d).collect())
    expected = sorted((i, j, t.find(r["text"])) for i, r in enumerate(ev.collect()) for j, t in enumerate(texts) if t and r["text"] in t)
    assert found() == expected
    monkeypatch.setattr(evaluation, "few", lambda df, rows=0: False)
    assert found() == expected


def test_cosine_by_blocks(spark, monkeypatch):
    """Many queries meet the items by blocks of both, with the same hits (F6); rows without a vector take no part."""
    rows = [(str(i), [float((i * 7 + j * i) % 11) - 5.0 for j in range(8)] if i % 9 else None) for i in range(120)]
    items = spark.createDataFrame(rows, "item_id string, vector array<float>")
    q = items.withColumnRenamed("item_id", "query_id")
    hits = lambda: {(r.query_id, r.rank, r.item_id, r.score) for r in retrieval.cosine_top_k(q, items, 5, True).collect()}
    sent = hits()
    for name, n in (("SENT_QUERIES", 50), ("QUERY_BLOCK", 25), ("TASK_BLOCKS", 2), ("AT_ONCE", 300)):
        monkeypatch.setattr(retrieval, name, n)
    assert hits() == sent and len(sent) == 106 * 5


def test_every_vector_is_a_query(spark, tmp_path):
    from textloom.plans import catalog

    rows = [(i, [float(i), 1.0], i % 2) for i in range(1, 31)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.cosine_embeddings_top10(spark, str(tmp_path)).groupBy("query_id").count().collect()
    assert len(got) == 30 and {r["count"] for r in got} == {10}
