import numpy as np
import pytest

from pyspark.sql import functions as F

from textloom.operators import chunking


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts(df):
    return [r["text"] for r in df.orderBy("doc_id", "chunk_order").collect()]


def test_fixed(spark):
    assert texts(chunking.fixed(docs(spark, "a b c d e"), 3)) == ["a b c", "d e"]
    assert texts(chunking.fixed(docs(spark, "a b c d e"), 3, 1)) == ["a b c", "c d e"]
    assert texts(chunking.fixed(docs(spark, " a\n b ", None, ""), 3)) == ["a\n b"]


def test_sentences(spark):
    rows = chunking.segments(docs(spark, "One two. Three 1.5 four!  Five")).orderBy("pos").collect()
    assert [r["text"] for r in rows] == ["One two.", "Three 1.5 four!", "Five"]


def test_sentence_pack(spark):
    rows = chunking.sentence_fixed(docs(spark, "one two. three four. five."), 4).orderBy("chunk_order").collect()
    assert [r["token_count"] for r in rows] == [4, 1]
    rows = chunking.sentence_fixed(docs(spark, "a b c d e. f"), 2).orderBy("chunk_order").collect()
    assert [(r["text"], r["token_count"]) for r in rows] == [("a b", 2), ("c d", 2), ("e. f", 2)]


def test_local_minima(spark):
    d = docs(spark, "A.  B. C.")
    fixed = lambda d, context: chunking.segmented(d).withColumn("scores", F.array(F.lit(1.0), F.lit(0.1), F.lit(1.0)))
    assert texts(chunking.perplexity_chunks(d, 0.5, scorer=fixed)) == ["A.  B.", "C."]


def test_chunks_are_slices(spark):
    body = "One a.\n\nTwo b.  Three\u00a0c. "
    assert texts(chunking.perplexity_chunks(docs(spark, body), context="none")) == [body.strip()]
    rows = chunking.segments(docs(spark, body)).orderBy("pos").collect()
    assert all(body[r["start"] : r["end"]] == r["text"] for r in rows) and [r["token_count"] for r in rows] == [2, 2, 2]
    assert texts(chunking.fixed(docs(spark, "a\u00a0b c"), 2)) == ["a\u00a0b", "c"]


def test_scores_by_context(spark):
    none = lambda s: F.transform(s, lambda x: F.lit(0.0))
    d = docs(spark, "a b. c d. a b. d e.")
    got = {c: chunking.scored_segments(d, c, none).first()["scores"] for c in chunking.POLICIES}
    assert got == {"all_previous_segments": [1.0, 1.0, 0.0, 1.0], "previous_segment": [1.0] * 4, "none": [1.0] * 4}
    with pytest.raises(ValueError, match="context policy"):
        chunking.scored_segments(d, "all")


def test_thresholds(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 10.0],)], "d array<double>")
    say = lambda *how: row.select(chunking.threshold(F.col("d"), *how)).first()[0]
    assert say("percentile", 95.0) == pytest.approx(8.95) and say("absolute", 0.4) == 0.4
    assert say("mean_std", 1.0) == pytest.approx(4 + np.std([1, 2, 3, 10])) and say("mean_iqr", 2.0) == pytest.approx(4 + 2 * 3.0)
    assert say(lambda d: F.array_max(d), 0.0) == 10.0
    with pytest.raises(ValueError, match="policy"):
        say("median", 1.0)


def marked(spark, sizes, cuts):
    sents = [f"s{i}" for i in range(len(sizes))]
    row = (0, sents, [3 * i for i in range(len(sizes))], sizes, [f" {x}" for x in sents], cuts)
    return spark.createDataFrame([row], "doc_id long, sents array<string>, starts array<int>, n array<int>, pieces array<string>, cuts array<boolean>")


def test_merge_keeps_a_small_document(spark):
    m = chunking.merge_and_cap(marked(spark, [4, 5], [True, False]), 32)
    assert texts(chunking.by_boundaries(m, "x")) == ["s0 s1"]


def test_merge_and_cap(spark):
    m = chunking.merge_and_cap(marked(spark, [1, 3, 5, 1], [True, True, True, False]), 3)
    assert texts(chunking.by_boundaries(m, "x")) == ["s0 s1", "s2 s3"]
    m = chunking.merge_and_cap(marked(spark, [1, 1, 1, 1, 1], [False, False, True, False, False]), 0, 2)
    assert texts(chunking.by_boundaries(m, "x")) == ["s0 s1", "s2", "s3 s4"]


def test_linkage():
    d = np.array([[0, 0.9, 0.1], [0.9, 0, 0.8], [0.1, 0.8, 0]])
    assert chunking.link(lambda ids: d[ids], 3, 2) == [[0, 2], [1]]
    assert chunking.link(lambda ids: d[ids], 3, 1, cut=0.5, most=3) == [[0, 2], [1]]
    assert chunking.link(lambda ids: d[ids], 3, 3) == [[0], [1], [2]]
    assert chunking.link(lambda ids: np.zeros((len(ids), 1)), 1, 1) == [[0]]


def plain_linkage(d, clusters, most, cut=None):
    """All pairs of groups, each step."""
    groups = [[i] for i in range(len(d))]
    while len(groups) > clusters:
        pairs = [(min(d[x, y] for x in a for y in b), a[0], b[0], a, b) for n, a in enumerate(groups) for b in groups[n + 1 :] if len(a) + len(b) <= most]
        if not pairs or (cut is not None and min(pairs)[0] > cut):
            break
        _, _, _, a, b = min(pairs)
        groups = sorted([g for g in groups if g not in (a, b)] + [sorted(a + b)])
    return groups


def test_linkage_against_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(150):
        n = int(rng.integers(2, 24))
        d = rng.integers(0, int(rng.choice([3, 12, 1000])), (n, n)).astype(float)  # few values make many ties
        d = np.minimum(d, d.T)
        clusters, most = int(rng.integers(1, n + 1)), int(rng.integers(1, n + 1))
        cut = None if rng.random() < 0.5 else float(np.median(d))
        assert chunking.link(lambda ids, d=d: d[ids], n, clusters, most, cut) == plain_linkage(d, clusters, most, cut)


def test_single_linkage_of_a_long_document(spark):
    """2,500 segments: every one in one cluster, of at most four; without a shuffle."""
    d = docs(spark, " ".join(f"w{i % 7} x{i % 11}." for i in range(2500)), None, "One.")
    got = chunking.single_linkage(d)
    rows = got.where("doc_id = 0").collect()
    assert sorted(p for r in rows for p in r["positions"]) == list(range(2500)) and max(len(r["positions"]) for r in rows) <= 4
    assert [r["text"] for r in got.where("doc_id <> 0").collect()] == ["One."]
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_pairwise_against_brute_force(spark):
    rows = chunking.pairwise_distance(docs(spark, "a b. b c. c d."), 0.5).collect()
    got = {(r["i"], r["j"]): r["distance"] for r in rows}
    assert got[0, 1] == round(0.5 / 3 + 0.5 * (1 - 1 / 2), 6)
    assert got[0, 2] == round(0.5 * 2 / 3 + 0.5, 6)


def test_user_chunks(spark):
    assert texts(chunking.user_chunks(docs(spark, "a-b"), lambda t: t.split("-"))) == ["a", "b"]


def test_segments_once(spark):
    d = docs(spark, "A b c. D e. F! G h? I.")
    for chunks in (chunking.semantic_breakpoint(d), chunking.perplexity_chunks(d), chunking.pic_chunks(d)):
        assert chunks.agg(F.sum("token_count")).first()[0] == 9


def test_pairs_and_small_linkage_without_a_shuffle(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(60):  # few different values: ties
        n, clusters = int(rng.integers(1, 14)), int(rng.integers(1, 5))
        d = rng.integers(0, 5, (n, n)) / 4
        d = np.triu(d, 1) + np.triu(d, 1).T
        most = int(rng.integers(1, 7)) if rng.integers(2) else None
        cut = 0.5 if rng.integers(2) else None
        assert chunking.link_matrix(d, clusters, most, cut) == chunking.link(lambda ids, d=d: d[ids], n, clusters, most, cut)
    docs = spark.createDataFrame([(1, "One two. Two three! ... One two? Four."), (2, "Alone."), (3, None), (4, " ".join(f"Word {i % 3} and {i}." for i in range(30)))], "doc_id long, text string")
    monkeypatch.setattr(chunking, "PAIRS", 50)  # several batches a document
    made = chunking.pairwise_distance(docs)
    assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r["doc_id"], r["i"], r["j"]): r["distance"] for r in made.collect()}
    assert len(got) == 10 + 30 * 29 // 2
    assert got[1, 0, 1] == 0.35 and got[1, 0, 3] == 0.3 and got[1, 0, 2] == 0.7  # the third has no word


def test_linkage_of_ties_against_brute_force():
    def brute(d, clusters):
        most, groups = -(-len(d) // clusters), {i: [i] for i in range(len(d))}
        while len(groups) > clusters:
            best = min(((min(d[a][b] for a in groups[x] for b in groups[y]), x, y) for x in groups for y in groups if x < y and len(groups[x]) + len(groups[y]) <= most), default=None)
            if best is None:
                break
            groups[best[1]] = sorted(groups[best[1]] + groups.pop(best[2]))
        return [groups[k] for k in sorted(groups)]

    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(8, 31))
        d = rng.integers(0, 9, (n, n)) / 8
        d = np.triu(d, 1) + np.triu(d, 1).T
        want = brute(d, -(-n // 4))
        assert chunking.link(lambda ids, d=d: d[ids], n, -(-n // 4)) == want and chunking.link_matrix(d, -(-n // 4)) == want


def test_contract_makes_its_parts_once(spark, tmp_path):
    """The segments that chunks are held against and the fixed chunks are made once for all rules (F5)."""
    from textloom.plans import catalog

    texts = ["One two. Three four five.", "Alone", " ", None] * 3
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalog.advanced_chunk_contract(spark, str(tmp_path))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_sentences(") == 3  # one for each method of chunks
    got = {r["rule"]: r["n"] for r in made.collect()}
    assert got == {"segments lost": 3, "chunks of an unknown document": 1}
    assert {(r.doc_id, r.owed, r.longest) for r in chunking.owed(catalog.docs(spark, str(tmp_path))).collect()} == {(i, *((5, 3), (1, 1))[i % 4]) for i in range(12) if i % 4 < 2}
