"""Contextual encoders, the index and the vector cache, statistics on a stream."""

import os
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.functions import contextual, vectors
from textloom.operators import chunking, retrieval, validation
from textloom.plans import matrix
from textloom.sources import index
from textloom.streaming import stream


@F.arrow_udtf(returnType=contextual.STATES)
class Marked:
    """The state of a token: its window, its place in that, one; a special token of no extent opens every window."""

    def eval(self, batch: pa.RecordBatch):
        for key, window, at, text in zip(*(batch.column(c).to_pylist() for c in ("key", "window", "at", "text")), strict=True):
            rows, place = [(at, at, True, [9.0, 9.0, 9.0])], 0
            for i, word in enumerate(text.split(" ")):
                rows.append((at + place, at + place + len(word), False, [float(window), float(i), 1.0]))
                place += len(word) + 1
            start, end, special, vector = zip(*rows, strict=True)
            yield pa.table({"key": pa.array([key] * len(rows)), "window": pa.array([window] * len(rows), pa.int32()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "special": pa.array(special), "vector": pa.array(vector, pa.list_(pa.float32()))})


def test_windows_are_stitched(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10))), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string")
    got = {(r["key"], r["start"]): r["vector"] for r in contextual.states(docs, Marked, 4, 2, "window").collect()}
    # windows of tokens 0-3, 2-5, 4-7, 6-9: each token has the state of the first that holds it
    assert [got["1", 3 * i][:2] for i in range(10)] == [[0, 0], [0, 1], [0, 2], [0, 3], [1, 2], [1, 3], [2, 2], [2, 3], [3, 2], [3, 3]]
    assert len(got) == 12
    assert contextual.states(docs, Marked, 4, 2, "truncate").count() == 6
    with pytest.raises(Exception, match="over 4 tokens: document 1"):
        contextual.states(docs, Marked, 4, 2).collect()
    with pytest.raises(ValueError, match="unknown policy"):
        contextual.states(docs, Marked, 4, 2, "guess")


def test_pooling_against_a_loop(spark):
    text = " ".join(f"word{i}" for i in range(2000))  # several stretches
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    chunks = chunking.late(docs, 300, 50)
    tokens = contextual.states(docs, Marked, 700, 100, "window").cache()
    states = [(r["start"], r["end"], np.array(r["vector"])) for r in tokens.collect()]
    spans = {r["chunk_id"]: (r["start"], r["end"]) for r in chunks.collect()}
    for normalise in (True, False):
        got = {r["item_id"]: r["vector"] for r in contextual.pooled(tokens, chunks, normalise).collect()}
        for name, (lo, hi) in spans.items():
            want = np.mean([v for s, e, v in states if s >= lo and e <= hi], axis=0)
            assert np.allclose(got[name], want / np.linalg.norm(want) if normalise else want)
    with pytest.raises(Exception, match="no token inside chunk x"):
        contextual.pooled(tokens, spark.createDataFrame([("d", "x", 1, 2)], "doc_id string, chunk_id string, start int, end int")).collect()


def test_late_methods_take_an_encoder(spark):
    matrix.CONTEXT.add("marked", lambda c: Marked)
    bundle = matrix.raw.synthetic(spark)
    m = {"name": "late_fixed_256", "chunk_size": 6, "encoder": "marked", "max_document_tokens": 8, "window_stride": 3, "long_document_policy": "window"}
    chunks = matrix.chunk(bundle, m)
    e = matrix.Experiment("r", [{"name": "synthetic"}], [m], "o")
    assert {len(r["vector"]) for r in matrix.represent(e, bundle, chunks, m).collect()} == {3} and chunks.count() == 7
    with pytest.raises(ValueError, match="not of 'none'"):
        matrix.represent(e, bundle, chunks, m | {"encoder": "none"})


ITEMS = [("a", "d1", "red fish blue fish"), ("b", "d1", "one fish"), ("c", "d2", "two red birds"), ("d", "d2", ""), ("e", "d3", None)]


def test_index_is_the_plain_search(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id string, document_id string, text string")
    queries = spark.createDataFrame([("q1", "red fish"), ("q2", "birds birds"), ("q3", "nothing")], "query_id string, text string")
    within = spark.createDataFrame([("q1", "d1"), ("q2", "d1"), ("q3", "d3")], "query_id string, document_id string")
    made = index.build(items, str(tmp_path), 16)
    for more in ({}, {"within": within}, {"k1": 0.9, "b": 0.1}):
        got, want = (sorted(map(str, df.select("query_id", "item_id", "score", "rank").collect())) for df in (made.search(queries, 3, **more), retrieval.bm25(queries, items, 3, **more)))
        assert got == want
    again = index.build(items, str(tmp_path), 16)
    assert again.path == made.path and len(os.listdir(tmp_path)) == 1
    # the scan of a search has the buckets of its terms as partition filter
    plan = again.search(queries.where("query_id = 'q2'"), 3)._jdf.queryExecution().executedPlan().toString()
    only = spark.sql("SELECT pmod(xxhash64('birds'), 16)").head()[0]
    assert len(made.manifest["postings"]) > 1
    filters = re.findall(r"PartitionFilters: \[[^\]]*bucket#[^\]]*\]", plan)
    assert len(filters) >= 2 and all(re.search(rf"\(bucket#\d+ = {only}\)", f) for f in filters)


def test_an_item_has_one_row_a_bucket(spark, tmp_path):
    made = index.build(spark.createDataFrame([*ITEMS, ("f", "d4", "red red fish two birds one blue red")], "item_id string, document_id string, text string"), str(tmp_path), 2)
    rows = made.bucketed("postings").where("item_id = 'f'").collect()
    assert len(rows) == len({r["bucket"] for r in rows}) <= 2 and {r["dl"] for r in rows} == {8}
    assert {t: n for r in rows for t, n in zip(r["ts"], r["tfs"], strict=True)} == {"red": 3, "fish": 1, "two": 1, "birds": 1, "one": 1, "blue": 1}


def test_broken_index_is_refused(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id string, document_id string, text string")
    made = index.build(items, str(tmp_path), 4)
    some = next(os.path.join(d, f) for d, _, names in os.walk(f"{made.path}/postings") for f in names if f.endswith(".parquet"))
    data = open(some, "rb").read()
    with open(some, "wb") as file:
        file.write(b"no parquet")
    os.remove(os.path.join(os.path.dirname(some), f".{os.path.basename(some)}.crc"))
    with pytest.raises(validation.RunError, match="cannot be read"):
        index.build(items, str(tmp_path), 4)
    os.remove(some)
    with pytest.raises(validation.RunError, match="not what its manifest says"):
        index.open_index(spark, made.path)
    assert index.build(items, str(tmp_path), 4, rebuild=True).search(spark.createDataFrame([("q", "red")], "query_id string, text string"), 1).head()["item_id"] == "c"
    assert data


def test_vectors_are_embedded_once(spark, tmp_path):
    items = spark.createDataFrame([(i, t) for i, _, t in ITEMS] + [("f", "one fish")], "item_id string, text string")
    asked = []

    def embed(df):
        asked.append(sorted(r["text"] for r in df.collect()))
        return vectors.dense(df, 16)

    plain = {r["item_id"]: r["vector"] for r in vectors.dense(items, 16).collect()}
    for n in (4, 0):  # equal texts once; null and empty are one text
        got, new = index.cached_vectors(items, str(tmp_path), "h16", embed)
        assert new == n and {r["item_id"]: r["vector"] for r in got.collect()} == plain
    more = items.unionByName(spark.createDataFrame([("g", "new text")], "item_id string, text string"))
    assert index.cached_vectors(more, str(tmp_path), "h16", embed)[1] == 1 and asked == [["", "one fish", "red fish blue fish", "two red birds"], ["new text"]]
    assert index.cached_vectors(items, str(tmp_path), "another", embed)[1] == 4
    e = matrix.Experiment("r", [{"name": "synthetic"}], [{"name": "fixed_256"}], "o", execution={"vector_cache": str(tmp_path)})
    assert {r["item_id"]: r["vector"] for r in matrix.embedded(e, items).where("item_id = 'b'").collect()}["b"] == vectors.dense(items, 256).where("item_id = 'b'").head()["vector"]


def test_frequencies_on_a_stream(spark, tmp_path):
    """Batches that come again after a failure count once, merged ones too; rows that come too late or twice do not count."""
    at = str(tmp_path / "counts")
    update = stream.keep_vocabulary(at, 2)
    batch = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    assert stream.vocabulary(spark, at).count() == 0
    got = lambda: {r["term"]: (r["df"], r["cf"]) for r in stream.vocabulary(spark, at).collect()}
    update(batch("red red fish", "fish", None), 0)
    update(batch("red red fish", "fish", None), 0)
    assert got() == {"red": (1, 2), "fish": (2, 2)}
    update(batch("blue"), 1)
    update(batch("blue"), 1)  # merged already
    assert got() == {"red": (1, 2), "fish": (2, 2), "blue": (1, 1)} and sorted(os.listdir(at)) == ["upto=1"]
    update(batch("red"), 2)
    assert got()["red"] == (2, 3) and stream.vocabulary(spark, at).where("term = 'blue'").head()["idf"] == pytest.approx(np.log(1 + (5 - 1 + 0.5) / 1.5))
    rows = [[(1, "one", 1000), (2, "two", 5000)], [(1, "one", 1000), (3, "late", 100)], [(4, "four", 6000)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, "doc_id long, text string, at long").selectExpr("doc_id", "text", "timestamp_seconds(at) AS ts").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={i}"))
    for i in range(3):  # a trigger for each
        source = spark.readStream.schema("doc_id long, text string, ts timestamp").option("recursiveFileLookup", True).parquet(str(tmp_path / "in" / f"p={'[0-%d]' % i}"))
        q = stream.once(source, "1000 seconds", "ts").writeStream.foreachBatch(stream.keep_vocabulary(str(tmp_path / "c2"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {r["term"] for r in stream.vocabulary(spark, str(tmp_path / "c2")).collect()} == {"one", "two", "four"}
    assert stream.vocabulary(spark, str(tmp_path / "c2")).where("df > 1").count() == 0
