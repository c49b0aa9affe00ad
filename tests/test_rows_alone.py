"""Vectors are made within a document's row: neither tokens nor their states are shuffled or joined."""

import re

import numpy as np
import pytest

from textloom.functions import contextual, vectors
from textloom.operators import chunking


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 37}. İx{i % 5}" for i in range(900))
    return spark.createDataFrame([(1, long), (2, " 　one  two\n"), (3, None), (4, ""), (5, "Ab ab")], "doc_id long, text string").repartition(3)


def test_late_pooling_meets_chunks_in_the_row(spark, docs):
    chunks = chunking.late(docs, 64, 16)
    out = vectors.late_pooling(docs, chunks, 32, policy="window")
    assert "Generate" not in plan(out)  # no row a token
    got = {(r["item_id"], r["bucket"]): r["weight"] for r in out.collect()}
    want = {}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for c in chunks.collect():
        assert texts[c["doc_id"]][c["start"] : c["end"]] == c["text"]
        toks = re.findall(r"\S+", c["text"].lower())
        assert len(toks) == c["token_count"]
        cells = np.bincount([(vectors.coded(t) >> 1) % 32 for t in toks], minlength=32).astype(float)
        cells[(vectors.coded(texts[c["doc_id"]].lower()) >> 1) % 32] += len(toks)
        want |= {(c["chunk_id"], int(b)): round(cells[b] / len(toks), 9) for b in np.flatnonzero(cells)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-9 for k in want)
    with pytest.raises(Exception, match="over 100 tokens"):
        vectors.late_pooling(docs, chunks, 32, 100).collect()


def test_signed_vectors_are_made_without_a_shuffle(spark):
    items = spark.createDataFrame([("a", "red red blue"), ("b", None), ("c", "x y")], "item_id string, text string")
    out = vectors.signed_vectors(items, 64, True)
    assert "Exchange" not in plan(out)
    got = {r["item_id"]: np.array(r["vector"]) for r in out.collect()}
    assert not got["b"].any() and not got["c"].any() and abs(np.linalg.norm(got["a"]) - 1) < 1e-12
    want = np.zeros(64)
    for t in ("red", "red", "blue"):
        want[(vectors.coded(t, True) >> 1) % 64] += 1 - 2 * (vectors.coded(t, True) & 1)
    assert np.allclose(got["a"], want / np.linalg.norm(want))


@pytest.mark.parametrize("policy", ["window", "truncate"])
def test_states_are_summed_before_they_are_shuffled(spark, docs, policy):
    chunks = chunking.late(docs, 16) if policy == "window" else chunking.late(docs, 16).where("chunk_order < 2")
    encoder = contextual.hash_encoder(8)
    for normalise in (True, False):
        out = contextual.pooled_states(docs, chunks, encoder, 40, 12, policy, normalise)
        assert "FlatMapGroupsInArrow" not in plan(out)  # no group of a chunk's token states
        got = {r["item_id"]: r["vector"] for r in out.collect()}
        want = {r["item_id"]: r["vector"] for r in contextual.pooled(contextual.states(docs, encoder, 40, 12, policy), chunks, normalise).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(Exception, match="no token inside"):
        contextual.pooled_states(docs, spark.createDataFrame([(5, "x", 0, 1)], "doc_id long, chunk_id string, start int, end int"), encoder, 40, 12, policy).collect()
