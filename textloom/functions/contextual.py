"""Token states of whole documents by a contextual encoder, and their pooling into chunk vectors.

An encoder is a table function over windows of documents: it takes rows (key, window, at, text), where ``at``
is the place of the window's text in its document, and returns a row per token (key, window, start, end,
special, vector) with places in the document, code points, end exclusive. Anything that maps batches of such
rows can be one (``arrow_udtf``); windows are spread over tasks, so a long document is encoded in parallel.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

STATES = "key string, window int, start int, end int, special boolean, vector array<float>"
POLICIES = ("error", "truncate", "window")
#: Code points by which tokens and chunks are dealt before their places are compared.
STRETCH = 2048
#: So many tokens' buckets an encoder keeps.
KEPT = 1_000_000


def states(docs: DataFrame, encoder, limit: int = 8192, overlap: int = 64, policy: str = "error") -> DataFrame:
    """A row per token of every document (doc_id, text): key (the doc_id as text), start, end, vector.

    Documents of more than ``limit`` white-space tokens are refused, cut there, or (window) read in windows that
    share ``overlap`` tokens, at most all but one; a token that several windows hold keeps the state of the first.
    Special tokens are left out."""
    from ..operators import chunking

    if policy not in POLICIES:
        raise ValueError(f"unknown policy for long documents {policy!r}; there are {POLICIES}")
    shared = min(max(0, overlap), limit - 1) if policy == "window" else 0
    w = chunking.fixed(docs, limit, shared, "window", spans=True)
    if policy == "error":
        within = F.when(F.col("chunk_order") == 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"over {limit} tokens: document "), F.col("doc_id").cast("string"))).cast("boolean"))
        w = w.where(within)
    if policy == "truncate":
        w = w.where("chunk_order = 0")
    rows = encoder(w.select(F.col("doc_id").cast("string").alias("key"), F.col("chunk_order").alias("window"), F.col("start").alias("at"), "text").asTable())
    said = rows.where("NOT special").select("key", "start", "end", "window", "vector")
    if policy != "window":
        return said.drop("window")
    return said.groupBy("key", "start", "end").agg(F.min_by("vector", "window").alias("vector"))


def pooled(tokens: DataFrame, chunks: DataFrame, normalise: bool = True) -> DataFrame:
    """(item_id, vector) of chunks (doc_id, chunk_id, start, end): the mean of the states whose tokens lie inside.

    Tokens and chunks meet by stretch of the document, so a long one is no single key; a group has one chunk's tokens.
    A chunk without a token is refused. Unit length unless ``normalise`` is off; a mean of zeros stays as it is."""

    def mean(group: pa.Table) -> pa.Table:
        lists = group.column("vector").combine_chunks()
        made = lists.flatten().to_numpy().reshape(len(lists), -1).astype(np.float64).mean(axis=0)
        size = np.linalg.norm(made)
        made = made / size if normalise and size > 0 else made
        return pa.table({"item_id": group.column("item_id")[:1], "vector": pa.array([made], pa.list_(pa.float64()))})

    spans = chunks.select(F.col("doc_id").cast("string").alias("key"), F.col("chunk_id").alias("item_id"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    dealt = spans.withColumn("stretch", F.explode(F.sequence((F.col("c_start") / STRETCH).cast("int"), (F.greatest(F.col("c_start"), F.col("c_end") - 1) / STRETCH).cast("int"))))
    inside = tokens.withColumn("stretch", (F.col("start") / STRETCH).cast("int")).join(dealt, ["key", "stretch"]).where("start >= c_start AND end <= c_end")
    means = inside.select("item_id", "vector").groupBy("item_id").applyInArrow(mean, "item_id string, vector array<double>")
    whole = chunks.select(F.col("chunk_id").alias("item_id")).join(means, "item_id", "left")
    lost = F.raise_error(F.concat(F.lit("no token inside chunk "), F.col("item_id"))).cast("array<double>")
    return whole.select("item_id", F.when(F.col("vector").isNull(), lost).otherwise(F.col("vector")).alias("vector"))


def pooled_states(docs: DataFrame, chunks: DataFrame, encoder, limit: int = 8192, overlap: int = 64, policy: str = "error", normalise: bool = True) -> DataFrame:
    """``pooled`` of ``states`` without a shuffle of token states: (item_id, vector) of chunks (doc_id, chunk_id, start, end).

    A window's key tells the encoder's rows which chunks meet the window and where the window before it ended: what lies
    wholly before that end is that window's. Each task sums the states of its tokens by chunk, and the sums are shuffled."""
    from ..operators import chunking

    if policy not in POLICIES:
        raise ValueError(f"unknown policy for long documents {policy!r}; there are {POLICIES}")
    shared = min(max(0, overlap), limit - 1) if policy == "window" else 0
    spans = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("chunk_id").cast("string").alias("id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("spans"))
    both = docs.select("doc_id", T.text_of().alias("text")).join(spans, "doc_id", "left").select(F.col("doc_id").cast("string"), "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for doc, text, own in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py() or ""
                start, end, _ = chunking.window_places(chunking.places(text), limit, shared)
                if policy == "error" and len(start) > 1:
                    raise ValueError(f"over {limit} tokens: document {doc.as_py()}")
                if not own.is_valid or not len(start):
                    continue
                ids, first, last = (own.values.field(i) for i in range(3))
                first, last = first.to_numpy(), last.to_numpy()
                for i in range(1 if policy == "truncate" else len(start)):
                    met = np.flatnonzero((first < end[i]) & (last > start[i]))
                    before = int(end[i - 1]) if i else 0
                    key = json.dumps([before, [[ids[int(c)].as_py(), int(first[c]), int(last[c])] for c in met]])
                    rows.append((key, i, int(start[i]), text[start[i] : end[i]]))
                    if len(rows) >= 256:
                        yield windows(rows)
                        rows = []
        if rows:
            yield windows(rows)

    def windows(rows: list) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "window", "at", "text"])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            code, start, end = keys.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            state = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            order = np.argsort(code, kind="stable")
            upto = np.searchsorted(code[order], np.arange(len(keys.dictionary) + 1))
            sums: dict[str, list] = {}
            for i, key in enumerate(keys.dictionary.to_pylist()):
                before, met = json.loads(key)
                mine = order[upto[i] : upto[i + 1]]
                mine = mine[end[mine] > before]
                for item, lo, hi in met:
                    inside = mine[(start[mine] >= lo) & (end[mine] <= hi)]
                    if len(inside):
                        n, total = sums.get(item, (0, 0.0))
                        sums[item] = (n + len(inside), total + state[inside].sum(axis=0, dtype=np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([t for _, t in sums.values()], pa.list_(pa.float64()))], names=["item_id", "n", "total"])

    rows = encoder(both.mapInArrow(cut, "key string, window int, at int, text string").asTable())
    sums = rows.where("NOT special").select("key", "start", "end", "vector").mapInArrow(pool, "item_id string, n long, total array<double>")
    whole = sums.groupBy("item_id").agg(F.sum("n").alias("n"), F.collect_list("total").alias("ts"))  # a chunk's sums of some batches
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = F.aggregate(F.slice("ts", 2, F.size("ts")), F.col("ts")[0], add)
    mean = chunking.kept(whole.select("item_id", "n", total.alias("t"))).select("item_id", F.transform("t", lambda x: x / F.col("n")).alias("m"))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    mean = chunking.kept(mean.select("item_id", "m", (size if normalise else F.lit(1.0)).alias("size")))
    means = mean.select("item_id", F.transform("m", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(x)).alias("vector"))
    all_chunks = chunks.select(F.col("chunk_id").cast("string").alias("item_id")).join(means, "item_id", "left")
    lost = F.raise_error(F.concat(F.lit("no token inside chunk "), F.col("item_id"))).cast("array<double>")
    return all_chunks.select("item_id", F.when(F.col("vector").isNull(), lost).otherwise(F.col("vector")).alias("vector"))


def hash_encoder(dim: int = 256):
    """A small deterministic encoder: one at the bucket of the token plus one at that of its whole window, by md5 of lower-cased text.

    It stands for a model wherever results must be followed by other means: a token's state hangs on its window."""

    def bucket(text: str) -> int:
        return int(hashlib.md5(text.lower().encode()).hexdigest()[:15], 16) % dim

    @F.arrow_udtf(returnType=STATES)
    class Encoder:
        def __init__(self):
            self.known: dict[str, int] = {}

        def of(self, token: str) -> int:
            if token not in self.known:
                if len(self.known) > KEPT:
                    self.known.clear()
                self.known[token] = bucket(token)
            return self.known[token]

        def eval(self, batch: pa.RecordBatch):
            for key, window, at, text in zip(*(batch.column(c).to_pylist() for c in ("key", "window", "at", "text")), strict=True):
                found = [(m.start(), m.end(), m.group()) for m in re.finditer(T.TOKEN, text)]
                if not found:
                    continue
                vectors = np.zeros((len(found), dim), np.float32)
                vectors[np.arange(len(found)), [self.of(t) for _, _, t in found]] = 1
                vectors[:, bucket(text)] += 1
                places = at + np.array([f[:2] for f in found], np.int32)
                offsets = pa.array(np.arange(0, vectors.size + 1, dim, dtype=np.int32))
                n = len(found)
                yield pa.table({"key": pa.array([key] * n, pa.string()), "window": pa.array(np.full(n, window, np.int32)), "start": pa.array(places[:, 0]), "end": pa.array(places[:, 1]), "special": pa.array(np.zeros(n, bool)), "vector": pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))})

    return Encoder
