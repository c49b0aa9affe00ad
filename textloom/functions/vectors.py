"""Hash embeddings and late pooling. Tokens are hashed once each: over the vocabulary, not the text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from . import text as T


def _low(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"t": pdf["t"], "low": [int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest()[:4], "little") for t in pdf["t"]]})


def token_hashes(tokens: DataFrame) -> DataFrame:
    """(t, low): the low 32 bits of the 64-bit little-endian blake2b hash of each different token."""
    return tokens.select("t").distinct().mapInPandas(_low, "t string, low long")


def hashing(items: DataFrame, dim: int = 256) -> DataFrame:
    """Sparse count vectors of lexical tokens: item_id, bucket, count. ``dim`` is a power of two."""
    if 2**32 % dim:
        raise ValueError("dim must be a power of two")
    toks = items.select("item_id", F.explode(T.lexical_tokens(T.text_of())).alias("t")).groupBy("item_id", "t").agg(F.count("*").alias("c"))
    return toks.join(token_hashes(toks), "t").groupBy("item_id", F.pmod("low", F.lit(dim)).cast("int").alias("bucket")).agg(F.sum("c").alias("count"))


#: So many tokens' hashes a task keeps, and so many pooled rows it holds at once.
KEPT, ROWS = 1_000_000, 500_000


def coded(token: str, native: bool = False) -> int:
    """Twice the hash of a token (blake2b, or the engine's own md5), and one more if its sign is negative."""
    if native:
        made = hashlib.md5(token.encode()).hexdigest()
        return 2 * int(made[:15], 16) + (made[15] >= "8")
    low = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest()[:4], "little")
    return 2 * low + ((low >> 8) & 1 == 0)


def coder(native: bool = False) -> Callable[[list[str]], np.ndarray]:
    """``coded`` of lists of tokens, each different one hashed once while it is kept."""
    known: dict[str, int] = {}

    def of(tokens: list[str]) -> np.ndarray:
        if len(known) > KEPT:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = coded(t, native)
        return np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))

    return of


def signed_vectors(items: DataFrame, dim: int = 512, native: bool = False) -> DataFrame:
    """Terms with a sign from the hash, unit length: item_id, vector. An item is one row and makes its vector itself: nothing is shuffled."""
    from ..operators.retrieval import AT_ONCE, parts

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coder(native)
        for part in (p for batch in batches for p in parts(batch, 1, AT_ONCE)):
            for at in range(0, part.num_rows, max(1, AT_ONCE // dim)):
                own = part.slice(at, max(1, AT_ONCE // dim))
                n, lists = own.num_rows, own.column(1)
                words = lists.flatten().dictionary_encode()
                code = codes(words.dictionary.to_pylist())[words.indices.to_numpy()]
                row = np.repeat(np.arange(n), lists.value_lengths().to_numpy(zero_copy_only=False))
                out = np.bincount(row * dim + (code >> 1) % dim, weights=1.0 - 2 * (code & 1), minlength=n * dim).astype(float).reshape(n, dim)
                out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)
                offsets = pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([own.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["item_id", "vector"])

    cut = items.select(F.col("item_id").cast("string").alias("item_id"), T.terms(T.text_of()).alias("ts"))
    return cut.mapInArrow(make, "item_id string, vector array<double>")


def signed_hashing(items: DataFrame, dim: int = 512, native: bool = False) -> DataFrame:
    """Rows of ``signed_vectors`` that are not zero: item_id, bucket, weight."""
    return signed_vectors(items, dim, native).select("item_id", F.posexplode("vector").alias("bucket", "weight")).where("weight <> 0")


def filled(items: DataFrame, sparse: DataFrame, dim: int, weight: str = "weight") -> DataFrame:
    """Sparse rows (item_id, bucket, weight) as one vector per row of ``items`` (item_id); items without rows have zeros."""
    held = sparse.groupBy("item_id").agg(F.collect_list(F.struct("bucket", F.col(weight).cast("double").alias("w"))).alias("m"))  # at most dim buckets
    rows = items.select("item_id").join(held, "item_id", "left")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            out = np.zeros((batch.num_rows, dim))
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            out[row, flat.field(0).to_numpy()] = flat.field(1).to_numpy()
            offsets = pa.array(np.arange(0, out.size + 1, dim, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["item_id", "vector"])

    return rows.mapInArrow(spread, "item_id string, vector array<double>")


def late_pooling(docs: DataFrame, chunks: DataFrame, dim: int = 256, limit: int = 8192, policy: str = "error", native: bool = False) -> DataFrame:
    """Chunk vectors pooled from token vectors that know their document: item_id, bucket, weight.

    The mean over the document's tokens inside a chunk's span (doc_id, chunk_id, start, end) of onehot(token) +
    onehot(document). Documents over ``limit`` tokens are refused, cut there, or (window) read whole. A chunk without
    a token inside is refused."""
    if policy not in ("error", "truncate", "window"):
        raise ValueError(f"unknown policy for long documents {policy!r}")
    whole = docs.select("doc_id", T.text_of().alias("text"), F.lower(T.text_of()).alias("low"))
    spans = chunks.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("chunk_id").cast("string").alias("id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("spans"))
    both = whole.join(spans, "doc_id", "full").select(F.col("doc_id").cast("string"), "text", "low", "spans")  # texts meet their spans once, tokens meet chunks in the row

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, token = coder(native), re.compile(T.TOKEN)
        held, rows = [], 0
        for batch in batches:
            for doc, text, low, own in zip(*(batch.column(i) for i in range(4)), strict=True):
                doc, text, low = doc.as_py(), text.as_py() or "", low.as_py() or ""
                places = np.array([m.span() for m in token.finditer(text)], np.int64).reshape(-1, 2)
                if policy == "error" and len(places) > limit:
                    raise ValueError(f"over {limit} tokens: document {doc}")
                if not own.is_valid:
                    continue
                places = places if policy == "window" else places[:limit]
                bucket = (codes(token.findall(low)[: len(places)]) >> 1) % dim
                ids, start, end = (own.values.field(i) for i in range(3))
                # a chunk's tokens follow each other
                first = np.searchsorted(places[:, 0], start.to_numpy())
                n = np.searchsorted(places[:, 1], end.to_numpy(), "right") - first
                if (n <= 0).any():
                    raise ValueError(f"no token inside chunk {ids[int(np.argmin(n))].as_py()}")
                step = max(1, ROWS // dim)
                for at in range(0, len(ids), step):
                    size = n[at : at + step]
                    of = np.repeat(np.arange(len(size)), size)
                    tok = np.repeat(first[at : at + step] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    w = np.bincount(of * dim + bucket[tok], minlength=len(size) * dim)
                    w[np.arange(len(size)) * dim + (coded(low, native) >> 1) % dim] += size
                    cell = np.flatnonzero(w)
                    held.append((ids.take(pa.array(at + cell // dim)), (cell % dim).astype(np.int32), w[cell].astype(float), size[cell // dim].astype(float)))
                    rows += len(cell)
                    if rows > ROWS:
                        yield _weights(held)
                        held, rows = [], 0
        if held:
            yield _weights(held)

    return both.mapInArrow(pool, "item_id string, bucket int, w double, n double").select("item_id", "bucket", F.round(F.col("w") / F.col("n"), 9).alias("weight"))


def _weights(held: list) -> pa.RecordBatch:
    ids, bucket, w, n = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(np.concatenate(x)) for x in (bucket, w, n))], names=["item_id", "bucket", "w", "n"])


def late_dense(docs: DataFrame, chunks: DataFrame, dim: int = 256, limit: int = 8192, policy: str = "error", normalise: bool = True) -> DataFrame:
    """Rows of ``late_pooling`` as one vector per chunk, of unit length unless ``normalise`` is off."""
    v = filled(chunks.select(F.col("chunk_id").alias("item_id")), late_pooling(docs, chunks, dim, limit, policy), dim)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return v.select("item_id", F.transform("vector", lambda x: F.when(norm > 0, x / norm).otherwise(x)).alias("vector")) if normalise else v


#: The digest's bytes, its largest value and the scale of the jitter.
JITTER_BYTES, JITTER_MOST, JITTER_SCALE = 2, 65535.0, 1000.0


@F.pandas_udf(ArrayType(DoubleType()))
def blake2b_jitter(sents: pd.Series) -> pd.Series:
    """Each segment's jitter by a 16-bit blake2b hash, for runs that must match others' scores."""
    return sents.map(lambda xs: [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=JITTER_BYTES).digest(), "little") / JITTER_MOST / JITTER_SCALE for x in xs])


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _buckets(tokens: pd.Series, dim: pd.Series) -> pd.Series:
    known: dict[str, int] = {}

    def low(t: str) -> int:
        if t not in known:
            known[t] = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest()[:4], "little")
        return known[t]

    return pd.Series([[[low(t) % n for t in sent] for sent in sents] for sents, n in zip(tokens, dim, strict=True)])


class Blake2bBag:
    """The embedder ``hashing`` for chunkers: the bag of blake2b buckets of each text of an array."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def of_all(self, texts: Column) -> Column:
        return _buckets(F.transform(texts, T.lexical_tokens), F.lit(self.dim))


def dense(items: DataFrame, dim: int = 256) -> DataFrame:
    """Rows of ``hashing`` as one vector per item (item_id, vector); items without tokens have zeros."""
    return filled(items, hashing(items, dim), dim, "count")
