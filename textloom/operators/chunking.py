"""Chunking of documents (doc_id, text) as DataFrame plans.

Chunks have doc_id, chunk_order, chunk_id, text, token_count. Every method
works within one row per document, on arrays, so that no method shuffles; texts are sliced from
the documents' own pieces, gaps between segments included.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.vectors import coder

CHUNK = "doc_id long, chunk_order int, chunk_id string, text string, token_count int"


def _finish(df: DataFrame, method: str, *more: str) -> DataFrame:
    return df.select("doc_id", "chunk_order", F.concat_ws(":", F.col("doc_id").cast("string"), F.lit(method), F.col("chunk_order").cast("string")).alias("chunk_id"), "text", "token_count", *more)


def fixed(docs: DataFrame, size: int, overlap: int = 0, method: str = "fixed", spans: bool = False) -> DataFrame:
    """Windows of ``size`` tokens, each ``size - overlap`` after the last; none lies within the one before.

    With ``spans`` also where they stand in the text: start, end (code points, end exclusive)."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    if spans:
        return _finish(_windows(docs, size, overlap), method, "start", "end")
    p = kept(docs.select("doc_id", T.pieces(T.text_of()).alias("p"))).where(F.size("p") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("p") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    raw = p.select("doc_id", "p", F.transform(starts, lambda s: F.struct(F.array_join(F.slice("p", s + 1, size), "").alias("raw"), F.least(F.lit(size), F.size("p") - s).alias("n"))).alias("ws"))
    w = kept(raw).select("doc_id", F.posexplode("ws").alias("chunk_order", "w"))
    return _finish(w.select("doc_id", "chunk_order", T.lstrip(F.col("w.raw")).alias("text"), F.col("w.n").alias("token_count")), method)


def places(text: str) -> np.ndarray:
    """(start, end) of the white-space tokens of a text."""
    return np.array([m.span() for m in re.finditer(T.TOKEN, text)], np.int64).reshape(-1, 2)


def window_places(at: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of tokens of windows over tokens that stand at ``at``."""
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    first = np.arange(0, max(len(at) - overlap - 1, 0) + 1, size - overlap)
    n = np.minimum(size, len(at) - first)
    return at[first, 0], at[first + n - 1, 1], n


#: So many characters of windows a task holds at once.
CHARS = 4_000_000


def _windows(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows, chars = [], [], 0
            for i, text in enumerate(batch.column(1)):
                text = text.as_py()
                start, end, n = window_places(places(text), size, overlap)
                for at in range(0, len(start), 1024):
                    part = slice(at, at + 1024)
                    held.append((np.arange(at, at + len(start[part])), n[part], start[part], end[part]))
                    texts = [text[x:y] for x, y in zip(start[part].tolist(), end[part].tolist(), strict=True)]
                    rows.append((i, texts))
                    chars += sum(map(len, texts))
                    if chars > CHARS:
                        yield made(batch, rows, held)
                        held, rows, chars = [], [], 0
            if held:
                yield made(batch, rows, held)

    def made(batch: pa.RecordBatch, rows: list, held: list) -> pa.RecordBatch:
        order, n, start, end = (pa.array(np.concatenate(x).astype(np.int32)) for x in zip(*held, strict=True))
        of = pa.array(np.repeat([i for i, _ in rows], [len(t) for _, t in rows]))
        return pa.RecordBatch.from_arrays([batch.column(0).take(of), order, pa.array([t for _, texts in rows for t in texts], pa.string()), n, start, end], names=["doc_id", "chunk_order", "text", "token_count", "start", "end"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", T.text_of().alias("text")).mapInArrow(cut, f"doc_id {kind}, chunk_order int, text string, token_count int, start int, end int")


def kept(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once a row: the optimiser must not copy them into the lambdas that read them."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("row")).select("row.*")


#: So many segments a task works on at once, or one document.
SEGMENTS = 50_000


def _blocks(sizes: np.ndarray, most: int = SEGMENTS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` units together, or of one row."""
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        to = max(int(np.searchsorted(upto, upto[at] + most, "right")) - 1, at + 1)
        yield at, to
        at = to


def _lists(sizes, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


@F.arrow_udf(StructType([StructField(name, ArrayType(kind)) for name, kind in (("sents", StringType()), ("starts", IntegerType()), ("n", IntegerType()), ("pieces", StringType()))]))
def _sentences(texts: pa.Array) -> pa.Array:
    """``SENTENCE_PIECE`` of each text in one pass; white space by Unicode is what Python strips and splits at."""
    find, done = re.compile(T.SENTENCE_PIECE.replace("(?sd)", "(?s)")).findall, []
    lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for at, to in _blocks(lengths, CHARS):
        own = [find(t) for t in texts.slice(at, to - at).to_pylist()]
        sizes, pieces = [len(p) for p in own], [x for p in own for x in p]
        sents = [x.lstrip() for x in pieces]
        size, n = np.fromiter(map(len, pieces), np.int64, len(pieces)), np.fromiter((len(x.split()) for x in sents), np.int32, len(sents))
        upto = np.concatenate([[0], np.cumsum(size)])
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        starts = upto[1:] - np.fromiter(map(len, sents), np.int64, len(sents)) - np.repeat(upto[first[:-1]], sizes)
        columns = (pa.array(sents, pa.string()), pa.array(starts.astype(np.int32)), pa.array(n), pa.array(pieces, pa.string()))
        done.append(pa.StructArray.from_arrays([_lists(sizes, c) for c in columns], names=["sents", "starts", "n", "pieces"]))
    return pa.concat_arrays(done)


def segmented(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, and of its sentences sents, starts (code points), n (tokens), pieces (with the gap before)."""
    return kept(docs.select("doc_id", _sentences(T.text_of()).alias("s"))).where(F.size("s.pieces") > 0).select("doc_id", "s.*")


def segments(docs: DataFrame) -> DataFrame:
    """Sentences in order: doc_id, pos, text, token_count, start, end."""
    one = segmented(docs)
    rows = F.zip_with("sents", "starts", lambda t, b: F.struct(t.alias("text"), b.alias("start")))
    s = one.select("doc_id", F.posexplode(F.zip_with(rows, "n", lambda r, n: F.struct(r["text"].alias("text"), r["start"].alias("start"), n.alias("n")))).alias("pos", "x"))
    return s.select("doc_id", "pos", "x.text", F.col("x.n").alias("token_count"), "x.start", (F.col("x.start") + F.length("x.text")).alias("end"))


def _packed(sizes, most: int):
    """Groups (first, n) of units filled greedily up to ``most``: one fold over the sizes."""
    start = F.struct(F.array().cast("array<struct<first:int,n:int>>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("run"))
    group = lambda acc: F.array(F.struct(acc["first"].alias("first"), acc["run"].alias("n")))

    def step(acc, n):
        full = (acc["run"] > 0) & (acc["run"] + n > most)
        return F.struct(F.when(full, F.concat(acc["done"], group(acc))).otherwise(acc["done"]).alias("done"), F.when(full, acc["first"] + acc["run"]).otherwise(acc["first"]).alias("first"), F.when(full, n).otherwise(acc["run"] + n).alias("run"))

    return F.aggregate(sizes, start, step, lambda acc: F.when(acc["run"] > 0, F.concat(acc["done"], group(acc))).otherwise(acc["done"]))


def sentence_fixed(docs: DataFrame, size: int) -> DataFrame:
    """Sentences packed greedily into chunks of up to ``size`` tokens; longer sentences are cut first."""
    t = T.text_of()
    base = kept(docs.select("doc_id", T.pieces(t).alias("p"), F.transform(T.sentences(t), T.token_count).alias("n"))).where(F.size("p") > 0)
    cut = F.flatten(F.transform("n", lambda n: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.least(F.lit(size), n - i * size))))
    placed = kept(base.select("doc_id", "p", _packed(cut, size).alias("groups")))
    text = lambda g: T.lstrip(F.array_join(F.slice("p", g["first"] + 1, g["n"]), ""))
    w = placed.select("doc_id", F.explode(F.transform("groups", lambda g, i: F.struct(i.alias("i"), g["n"].alias("n"), text(g).alias("text")))).alias("w"))
    return _finish(w.select("doc_id", F.col("w.i").alias("chunk_order"), F.col("w.text").alias("text"), F.col("w.n").alias("token_count")), "sentence")


def by_boundaries(marked: DataFrame, method: str) -> DataFrame:
    """Rows of ``segmented`` with cuts (array: boundary after this segment) to contiguous chunks, slices of the documents."""
    last = F.size("sents") - 1
    at = F.sequence(F.lit(0), last)
    spans = kept(marked).withColumn("firsts", F.filter(at, lambda i: (i == 0) | F.get("cuts", i - 1))).withColumn("lasts", F.filter(at, lambda i: (i == last) | F.get("cuts", i)))
    text = lambda f, z: T.lstrip(F.array_join(F.slice("pieces", f + 1, z - f + 1), ""))
    count = lambda f, z: F.aggregate(F.slice("n", f + 1, z - f + 1), F.lit(0), lambda a, x: a + x)
    # a row has its own text only: the document's pieces end with the explode
    one = lambda f, z: F.struct(text(f, z).alias("text"), count(f, z).alias("token_count"))
    w = kept(spans).select("doc_id", F.posexplode(F.zip_with("firsts", "lasts", one)).alias("chunk_order", "g"))
    return _finish(w.select("doc_id", "chunk_order", "g.text", "g.token_count"), method)


@F.arrow_udf(ArrayType(ArrayType(IntegerType())))
def _native_buckets(tokens: pa.Array, dim: pa.Array) -> pa.Array:
    inner = tokens.flatten()
    words = inner.flatten().dictionary_encode()
    bucket = (coder(True)(words.dictionary.to_pylist()) >> 1) % (dim[0].as_py() if len(dim) else 1)
    return _lists(pc.list_value_length(tokens).to_numpy(zero_copy_only=False), _lists(inner.value_lengths().to_numpy(zero_copy_only=False), pa.array(bucket.astype(np.int32)[words.indices.to_numpy()])))


class NativeBag:
    """The stock embedder: a bag of native hash buckets (``T.bucket``) of each text's lexical tokens."""

    def __init__(self, dim: int = 256):
        self.dim = dim

    def of_all(self, texts):
        return _native_buckets(F.transform(texts, T.lexical_tokens), F.lit(self.dim))

    def __call__(self, text):
        return self.of_all(F.array(text))[0]


def native_bag(dim: int = 256) -> NativeBag:
    return NativeBag(dim)


def _cosines(bags: pa.ListArray, partner: np.ndarray) -> np.ndarray:
    """The cosine of each bag with its ``partner``; 0 if it has none (-1) or one is empty. Counts make exact products."""
    row = np.repeat(np.arange(len(bags)), bags.value_lengths().to_numpy(zero_copy_only=False))
    code = bags.flatten().dictionary_encode()
    width = max(len(code.dictionary), 1)
    key, c = np.unique(row * width + code.indices.to_numpy(), return_counts=True)
    row, c = key // width, c.astype(float)
    norm = np.sqrt(np.bincount(row, c * c, minlength=len(bags)))
    other = partner[row]
    wanted = other * width + key % width
    place = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    both = (other >= 0) & (key[place] == wanted)
    dot = np.bincount(row[both], c[both] * c[place[both]], minlength=len(bags))
    size = np.where(partner >= 0, norm * norm[partner], 0)
    return np.where(size > 0, dot / np.where(size > 0, size, 1), 0.0)


@F.arrow_udf(ArrayType(DoubleType()))
def _next_cosines(bags: pa.Array) -> pa.Array:
    """Of an array of bags: the cosine of each with the next one."""
    sizes, out = pc.list_value_length(bags).to_numpy(zero_copy_only=False), []
    for at, to in _blocks(sizes):
        partner = np.arange(1, sizes[at:to].sum() + 1)
        inner = np.ones(len(partner), bool)
        inner[np.cumsum(sizes[at:to])[sizes[at:to] > 0] - 1] = False
        out.append(_cosines(bags.slice(at, to - at).flatten(), np.where(inner, partner, -1))[inner])
    return _lists(np.maximum(sizes - 1, 0), pa.array(np.concatenate(out)))


@F.arrow_udf(ArrayType(DoubleType()))
def _head_cosines(bags: pa.Array, heads: pa.Array) -> pa.Array:
    """Of an array of bags: the cosine of each with the row's head."""
    sizes, out = pc.list_value_length(bags).to_numpy(zero_copy_only=False), []
    for at, to in _blocks(sizes):
        n = int(sizes[at:to].sum())
        partner = np.concatenate([n + np.repeat(np.arange(to - at), sizes[at:to]), np.full(to - at, -1)])
        out.append(_cosines(pa.concat_arrays([bags.slice(at, to - at).flatten(), heads.slice(at, to - at)]), partner)[:n])
    return _lists(sizes, pa.array(np.concatenate(out)))


def bags(sents, embed):
    """The bags of an array of texts. ``embed`` maps a text Column to a bag, or has ``of_all``, which maps the array (a Python function cannot stand in a lambda)."""
    return embed.of_all(sents) if hasattr(embed, "of_all") else F.transform(sents, embed)


def distances(docs: DataFrame, embed=None) -> DataFrame:
    """Rows of ``segmented`` with d: the cosine distance of each segment to the next, rounded to 9 places; ``embed`` as for ``bags``."""
    embed = embed or native_bag()
    s = kept(segmented(docs).withColumn("c", _next_cosines(bags(F.col("sents"), embed))))
    return kept(s.withColumn("d", F.transform("c", lambda c: F.round(1 - c, 9))).drop("c"))


def adjacent_distances(docs: DataFrame, embed=None) -> DataFrame:
    """doc_id, pos (of the left segment), distance."""
    return distances(docs, embed).select("doc_id", F.posexplode("d").alias("pos", "distance"))


def quantile(values, share: float):
    """Linear interpolation between the sorted values of an array; null if it is empty."""
    v = F.array_sort(values)
    h = (F.size(v) - 1) * F.lit(float(share))
    low = F.floor(h).cast("int")
    a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
    return F.when(F.size(v) > 0, a + (h - low) * (b - a))


def threshold(scores, policy, value: float):
    """The cut-off of an array of scores; null (it cuts nowhere) if that is empty. A policy may be a callable of the array."""
    if callable(policy):
        return policy(scores)
    n = F.size(scores)
    mean = F.when(n > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / n)
    if policy == "percentile":
        return quantile(scores, value / 100)
    if policy == "absolute":
        return F.when(n > 0, F.lit(float(value)))
    if policy == "mean_std":
        return mean + value * F.sqrt(F.aggregate(scores, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n)
    if policy == "mean_iqr":
        return mean + value * (quantile(scores, 0.75) - quantile(scores, 0.25))
    raise ValueError(f"unknown threshold policy {policy!r}")


def semantic_breakpoint(docs: DataFrame, embed=None, policy="percentile", value: float = 90.0, least: int = 32, most: int | None = None) -> DataFrame:
    """Cut where neighbouring segments are farther apart than the document's threshold; groups under ``least`` tokens merge to the right."""
    d = kept(distances(docs, embed).withColumn("limit", F.round(threshold(F.col("d"), policy, value), 9)))
    cuts = F.transform("sents", lambda x, i: F.coalesce(F.get("d", i) > F.col("limit"), F.lit(False)))
    return by_boundaries(merge_and_cap(d.withColumn("cuts", cuts), least, most), "semantic")


@F.arrow_udf(ArrayType(BooleanType()))
def _fitted(sizes: pa.Array, cuts: pa.Array, least: pa.Array, most: pa.Array) -> pa.Array:
    out = []
    for n, cut, low, high in zip(sizes.to_pylist(), cuts.to_pylist(), least.to_pylist(), most.to_pylist(), strict=True):
        if low > 0:
            run, last = 0, -1
            for i, size in enumerate(n):
                run += size
                cut[i] = cut[i] and run >= low
                if cut[i]:
                    run, last = 0, i
            if 0 < run < low and last >= 0:  # a last group that stayed small joins the one before it
                cut[last] = False
        if high and n:
            run, new = n[0], []
            for before, size in zip(cut, n[1:]):  # noqa: B905  what follows the last segment is no boundary
                fresh = before or run + size > high
                new.append(fresh)
                run = size if fresh else run + size
            cut = [*new, False]
        out.append(cut)
    return pa.array(out, pa.list_(pa.bool_()))


def merge_and_cap(marked: DataFrame, least: int = 0, most: int | None = None) -> DataFrame:
    """``cuts`` after merging groups under ``least`` tokens and splitting those over ``most`` between segments."""
    if least <= 0 and not most:
        return marked
    return kept(marked.withColumn("fitted", _fitted("n", "cuts", F.lit(least), F.lit(most or 0))).drop("cuts").withColumnRenamed("fitted", "cuts"))


POLICIES = ("all_previous_segments", "previous_segment", "none")


def native_jitter(sents):
    """A thousandth at most, by each segment's own hash, so that equal shares differ."""
    return F.transform(sents, lambda s: T.bucket(s, 65536) / F.lit(65535.0) / 1000)


@F.arrow_udf(ArrayType(DoubleType()))
def _fresh(sents: pa.Array, context: pa.Array) -> pa.Array:
    """Of an array of segments: the share of each one's different words that its context lacks."""
    sizes, out = pc.list_value_length(sents).to_numpy(zero_copy_only=False), []
    for at, to in _blocks(sizes):
        for own, policy in zip(sents.slice(at, to - at).to_pylist(), context.slice(at, to - at).to_pylist(), strict=True):
            seen: set[str] = set()
            for x in own:
                words = set(x.split())
                out.append(len(words - seen) / len(words) if words else None)
                if policy == "all_previous_segments":
                    seen |= words
                elif policy == "previous_segment":
                    seen = words
    return _lists(sizes, pa.array(out, pa.float64()))


def scored_segments(docs: DataFrame, context: str = "all_previous_segments", jitter=native_jitter) -> DataFrame:
    """Rows of ``segmented`` with scores: the share of each segment's different words that its context lacks, and a jitter."""
    if context not in POLICIES:
        raise ValueError(f"unknown context policy {context!r}; there are {POLICIES}")
    s = kept(segmented(docs).withColumn("share", _fresh(F.transform("sents", F.lower), F.lit(context))).withColumn("jitter", jitter(F.col("sents"))))
    return s.withColumn("scores", F.zip_with("share", "jitter", lambda x, j: F.round(F.coalesce(x + j, F.lit(0.0)), 9))).drop("share", "jitter")


def minima(scored: DataFrame, prominence: float) -> DataFrame:
    """``cuts``: interior minima of ``scores``, lower than before and not above what follows, of that prominence."""
    v = lambda i: F.get("scores", i)
    inner = lambda i: (i > 0) & (v(i) < v(i - 1)) & (v(i) <= v(i + 1)) & (F.greatest(v(i - 1) - v(i), v(i + 1) - v(i)) >= prominence - 1e-12)
    return kept(scored).withColumn("cuts", F.transform("scores", lambda _, i: F.coalesce(inner(i), F.lit(False))))


def perplexity_chunks(docs: DataFrame, prominence: float = 0.05, most: int | None = None, context: str = "all_previous_segments", scorer=None) -> DataFrame:
    """Cut after local minima of the transition scores. ``scorer`` maps (docs, context) to rows of ``segmented`` with scores."""
    return by_boundaries(merge_and_cap(minima((scorer or scored_segments)(docs, context), prominence), 0, most), "ppl")


def lead_summary(most: int = 48):
    """The stock summariser of a text Column: its first ``most`` tokens."""
    return lambda text: F.array_join(F.slice(T.tokens(text), 1, most), " ")


def summary_similarity(docs: DataFrame, embed=None, summarise=None) -> DataFrame:
    """Rows of ``segmented`` with sims: the cosine of each segment with the document's summary, and mean; cuts where their order changes."""
    embed, summarise = embed or native_bag(), summarise or lead_summary()
    heads = docs.select(F.col("doc_id"), "text", bags(F.array(summarise(T.text_of())), embed)[0].alias("head"))
    s = kept(segmented_with(heads, "head").withColumn("c", _head_cosines(bags(F.col("sents"), embed), F.col("head"))))
    s = kept(s.withColumn("sims", F.transform("c", lambda c: F.round(c, 9))).drop("c"))
    s = kept(s.withColumn("mean", F.round(F.aggregate("sims", F.lit(0.0), lambda a, x: a + x) / F.size("sims"), 9)))
    above = lambda i: F.get("sims", i) >= F.col("mean")
    return s.withColumn("cuts", F.transform("sims", lambda _, i: F.coalesce(above(i) != above(i + 1), F.lit(False)))).drop("head")


def segmented_with(docs: DataFrame, *carried: str) -> DataFrame:
    """``segmented`` that carries other columns of ``docs`` along in the row."""
    packed = kept(docs).select(F.struct("doc_id", *carried).alias("doc_id"), "text")
    return segmented(packed).select("doc_id.doc_id", *[F.col(f"doc_id.{c}").alias(c) for c in carried], "sents", "starts", "n", "pieces")


def pic_chunks(docs: DataFrame, embed=None, summarise=None, most: int | None = None) -> DataFrame:
    """Chunks where the sign of (similarity - mean) stays the same."""
    return by_boundaries(merge_and_cap(summary_similarity(docs, embed, summarise), 0, most), "pic")


#: Added before a distance is rounded to 6 places, so that what lies at a half but for the last bits is rounded up.
TIE = 1e-10


def pairwise_distance(docs: DataFrame, weight: float = 0.5, dim: int = 256) -> DataFrame:
    """Of segments i < j of one document: weight * (j - i) / n + (1 - weight) * cosine distance, clipped to [0, 1].

    A document is one row and gives its pairs itself, some segments against all at once: nothing but the pairs grows with their number."""
    bagged = _bagged(docs, dim).select("doc_id", "buckets")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for doc, bags in zip(batch.column(0), batch.column(1), strict=True):
                n, counts, norm = _counts(bags.values, dim)
                at = np.arange(n)
                step = max(1, PAIRS // max(n, 1))
                for lo in range(0, n, step):
                    ids = at[lo : lo + step]
                    size = norm[ids][:, None] * norm
                    cos = np.where(size > 0, 1 - (counts[ids] @ counts.T) / np.where(size > 0, size, 1), 1.0)
                    far = weight * (at - ids[:, None]) / n + (1 - weight) * np.clip(cos, 0, 1) + TIE
                    i, j = np.nonzero(at > ids[:, None])
                    held.append((pa.repeat(doc, len(i)), ids[i].astype(np.int32), j.astype(np.int32), np.floor(far[i, j] * 1e6 + 0.5) / 1e6))
                    rows += len(i)
                    if rows > PAIRS:
                        yield _pair_rows(held)
                        held, rows = [], 0
            if rows:
                yield _pair_rows(held)

    return bagged.mapInArrow(pairs, f"doc_id {bagged.schema['doc_id'].dataType.simpleString()}, i int, j int, distance double")


#: So many pairs of segments a task holds at once.
PAIRS = 500_000


def _pair_rows(held: list) -> pa.RecordBatch:
    doc, i, j, far = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([pa.concat_arrays(doc), pa.array(np.concatenate(i)), pa.array(np.concatenate(j)), pa.array(np.concatenate(far))], names=["doc_id", "i", "j", "distance"])


def _counts(bags: pa.ListArray, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Of a document's bags: their number, their count vectors, and the norms of these."""
    n = len(bags)
    row = np.repeat(np.arange(n), bags.value_lengths().to_numpy(zero_copy_only=False))
    counts = np.bincount(row * dim + bags.flatten().to_numpy(zero_copy_only=False), minlength=n * dim).reshape(n, dim).astype(float)
    return n, counts, np.sqrt((counts * counts).sum(axis=1))


def _bagged(docs: DataFrame, dim: int) -> DataFrame:
    """Rows of ``segmented`` with buckets: the bag of each segment."""
    return kept(segmented(docs)).withColumn("buckets", F.transform("sents", lambda x: F.transform(T.lexical_tokens(x), lambda t: T.bucket(t, dim))))


def link(rows: Callable[[np.ndarray], np.ndarray], n: int, clusters: int, most: int | None = None, cut: float | None = None) -> list[list[int]]:
    """Single linkage of ``n`` units down to ``clusters``: nearest pair first, ties by smallest members; groups over ``most`` are refused.

    ``rows`` gives the distances of some units to all. A group keeps its nearest partner only, and a merged one finds its
    own anew from the rows of its members, so memory is that of ``most`` rows, not of all pairs."""
    most = most or -(-n // max(clusters, 1))
    groups: dict[int, list[int]] = {i: [i] for i in range(n)}  # by least member
    of, size = np.arange(n), np.ones(n, dtype=int)
    value, partner = np.full(n, np.inf), np.full(n, -1)
    sure = np.ones(n, dtype=bool)  # else value is a lower bound only

    def near(g: int) -> np.ndarray:
        """Distances of group ``g`` to the groups that it may join, at their least members."""
        out = np.full(n, np.inf)
        for at in range(0, len(groups[g]), 64):
            np.minimum.at(out, of, rows(np.asarray(groups[g][at : at + 64])).min(axis=0))
        out[g] = np.inf
        out[size + size[g] > most] = np.inf
        return out

    def look(g: int) -> np.ndarray:
        d = near(g)
        partner[g] = int(np.argmin(d))
        value[g], sure[g] = d[partner[g]], True
        return d

    step = max(1, 4_000_000 // max(n, 1))
    for at in range(0, n if most > 1 else 0, step):
        ids = np.arange(at, min(at + step, n))
        d = np.array(rows(ids), dtype=float)
        d[np.arange(len(ids)), ids] = np.inf
        partner[ids] = d.argmin(axis=1)
        value[ids] = d[np.arange(len(ids)), partner[ids]]
    while len(groups) > clusters:
        i = int(np.argmin(value))  # the least members first, as groups sit at their least member
        if not np.isfinite(value[i]) or (cut is not None and value[i] > cut):
            break
        if not sure[i]:
            look(i)
            continue
        j = int(partner[i])
        i, j = min(i, j), max(i, j)
        groups[i] = sorted(groups[i] + groups.pop(j))
        of[groups[i]] = i
        size[i], size[j], value[j] = size[i] + size[j], most, np.inf
        d = look(i)
        # whoever had one of the two as partner has the group now, or must look again if they are too many
        sure[((partner == i) | (partner == j)) & np.isfinite(value)] = False
        # at the value of one that must look again there may be a partner that is less than this one
        better = (d < value) | ((d == value) & sure & (i < partner))
        better &= np.isfinite(d)
        value[better], partner[better], sure[better] = d[better], i, True
        sure[i] = True
    return [groups[k] for k in sorted(groups)]


#: Units up to which all distances are held at once.
MATRIX = 128


def link_matrix(d: np.ndarray, clusters: int, most: int | None = None, cut: float | None = None) -> list[list[int]]:
    """``link`` of few units by the matrix of all their distances: a merged group has the smaller distance of its two."""
    n = len(d)
    most = most or -(-n // max(clusters, 1))
    d, size = np.array(d, dtype=float), np.ones(n, dtype=int)
    groups = {i: [i] for i in range(n)}
    np.fill_diagonal(d, np.inf)
    if most < 2:
        return [groups[i] for i in groups]
    while len(groups) > clusters:
        i, j = divmod(int(d.argmin()), n)  # the least members first; i < j, as distances are symmetric
        if not np.isfinite(d[i, j]) or (cut is not None and d[i, j] > cut):
            break
        groups[i] = sorted(groups[i] + groups.pop(j))
        size[i] += size[j]
        near = np.minimum(d[i], d[j])
        near[(size + size[i] > most) | (np.arange(n) == i) | (np.arange(n) == j)] = np.inf
        d[i], d[:, i], d[j], d[:, j] = near, near, np.inf, np.inf
    return [groups[k] for k in sorted(groups)]


def _linked(bags: pa.ListArray, weight: float, per_cluster: int, dim: int) -> list[list[int]]:
    """Clusters of one document's segments by their bags: counts make exact products, so equal distances are equal."""
    n, counts, norm = _counts(bags, dim)
    norm = np.maximum(norm, 1e-12)
    at = np.arange(n)

    def rows(ids: np.ndarray) -> np.ndarray:
        cos = (counts[ids] @ counts.T) / (norm[ids][:, None] * norm)
        return weight * np.abs(ids[:, None] - at) / n + (1 - weight) * np.clip(1 - cos, 0, 1)

    return link_matrix(rows(at), -(-n // per_cluster)) if n <= MATRIX else link(rows, n, -(-n // per_cluster))


def single_linkage(docs: DataFrame, weight: float = 0.5, segments_per_cluster: int = 4, dim: int = 256) -> DataFrame:
    """Clusters of a document's segments, not always contiguous: doc_id, chunk_order, positions, text, token_count.

    A document is one row, so nothing is shuffled; its memory grows with its segments, not with their pairs."""
    s = _bagged(docs, dim).select("doc_id", "sents", "n", "buckets")
    schema = f"doc_id {s.schema['doc_id'].dataType.simpleString()}, chunk_order int, positions array<int>, text string, token_count int"

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                doc, order, places, texts, tokens = [], [], [], [], []
                for key, sents, sizes, bags in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3), strict=True):
                    groups = _linked(bags.values, weight, segments_per_cluster, dim)
                    doc += [key] * len(groups)
                    order += range(len(groups))
                    places += groups
                    texts += ["\n".join(sents[i] for i in g) for g in groups]
                    tokens += [sum(sizes[i] for i in g) for g in groups]
                yield pa.RecordBatch.from_arrays([pa.array(doc, part.schema.field(0).type), pa.array(order, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(texts, pa.string()), pa.array(tokens, pa.int32())], names=["doc_id", "chunk_order", "positions", "text", "token_count"])

    return s.mapInArrow(cluster, schema)


def late(docs: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """Boundaries of ``fixed`` with their spans; their vectors are pooled later from the whole document's tokens."""
    return fixed(docs, size, overlap, "late", True)


def owed(docs: DataFrame) -> DataFrame:
    """doc_id, owed, longest: the tokens of all segments of a document, and of its longest one."""
    sizes = segmented(docs).select("doc_id", F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("owed"), F.array_max("n").alias("longest"))
    return sizes.groupBy("doc_id").agg(F.sum("owed").alias("owed"), F.max("longest").alias("longest"))


def advanced_violations(docs: DataFrame, chunks: DataFrame, most: int | None = None, segs: DataFrame | None = None) -> DataFrame:
    """(rule, example) where chunks (doc_id, chunk_order, token_count) break what every method owes its document:
    order without holes, every segment's tokens once, and the cap unless a single segment is over it.

    ``segs``: ``owed`` of the documents, where several tables of chunks are held against it."""
    segs = owed(docs) if segs is None else segs
    got = chunks.groupBy(F.col("doc_id").alias("c_doc")).agg(F.count("*").alias("n"), F.min("chunk_order").alias("lo"), F.max("chunk_order").alias("hi"), F.count_distinct("chunk_order").alias("orders"), F.sum("token_count").alias("held"), F.max("token_count").alias("largest"))
    both = segs.join(got, F.col("doc_id") == F.col("c_doc"), "full")
    rules = {
        "chunks of an unknown document": F.col("doc_id").isNull(),
        "chunk orders have holes": (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("orders") != F.col("n")),
        "segments lost": F.coalesce("held", F.lit(0)) < F.col("owed"),
        "segments repeated": F.col("held") > F.col("owed"),
    }
    if most:
        rules["chunks over the cap"] = (F.col("longest") <= most) & (F.col("largest") > most)
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return both.select(F.explode(broken).alias("rule"), F.coalesce("doc_id", "c_doc").cast("string").alias("example"))


def user_chunks(docs: DataFrame, chunk) -> DataFrame:
    """Chunks by a user's Python function text -> list of texts, in batches."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, i, f"{d}:user:{i}", t, len(t.split())) for d, text in zip(pdf["doc_id"], pdf["text"], strict=True) for i, t in enumerate(chunk(text or ""))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_order", "chunk_id", "text", "token_count"])

    return docs.select("doc_id", "text").mapInPandas(read, CHUNK)
