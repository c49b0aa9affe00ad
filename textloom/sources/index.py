"""A BM25 index on disk: postings bucketed by term, read by the buckets of a query's terms only.

<folder>/bm25-<fingerprint of the items>/ holds ``postings`` (a row per item and bucket) and ``terms`` (Parquet, partitioned by bucket),
``items``, and a manifest written last, with the number of rows of every bucket. An index is found again by its
items' fingerprint; whatever does not agree with its manifest is refused. Scores are made at search, so one
index serves all k1 and b.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import retrieval, validation
from . import tables

VERSION = 2
BUCKETS = 64


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")


def _counts(df: DataFrame) -> dict[str, int]:
    """Rows of each bucket: as many entries as buckets, from the files' footers."""
    return {str(r["bucket"]): r["count"] for r in df.groupBy("bucket").count().collect()}


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    manifest: dict

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def items(self) -> DataFrame:
        return self._table("items")

    def bucketed(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """``postings`` (item_id, dl, ts, tfs and what items carry) or ``terms`` (t, df), of these buckets only."""
        df = self._table(name)
        return df if buckets is None else df.where(F.col("bucket").isin(buckets))

    def search(self, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, within: DataFrame | None = None) -> DataFrame:
        """What ``retrieval.bm25`` finds for ``queries`` in the items of the index."""
        q = retrieval.query_terms(queries)
        vocabulary = q.select("t").distinct()
        # at most as many numbers as the index has buckets
        held = sorted(r[0] for r in vocabulary.select(_bucket(self.manifest["buckets"]).alias("bucket")).distinct().collect())
        rows = self.bucketed("postings", held).drop("bucket")
        if within is not None:  # postings of other documents are left out before they are unpacked
            rows = rows.join(retrieval.of_queries(queries, within.select("document_id").distinct()), "document_id", "left_semi")
        few = retrieval.few(q)
        df = self.bucketed("terms", held).join(F.broadcast(vocabulary) if few else vocabulary, "t", "left_semi").select("t", "df")
        carry = [c for c in rows.columns if c not in ("ts", "tfs")]
        post = rows.select(*carry, F.explode(F.arrays_zip("ts", "tfs")).alias("x")).select(*carry, F.col("x.ts").alias("t"), F.col("x.tfs").alias("tf"))
        post = post.join(F.broadcast(df.select("t")) if few else vocabulary, "t", "left_semi")
        if few and within is None:
            asked = retrieval.Asked(q, b, k1, k)
            said = {r["t"]: r["df"] for r in df.collect()}  # a row a query term
            asked.known(self.manifest["n"], float(self.manifest["avgdl"] or 0), np.array([said.get(t, 0) for t in asked.terms], float))
            own = post.repartition("item_id").groupBy("item_id", "dl").agg(F.collect_list(F.struct("t", "tf")).alias("x"))  # at most the query terms
            best = asked.best(own.select("item_id", "dl", F.col("x.t").alias("ts"), F.col("x.tf").alias("tfs")))
            return retrieval.filled_up(queries, best, self.items(), k, asked.lacking(queries))
        stats = (F.lit(self.manifest["n"]), F.lit(self.manifest["avgdl"]).cast("double"))
        return retrieval.bm25_of(queries, q, post, df, stats, self.items(), k, k1, b, within)


def fingerprint(items: DataFrame) -> str:
    return tables.fingerprint(items, tuple(c for c in ("item_id", "document_id", "text") if c in items.columns), "bm25", VERSION)


def _packed(toks: DataFrame, carry: list[str]) -> DataFrame:
    """Rows (bucket, item_id, what items carry, dl, ts, tfs) of texts (item_id, ts, and bs, each term's bucket): an item's different terms in a bucket, and their counts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for batch in batches for p in retrieval.parts(batch, 0)):
            words = part.column(0).flatten().dictionary_encode()
            code, n = words.indices.to_numpy().astype(np.int64), len(words.dictionary)
            if not n:
                continue
            bucket = np.zeros(n, np.int32)
            bucket[code] = part.column(1).flatten().to_numpy()
            length = pc.list_value_length(part.column(0)).to_numpy()
            key, tf = np.unique(np.repeat(np.arange(part.num_rows), length) * n + code, return_counts=True)
            row, code = key // n, key % n
            order = np.lexsort((row, bucket[code]))
            row, code, tf = row[order], code[order], tf[order]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(bucket[code]) != 0)]))
            ends = pa.array(np.append(first, len(row)).astype(np.int32))
            of = pa.array(row[first])
            cells = [pa.array(bucket[code[first]]), pa.array(length[row[first]].astype(np.int32)), pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([*cells, *[part.column(2 + i).take(of) for i in range(1 + len(carry))]], names=["bucket", "dl", "ts", "tfs", "item_id", *carry])

    kept = "".join(f", {c} string" for c in ("item_id", *carry))
    cast = [F.col(c).cast("string").alias(c) for c in ("item_id", *carry)]
    return toks.select("ts", "bs", *cast).mapInArrow(pack, "bucket int, dl int, ts array<string>, tfs array<int>" + kept)


def build(items: DataFrame, folder: str, buckets: int = BUCKETS, rebuild: bool = False) -> Index:
    """The index of ``items`` (item_id, text; document_id if passages are to be restricted) below ``folder``: opened if it is there, else written."""
    spark, path = items.sparkSession, f"{folder.rstrip('/')}/bm25-{fingerprint(items)}"
    if not rebuild:
        try:
            return open_index(spark, path)
        except FileNotFoundError:
            pass
    carry = [c for c in ("document_id",) if c in items.columns]
    toks = items.select("item_id", *carry, T.terms(T.text_of()).alias("ts"))
    tables.write_table(toks.select("item_id", *carry, F.size("ts").alias("dl")), f"{path}/items")
    # each task writes its items' postings by bucket: no posting is shuffled, and a term of all items is in many files
    post = _packed(toks.withColumn("bs", F.transform("ts", lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))), carry)
    tables.write_table(post, f"{path}/postings", by=("bucket",))
    made = spark.read.parquet(f"{path}/postings")
    tables.write_table(made.select("bucket", F.explode("ts").alias("t")).groupBy("bucket", "t").agg(F.count("*").alias("df")).hint("rebalance", "bucket"), f"{path}/terms", by=("bucket",))
    n, avgdl = spark.read.parquet(f"{path}/items").agg(F.count("*"), F.avg("dl")).head()
    said = {"version": VERSION, "buckets": buckets, "n": n, "avgdl": avgdl, "postings": _counts(made), "terms": _counts(spark.read.parquet(f"{path}/terms"))}
    tables.write_json(spark, f"{path}/manifest.json", said)
    return Index(spark, path, said)


def open_index(spark: SparkSession, path: str) -> Index:
    """The index at ``path``; refused if its files are not those of its manifest."""
    said = tables.read_json(spark, f"{path}/manifest.json")
    index = Index(spark, path, said)
    try:
        sound = said["version"] == VERSION and index.items().count() == said["n"] and all(_counts(index.bucketed(name)) == said[name] for name in ("postings", "terms"))
    except Exception as error:  # files that are gone or no Parquet any more
        raise validation.RunError(f"the index at {path} cannot be read; delete it or rebuild") from error
    if not sound:
        raise validation.RunError(f"the index at {path} is not what its manifest says; delete it or rebuild")
    return index


# --- vectors -------------------------------------------------------------------------------------
def cached_vectors(items: DataFrame, folder: str, encoder: str, embed) -> tuple[DataFrame, int]:
    """(item_id, vector) of ``items`` (item_id, text), and how many texts had to be embedded for it.

    Vectors lie in <folder>/<encoder> under their text's digest, whichever item it came with: only texts that no run
    has embedded go to ``embed`` (items to item_id, vector), each once. ``encoder`` names all that the vectors hang on.
    New vectors are written to a folder of their own name, so a run that is repeated writes it again."""
    spark, root = items.sparkSession, f"{folder.rstrip('/')}/vectors-{encoder}"
    keyed = items.select("item_id", T.text_of().alias("text")).withColumn("digest", F.sha2("text", 256))
    wanted = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    held = _held(spark, root)
    missing = wanted if held is None else wanted.join(held.select("digest"), "digest", "left_anti")
    name = tables.fingerprint(missing, ("digest",))
    n = missing.count()
    if n:
        made = embed(missing.select(F.col("digest").alias("item_id"), "text")).select(F.col("item_id").alias("digest"), "vector")
        tables.write_table(made, f"{root}/part={name}")
        held = _held(spark, root)
    if held is None:  # nothing asked for, nothing there
        return embed(keyed.select("item_id", "text")), 0
    one = held.dropDuplicates(["digest"])  # two runs at once may both have embedded a text
    return keyed.select("item_id", "digest").join(one, "digest").select("item_id", "vector"), n


def _held(spark: SparkSession, root: str) -> DataFrame | None:
    """The parts below ``root`` that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    parts = [f"{root}/{s.getPath().getName()}" for s in fs.listStatus(path) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return spark.read.option("basePath", root).parquet(*parts).select("digest", "vector") if parts else None
