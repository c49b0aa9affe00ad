"""Streams: the per-document transforms on a stream of documents, corpus statistics kept up to date, windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..sources import tables


def chunk_stream(docs: DataFrame, size: int = 256, late: str | None = None, time: str | None = None) -> DataFrame:
    """Fixed chunks of a stream of documents; with a time column repeated doc_ids within ``late`` are dropped."""
    return chunking.fixed(once(docs, late, time), size)


def once(docs: DataFrame, late: str | None, time: str | None) -> DataFrame:
    """With a time column: repeated doc_ids within ``late`` of each other are dropped, and rows that come later than that."""
    return docs.withWatermark(time, late).dropDuplicatesWithinWatermark(["doc_id"]) if late and time else docs


#: After so many batches their counts are merged into one table.
MERGE_EVERY = 16


def _done(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the tables <folder>/<kind>=<number> that were written to their end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{kind}=")]
    return sorted(int(p.getName().split("=")[1]) for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _merged(spark: SparkSession, folder: str) -> DataFrame | None:
    """(term, df, cf) over all batches so far; the row without a term counts the documents."""
    bases = _done(spark, folder, "upto")
    last = bases[-1] if bases else -1
    parts = [f"{folder}/upto={last}"] if bases else []
    parts += [f"{folder}/batch={i}" for i in _done(spark, folder, "batch") if i > last]
    if not parts:
        return None
    whole = spark.read.schema("term string, df long, cf long").parquet(*parts)
    return whole.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def keep_vocabulary(folder: str, merge_every: int = MERGE_EVERY):
    """A function for ``foreachBatch`` that adds each batch of documents (doc_id, text) to the document frequencies in ``folder``.

    A batch writes a table of its own number: run again after a failure it writes the same table over, so nothing
    counts twice. Every ``merge_every`` batches the tables so far become one, named by the last batch in it, and
    those that it holds are deleted; batches up to its number are not counted beside it."""
    folder = folder.rstrip("/")

    def update(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number <= max(_done(spark, folder, "upto"), default=-1):
            return  # merged before the failure that brought it back
        own = batch.select(T.terms(T.text_of()).alias("ts")).withColumn("doc", F.monotonically_increasing_id())
        # each document counts once without a term, and once for each of its terms
        per_doc = own.select("doc", F.explode(F.concat(F.array(F.lit(None).cast("string")), "ts")).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("n"))
        counts = per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("cf"))
        tables.write_table(counts, f"{folder}/batch={number}")
        if (number + 1) % merge_every == 0:
            before = [f"{kind}={i}" for kind in ("batch", "upto") for i in _done(spark, folder, kind)]
            tables.write_table(_merged(spark, folder), f"{folder}/upto={number}")
            for name in before:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return update


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """term, df, cf, idf of all documents that the stream has brought so far."""
    whole = _merged(spark, folder.rstrip("/"))
    if whole is None:
        return spark.createDataFrame([], "term string, df long, cf long, idf double")
    n = whole.where("term IS NULL").select(F.col("df").alias("n"))
    known = whole.where("term IS NOT NULL").crossJoin(F.broadcast(n))  # one row
    return known.select("term", "df", "cf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n")


def windowed_counts(spark: SparkSession, sf_dir: str, width: str = "1 hour") -> DataFrame:
    """Hourly counts of ``events`` read as a stream, one trigger over what is there.

    Each batch writes the counts that it changed to a table of its own number, so nothing is gathered at the driver and a
    batch that comes again writes the same over; counts only grow, so a window's last count is its largest."""
    at = tables.folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    made = counts(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"), width)
    keep = lambda batch, number: tables.write_table(batch, f"{at}/counts/batch={number}")
    made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    whole = spark.read.schema(made.schema).option("recursiveFileLookup", True).parquet(f"{at}/counts")
    return whole.groupBy("window_start", "event_type").agg(F.max("n").alias("n"))
