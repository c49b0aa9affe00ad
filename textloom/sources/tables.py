"""Tables by suffix, retrieval data sets by manifest, result sinks and fingerprinted caches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .raw import _exists

#: Columns of the normalised tables (fixed names).
COLUMNS = {
    "documents": ("document_id", "title", "text"),
    "passages": ("passage_id", "document_id", "passage_text", "passage_position"),
    "queries": ("query_id", "query_text", "dataset", "split"),
    "qrels": ("query_id", "passage_id", "relevance"),
    "query_metadata": ("query_id", "question_type"),
}


@dataclass(frozen=True)
class Retrieval:
    name: str
    documents: DataFrame
    passages: DataFrame
    queries: DataFrame
    qrels: DataFrame
    query_metadata: DataFrame | None = None


def folder(spark: SparkSession) -> str:
    """A new folder below the shared one (``spark.checkpoint.dir``); on one machine without the setting a local one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return f"{root.rstrip('/')}/made-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a new shared folder and read back, so that several readers do not make it again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV with header, JSON (one value or a list) or JSON lines, by suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if suffix in ("json", "jsonl"):
        return spark.read.option("multiLine", suffix == "json").json(path)
    raise ValueError(f"unknown table format: {path}")


#: Spark cuts small tables to splits of this many bytes (its default cost of opening a file), whatever their row groups.
LEAST_SPLIT = 4 << 20


def spread(df: DataFrame, by: str) -> DataFrame:
    """A table too small to have a row group for each core, dealt by ``by`` so that all cores share the work on its texts.

    What moves is less than ``LEAST_SPLIT`` bytes a core; larger tables are left as their files lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, by) if size < cores * LEAST_SPLIT else df


def read_result(spark: SparkSession, path: str) -> DataFrame:
    """A result table that was written as CSV, with its types."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def write_table(df: DataFrame, path: str, format: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Parquet, JSON lines or CSV with header (an empty table still has its header)."""
    out = df.write.mode("overwrite").option("header", True)
    (out.partitionBy(*by) if by else out).format(format).save(path)


def read_json(spark: SparkSession, path: str):
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).head()[0])


def write_json(spark: SparkSession, path: str, value) -> None:
    """A small JSON file by the file system of ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, sort_keys=True, default=str).encode()))
    finally:
        out.close()


def from_manifest(spark: SparkSession, folder: str, name: str) -> Retrieval:
    """Tables that ``folder``/manifest.json names, renamed, projected and cast."""
    said = read_json(spark, f"{folder}/manifest.json")
    wanted = [t for t in COLUMNS if t != "query_metadata"]
    if missing := [t for t in wanted if t not in said]:
        raise ValueError(f"{folder}: the manifest lacks {missing}")
    frames = {}
    for t in [*wanted, *(["query_metadata"] if said.get("query_metadata") else [])]:
        df = read_table(spark, f"{folder}/{said[t]}").withColumnsRenamed({source: ours for ours, source in said.get("column_maps", {}).get(t, {}).items()})
        if lacking := sorted(set(COLUMNS[t]) - set(df.columns)):
            raise ValueError(f"{name}.{t} lacks {lacking}")
        typed = {c: F.col(c).cast("string") for c in COLUMNS[t]}
        if t == "passages":
            typed["passage_position"] = F.col("passage_position").try_cast("int")
        if t == "qrels":
            typed["relevance"] = F.col("relevance").try_cast("double")
        frames[t] = df.select(*(c.alias(n) for n, c in typed.items()))
    return Retrieval(name, **frames)


def fingerprint(df: DataFrame, columns: tuple[str, ...], *salt) -> str:
    """Sixteen hex digits of a table's rows in any order: sums and counts of row hashes, made without a sort."""
    row = F.xxhash64(*columns)
    n, a, b = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(7), *columns))).head()
    return df.sparkSession.sql("SELECT left(sha2(:s, 256), 16)", args={"s": json.dumps([n, str(a), b, *map(str, salt)])}).head()[0]


def cached(df: DataFrame, folder: str, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``make(df)`` as Parquet under its fingerprint; read again if its success mark is there."""
    path = f"{folder.rstrip('/')}/{key}"
    if not _exists(df.sparkSession, f"{path}/_SUCCESS"):
        write_table(make(df), path)
    return df.sparkSession.read.parquet(path)


def synthetic_retrieval(spark: SparkSession, name: str = "synthetic") -> Retrieval:
    """Four documents (one without a title), seven passages, four queries, four judgements, one graded 2."""
    docs = [("d1", "Oslo", "Oslo lies on a fjord. Trams cross the town."), ("d2", "Ada Lovelace", "Ada Lovelace wrote notes on an engine."), ("d3", "Venus", "Venus is the second planet. It has no moon."), ("d4", None, "The Amazon carries more water than any other river.")]
    said = [("d1", "Oslo lies on a fjord."), ("d1", "Trams cross the town."), ("d2", "Ada Lovelace wrote notes."), ("d2", "The notes describe an engine."), ("d3", "Venus is the second planet."), ("d3", "Venus has no moon."), ("d4", "The Amazon carries most water of all rivers.")]
    seen: dict[str, int] = {}
    passages = []
    for i, (d, t) in enumerate(said, 1):
        passages.append((f"p{i}", d, t, seen.get(d, 0)))
        seen[d] = seen.get(d, 0) + 1
    asked = ["where does Oslo lie", "who wrote notes on an engine", "moon of Venus", "river with most water"]
    queries = [(f"q{i}", t, name, "test") for i, t in enumerate(asked, 1)]
    qrels = [("q1", "p1", 1.0), ("q2", "p3", 1.0), ("q3", "p6", 2.0), ("q4", "p7", 1.0)]
    make = spark.createDataFrame
    return Retrieval(name, make(docs, "document_id STRING, title STRING, text STRING"), make(passages, "passage_id STRING, document_id STRING, passage_text STRING, passage_position INT"), make(queries, "query_id STRING, query_text STRING, dataset STRING, split STRING"), make(qrels, "query_id STRING, passage_id STRING, relevance DOUBLE"))
