"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are cut at ASCII white space (fixed by the contracts).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Where a null doc_id is put: after all others.
NULL_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests, one machine) a folder of this session is made and set; a session
    on a cluster without the setting is refused, since a local folder would not be seen by all.
    """
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="textloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Bytes of an Arrow batch: what a Python worker and its executor hold of long texts at once, but for one text.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches end at ``BATCH_BYTES``, unless the session sets its own bound; the default of 64 MB
    and 10,000 rows takes up to that much several times a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


_settled: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process settled, once no result that reads them is wanted any more; their number."""
    n = 0
    while _settled:
        path = spark._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def release(spark: SparkSession, *done: DataFrame) -> None:
    """Give back disk that nothing needs any more: the settled tables in ``done``, and shuffles.

    A settled table does not hang on the shuffles that made it, but Spark deletes shuffle files only
    once the driver's collector finds their plans dropped, by default every half hour: it is asked to."""
    names = {file.split("/")[-2] for df in done for file in df.inputFiles()}
    for at in [at for at in _settled if at.rsplit("/", 1)[1] in names]:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _settled.remove(at)
    spark._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text"):
    """Null texts count as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
