"""Hard negatives: for each anchor and each of its positives the best rows of other labels within a window of scores.

A block matrix multiply in two dimensions. Anchors are sharded into row blocks i, all rows into row
blocks j, and both are cut into chunks k of dimensions. Every pair of blocks (i, j, k) is multiplied into
a partial tile of int64 scores; the tiles of a pair (i, j) are shuffled together and added. Of each whole
tile only what its anchors can still need goes on, and a ranked window per anchor reduces the tiles:

1. the first rows of the anchor's label in each tile, reduced to its positives;
2. with the score windows that these give, the first rows of other labels in each tile and window.

So scores are made twice and stored never. Blocks have a bounded number of rows, dealt by hash of a row
number, so no label or vector that many rows share makes a block larger; a tile has
``ANCHOR_ROWS x BLOCK_ROWS`` scores at most, and a group of at most ``MOST_CHUNKS`` tiles is added in one
task. Only three numbers come to the driver: rows, anchors and dimensions. All anchors meet all rows, in
blocks: they are the stated query set.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part. A
null vec_id is no anchor and comes last among equal scores. Vectors that are shorter than the longest
count as ending in zeros. Rows that are repeated are rows of their own: a copy of the anchor can be its
positive, and a repeated anchor is mined once a copy. Equal scores are taken by vec_id; rows equal in both
cannot be told apart in the result. A positive score below 0 leaves no window. Components so large that
a score might leave 64 bits are refused with an OverflowError. Empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, settle, table

SCALE = 256
ANCHOR_EVERY, MOVED_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: Of a hundredth of the positive's score: 30 * positive <= 100 * negative <= 90 * positive.
LEAST, MOST = 30, 90
ANCHOR_ROWS, BLOCK_ROWS = 128, 4096
#: Components of a row block at most, about, and dimensions of a chunk at least.
BLOCK_CELLS, CHUNK_DIMS, MOST_CHUNKS = 1 << 21, 32, 8
NONE = np.iinfo(np.int64).min
BLOCK = "shard int, chunk int, kind string, part binary, ids binary, rows binary, labels binary, windows binary"
TILE = "i int, j int, tile binary, a_ids binary, a_rows binary, a_labels binary, windows binary, b_ids binary, b_rows binary, b_labels binary"
FOUND = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, other_id long, other_score long"


def quantised(rows: DataFrame) -> DataFrame:
    """row, vec_id, label, parts of the rows that take part: labels moved, components as whole numbers."""
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    broken = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % MOVED_EVERY == 0, (label + 1) % LABELS).otherwise(label)
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~broken).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"), moved.alias("label"), F.transform(numbers, lambda x: F.floor(x * SCALE)).alias("parts")
    )


def is_anchor() -> Column:
    return (F.col("vec_id") % ANCHOR_EVERY == 0) & (F.col("vec_id") != NULL_ID)


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the least kind of signed integers that holds it."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max))


def blocks(rows: DataFrame, shards: int, dims: int, chunk: int) -> DataFrame:
    """A row per shard and chunk of dimensions: the components, and with the first chunk what the rows are.

    ``rows`` has row, vec_id, label, parts and windows (place, positive_id, positive_score); within a
    block they stand in order of vec_id."""

    def pack(group: pa.Table) -> pa.Table:
        lists = group.column("parts").combine_chunks()
        values, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        full = np.zeros((len(sizes), dims), np.int64)
        full[np.arange(dims) < sizes[:, None]] = values
        ids, row, label = (group.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        order = np.lexsort((row, ids))
        windows = np.full((len(ids), POSITIVES, 2), NONE, np.int64)  # positive_id, positive_score
        for at, found in enumerate(group.column("windows").to_pylist()):
            for w in found or ():
                windows[at, w["place"] - 1] = w["positive_id"], w["positive_score"]
        out = []
        for k, start in enumerate(range(0, max(dims, 1), chunk)):
            part = _narrow(full[order, start : start + chunk])
            out.append({"shard": group.column("shard")[0].as_py(), "chunk": k, "kind": part.dtype.str, "part": part.tobytes()})
            out[-1] |= {} if k else {"ids": ids[order].tobytes(), "rows": row[order].tobytes(), "labels": label[order].tobytes(), "windows": windows[order].tobytes()}
        kinds = {"shard": pa.int32(), "chunk": pa.int32(), "kind": pa.string()}
        return pa.Table.from_pylist(out, pa.schema([(c.split()[0], kinds.get(c.split()[0], pa.binary())) for c in BLOCK.split(", ")]))

    return rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(pack, BLOCK)


def product(a: np.ndarray, b: np.ndarray, dims: int) -> np.ndarray:
    """a @ b.T in int64, exactly: by floating point where all sums are whole numbers below 2**53."""
    top = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    most = top(a) * top(b) * dims
    if most >= 1 << 63:
        raise OverflowError("components are too large: scores might leave 64 bits")
    kind = np.float64 if most < 1 << 53 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _multiply(chunk: int, dims: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [c.split()[0] for c in TILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda c: batch.column(c)[r].as_py()  # noqa: B023, E731
                width = min(chunk, dims - get("chunk") * chunk) if dims else 0
                a, b = (np.frombuffer(get(f"{s}_part"), get(f"{s}_kind")).reshape(-1, width) if width else np.zeros((get(f"{s}_size"), 0)) for s in "ab")
                made = {"i": get("i"), "j": get("j"), "tile": product(a, b, dims).tobytes()}
                yield pa.RecordBatch.from_arrays([pa.array([made[c] if c in made else get(c)], pa.int32() if c in "ij" else pa.binary()) for c in names], names=names)

    return run


def _added(finish: Callable) -> Callable[[pa.Table], pa.Table]:
    """The partial tiles of a pair of blocks added, then what ``finish`` keeps of each anchor's scores."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    schema = pa.schema([(c, pa.int32() if c == "place" else pa.int64()) for c in names])

    def run(group: pa.Table) -> pa.Table:
        meta = {}
        for c in ("a_ids", "a_rows", "a_labels", "windows", "b_ids", "b_rows", "b_labels"):
            meta[c] = np.frombuffer(group.column(c).drop_null()[0].as_py(), np.int64)
        scores = np.zeros((len(meta["a_ids"]), len(meta["b_ids"])), np.int64)
        for tile in group.column("tile"):
            scores += np.frombuffer(tile.as_buffer(), np.int64).reshape(scores.shape)
        out: list[list[np.ndarray]] = []
        for r in range(len(scores)):
            out += finish(r, scores[r], meta)
        return pa.Table.from_arrays([pa.array(np.concatenate([x[c] for x in out]) if out else [], f.type) for c, f in enumerate(schema)], schema=schema)

    return run


def _first(scores: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Of the places ``at`` (rising, so by vec_id) the ``most`` with the highest scores, in order."""
    s = scores[at]
    if len(at) > most:
        keep = s >= np.partition(s, len(s) - most)[len(s) - most]
        at, s = at[keep], s[keep]
    return at[np.argsort(-s, kind="stable")[:most]]


def _rows(r: int, meta: dict, scores: np.ndarray, at: np.ndarray, place: int, positive: int, positive_score: int) -> list[np.ndarray]:
    fixed = (meta["a_rows"][r], meta["a_ids"][r], place, positive, positive_score)
    return [*(np.full(len(at), x, np.int64) for x in fixed), meta["b_ids"][at], scores[at]]


def _positives(r: int, scores: np.ndarray, meta: dict) -> list[list[np.ndarray]]:
    at = np.flatnonzero((meta["b_labels"] == meta["a_labels"][r]) & (meta["b_rows"] != meta["a_rows"][r]))
    return [_rows(r, meta, scores, _first(scores, at, POSITIVES), 0, 0, 0)] if len(at) else []


def _negatives(r: int, scores: np.ndarray, meta: dict) -> list[list[np.ndarray]]:
    out, other = [], meta["b_labels"] != meta["a_labels"][r]
    for place, (positive, score) in enumerate(meta["windows"].reshape(-1, POSITIVES, 2)[r].tolist(), 1):
        if score != NONE and score >= 0:
            at = np.flatnonzero(other & (scores >= -(-LEAST * score // 100)) & (scores <= MOST * score // 100))
            if len(at):
                out.append(_rows(r, meta, scores, _first(scores, at, NEGATIVES), place, positive, score))
    return out


def _scored(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, dims: int, finish: Callable) -> DataFrame:
    """What ``finish`` keeps of the scores of all anchors with all rows, tile by tile."""
    chunk = max(CHUNK_DIMS, -(-dims // MOST_CHUNKS))
    per_block = max(256, min(BLOCK_ROWS, BLOCK_CELLS // max(dims, 1)))
    n_i, n_j = max(1, -(-n_anchors // ANCHOR_ROWS)), max(1, -(-n_rows // per_block))
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}_{c}") for c in ("shard", "chunk", "kind", "part", "ids", "rows", "labels", "windows")), (F.length("ids") / 8).cast("int").alias(f"{s}_size"))
    # every block is sent to each block that it meets: no key has more than one pair
    a = side(blocks(anchors, n_i, dims, chunk), "a").withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(n_j - 1))))
    b = side(blocks(rows, n_j, dims, chunk), "b").withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(n_i - 1))))
    pairs = a.join(b, (F.col("a_shard") == F.col("from")) & (F.col("to") == F.col("b_shard")) & (F.col("a_chunk") == F.col("b_chunk")))
    pairs = pairs.select(F.col("a_shard").alias("i"), F.col("b_shard").alias("j"), F.col("a_chunk").alias("chunk"), *(f"{s}_{c}" for s in "ab" for c in ("kind", "part", "ids", "rows", "labels", "size")), F.col("a_windows").alias("windows"))
    return pairs.mapInArrow(_multiply(chunk, dims), TILE).groupBy("i", "j").applyInArrow(_added(finish), FOUND)


def mine(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    none = F.lit(None).cast("array<struct<place:int,positive_id:long,positive_score:long>>").alias("windows")
    vectors = settle(quantised(rows))
    n_rows, n_anchors, dims = (int(x or 0) for x in vectors.agg(F.count("*"), F.count_if(is_anchor()), F.max(F.size("parts"))).head())
    anchors, every = vectors.where(is_anchor()), vectors.select("*", none)
    near = _scored(anchors.select("*", none), every, n_anchors, n_rows, dims, _positives)
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("other_score"), "other_id"))
    positives = near.withColumn("place", rank("anchor_row")).where(F.col("place") <= POSITIVES)
    windows = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.collect_list(F.struct("place", F.col("other_id").alias("positive_id"), F.col("other_score").alias("positive_score"))).alias("windows"))
    # anchors without a positive have no window and need no score
    ready = settle(anchors.join(windows, "row"))
    far = _scored(ready, every, n_anchors, n_rows, dims, _negatives)
    far = far.withColumn("rank", rank("anchor_row", "place")).where(F.col("rank") <= NEGATIVES)
    shown = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return far.select("anchor_id", shown("positive_id").alias("positive_id"), "rank", shown("other_id").alias("negative_id"), "positive_score", F.col("other_score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


def oracle() -> str:
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS line, vec_id, CASE WHEN vec_id % {MOVED_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS parts
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS MATERIALIZED (
  SELECT a.line, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.parts, b.parts)::BIGINT AS score
  FROM v a JOIN v b ON a.line <> b.line WHERE a.vec_id % {ANCHOR_EVERY} = 0
), positives AS (
  SELECT line, anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY line ORDER BY score DESC, other_id NULLS LAST) AS place
  FROM scored WHERE same QUALIFY place <= {POSITIVES}
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.line, place ORDER BY score DESC, other_id NULLS LAST)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON p.line = s.line AND NOT s.same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
QUALIFY rank <= {NEGATIVES}"""
