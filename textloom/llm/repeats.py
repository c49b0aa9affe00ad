"""What the two exact repeat removers share: naming, grouping and removing runs of windows.

A *window* is ``width`` consecutive units (bytes or words) of one text. Both operators pick for
every window one anchor inside it by the window's content alone, so equal windows have anchors
of equal name at equal places. Neighbouring windows with one anchor make a *run*; a run's extent
is the text that its windows cover.

Rounds, all in Spark, each dropping what is unique:

* round 1 sorts runs by (anchor name, name of the run's extent). Every run but the first of a
  pair of names is a repeat as a whole. A first run whose anchor name has other extents too
  (the edges of repeats) goes on, its anchor named by the rank that the sort gave it;
* round 2 sorts pairs (that rank, name of a longer stretch on either side) of runs that go on;
* the last round sorts the single windows of runs that still go on, by two names.

Sorted rows are read as a stream by ``mapInArrow`` with a state of one row, and what is removed
already passes at once, so a hot group needs no memory. Equal runs are folded before the shuffle,
in pieces of at most ``PIECE`` rows, so a text repeated in a third of all rows reaches the
shuffle once a piece. Anchors that a bounded sample finds hot are dealt by their extents too: no task gets all
of such an anchor, and its first runs go on without asking for other extents, which loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import U, chunks, signed
from .common import NULL_ID, n_partitions, settle, text_of

#: flag: -1 a run of a hot anchor to group, 0 a run to group, 1 removed already, 2 goes on. place: first window << 16 | number of windows.
RUN = "key long, run long, doc long, place long, side long, flag int"
RUN_ARROW = pa.schema([("key", pa.int64()), ("run", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("side", pa.int64()), ("flag", pa.int32())])
MOST = (1 << 16) - 1
#: Rows that are folded at a time in a Python worker.
PIECE = 1 << 19
#: Hot keys are looked for in about so many documents or rows; a key is hot from such a share of them on.
SAMPLE_DOCS, SAMPLE_ROWS, HOT_SHARE, MOST_HOT = 4000, 1_000_000, 0.01, 10_000


def run_batch(key, run, doc, place, side, flag) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (key, run, doc, place, side)] + [pa.array(np.full(len(key), flag, np.int32) if np.isscalar(flag) else flag.astype(np.int32))], schema=RUN_ARROW)


def cut_runs(doc_of: np.ndarray, start: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of equal anchors over consecutive windows."""
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (doc_of[1:] != doc_of[:-1])
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(start)) - 1


def folded(key, run, doc, place, side, strict: bool) -> Iterator[pa.RecordBatch]:
    """Rows of one piece: the earliest of equal runs as a row to group, the others as removed.

    strict: only other documents' copies are removed for sure, copies in the first's own document stay."""
    order = np.lexsort((place, doc, run, key))
    key, run, doc, place, side = (x[order] for x in (key, run, doc, place, side))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (run[1:] != run[:-1])
    lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    again = ~new & (doc == doc[lead]) & (place == place[lead])  # a repeated row
    flag = np.where(new | (doc == doc[lead]), 0, 1) if strict else np.where(new, 0, 1)
    yield run_batch(key[~again], run[~again], doc[~again], place[~again], side[~again], flag[~again])


def in_pieces(parts: Iterator[tuple], strict: bool) -> Iterator[pa.RecordBatch]:
    """Columns (key, run, doc, place, side) of chunks to folded rows, ``PIECE`` or a chunk's more at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= PIECE:
            yield from folded(*(np.concatenate(x) for x in zip(*held, strict=True)), strict)
            held, n = [], 0
    if n:
        yield from folded(*(np.concatenate(x) for x in zip(*held, strict=True)), strict)


def grouped(strict: bool, pass_on: bool) -> Callable:
    """Reads rows sorted by flag, key, run, doc, place. strict: a repeat must have its first in another document.

    Rows that go on get the rank of their key as its new name, but for those of hot keys, whose
    rows stand in several tasks."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        rank = (context.partitionId() if context else 0) << 40  # of the latest key
        last = None  # flag, key, run, doc, place of the latest first run
        held = None  # that first run, if nobody knows yet whether it goes on
        for batch in batches:
            n_open = int(np.searchsorted(batch.column(5).to_numpy(), 1))
            if n_open < batch.num_rows:
                yield batch.slice(n_open)  # removed already
            if not n_open:
                continue
            key, run, doc, place, side, flag = (batch.column(i).to_numpy()[:n_open] for i in range(6))
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (flag[1:] != flag[:-1])
            fresh[0] = last is None or flag[0] != last[0] or key[0] != last[1]
            new = fresh.copy()
            new[1:] |= run[1:] != run[:-1]
            new[0] |= last is None or run[0] != last[2]
            ranks = rank + np.cumsum(fresh)
            rank, named = int(ranks[-1]), np.where(flag < 0, key, ranks)
            lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            fdoc, fplace = doc[np.maximum(lead, 0)], place[np.maximum(lead, 0)]
            if last is not None:
                fdoc, fplace = np.where(lead < 0, last[3], fdoc), np.where(lead < 0, last[4], fplace)
            gone = ~new & ((doc != fdoc) if strict else (doc != fdoc) | (place != fplace))
            if gone.any():
                yield run_batch(key[gone], run[gone], doc[gone], place[gone], side[gone], 1)
            copies = ~new & ~gone
            if strict and pass_on and copies.any():  # copies in the first's document: the last round tells
                yield run_batch(named[copies], run[copies], doc[copies], place[copies], side[copies], 2)
            at = np.flatnonzero(new)
            if not len(at):
                continue
            if pass_on:
                of = ranks[at]
                on = flag[at] < 0
                on[1:] |= of[1:] == of[:-1]
                on[:-1] |= of[1:] == of[:-1]
                if not fresh[: at[0] + 1].any():  # the first run here has the key of the one before the batch
                    on[0] = True
                    if held is not None:
                        yield run_batch(*[np.array([x], np.int64) for x in held], 2)
                rows = at[on]
                if len(rows):
                    yield run_batch(named[rows], run[rows], doc[rows], place[rows], side[rows], 2)
                held = None if on[-1] else tuple(int(x[at[-1]]) for x in (named, run, doc, place, side))
            last = tuple(int(x[at[-1]]) for x in (flag, key, run, doc, place))

    return read


def group(rows: DataFrame, hot: DataFrame | None, strict: bool, pass_on: bool) -> DataFrame:
    """Sort and read ``rows``; removed ones are dealt out by document and pass through, those of ``hot`` keys by run as well."""
    if hot is not None:
        rows = rows.join(F.broadcast(hot), rows["key"] == hot["hot_key"], "left").select("key", "run", "doc", "place", "side", F.when((F.col("flag") == 0) & F.col("hot_key").isNotNull(), -1).otherwise(F.col("flag")).alias("flag"))
    by = F.when(F.col("flag") == 1, F.col("doc")).when(F.col("flag") == -1, F.col("run"))
    dealt = rows.repartition(n_partitions(rows.sparkSession), "key", by).sortWithinPartitions("flag", "key", "run", "doc", "place")
    return dealt.mapInArrow(grouped(strict, pass_on), RUN)


def hot_keys(sample: DataFrame, out_of: int) -> DataFrame:
    """The keys that stand in ``HOT_SHARE`` of the sample's ``out_of`` documents or rows or more: at most ``MOST_HOT`` (hot_key).

    Only how rows are dealt hangs on it, never a result."""
    least = max(20, int(HOT_SHARE * out_of))
    found = sample.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()
    return sample.sparkSession.createDataFrame([(r["key"],) for r in found], "hot_key long")


def shared_sides(rows: DataFrame, strict: bool) -> DataFrame:
    """Round 2: of each run, those with a pair (rank, longer stretch) that has another extent too; ``side`` holds two 32-bit names of stretches."""
    parts = F.array(F.struct(F.lit(0).alias("part"), F.shiftright("side", 32).alias("name")), F.struct(F.lit(1).alias("part"), F.col("side").bitwiseAND(F.lit(0xFFFFFFFF)).alias("name")))
    sides = rows.select("key", "run", "doc", "place", F.explode(parts).alias("s")).where("s.name != 0")
    stretch = sides.select(F.xxhash64("key", "s.part", "s.name").alias("key"), "run", "doc", "place", F.lit(0).cast("long").alias("side"), F.lit(0).alias("flag"))
    n = stretch.count()
    hot = hot_keys(stretch.sample(SAMPLE_ROWS / n, seed=1), SAMPLE_ROWS) if n > SAMPLE_ROWS else hot_keys(stretch, n)
    return group(stretch, hot, strict, True).where("flag = 2").select("doc", "place").distinct()


def named_windows(unit_names: Callable, strict: bool) -> Callable:
    """Rows of (doc_id, text, places of runs that go on) to their single windows."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column(2)), 0))
            places, at = batch.column(2), 0
            for ids, buf, offs in chunks(batch):
                name = unit_names(buf, offs)
                for i in range(len(ids)):
                    spans = places[at + i].values.to_numpy()
                    first, n = spans >> 16, spans & MOST
                    starts = np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))
                    for cut in range(0, len(starts), PIECE):  # a very long text is named in pieces
                        one, two, these = name(i, starts[cut : cut + PIECE])
                        yield one, two, np.full(len(these), ids[i], np.int64), these << 16 | 1, np.zeros(len(these), np.int64)
                at += len(ids)

    return lambda batches: in_pieces(parts(batches), strict)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text, and the places of that document's spans (empty without any).

    The exchange of the texts is the same in each use, so that Spark runs it once."""
    by_doc = spans.groupBy("doc").agg(F.collect_list("place").alias("spans"))  # at most a document's own windows
    return docs.join(by_doc, F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("doc"), "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"))


def repeated(docs: DataFrame, sample: Callable, unit_names: Callable, strict: bool) -> DataFrame:
    """doc_id, text, spans: the places of all runs of repeated windows, after all rounds."""
    base = docs.select("doc_id", text_of().alias("text"))
    n = base.count()
    few = base.sample(SAMPLE_DOCS / n, seed=1) if n > SAMPLE_DOCS else base
    hot = hot_keys(few.mapInArrow(sample, RUN), min(n, SAMPLE_DOCS))
    first = settle(group(base.mapInArrow(sample, RUN), hot, strict, True))
    goes_on = settle(shared_sides(first.where("flag = 2"), strict))
    # no filter on the places here: the exchange of the texts must stay the same as below
    windows = with_spans(base, goes_on).mapInArrow(named_windows(unit_names, strict), RUN)
    late = group(windows, None, strict, False).where("flag = 1").select("doc", "place")
    return with_spans(base, first.where("flag = 1").select("doc", "place").unionByName(late))


def covered(spans: list[int], width: int, n: int) -> np.ndarray:
    """Which of n units the windows at the places of ``spans`` cover."""
    edge = np.zeros(n + 1, np.int64)
    spans = np.array(spans, np.int64)
    first, count = spans >> 16, spans & MOST
    ok = first < n  # rows that share a doc_id may differ in length
    np.add.at(edge, first[ok], 1)
    np.add.at(edge, np.minimum(n, first[ok] + count[ok] - 1 + width), -1)
    return np.cumsum(edge[:n]) > 0


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def pair32(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Two names as one number; 0 stands for none."""
    return signed((left & U(0xFFFFFFFF)) << U(32) | (right & U(0xFFFFFFFF)))


def marks(name: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The order of names, ties cut by place; the low 31 bits hold the place in the chunk."""
    return (name >> U(31) << U(31)) | place.astype(np.uint64)


PLACE = U(0x7FFFFFFF)
