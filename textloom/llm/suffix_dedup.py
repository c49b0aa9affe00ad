"""Suffix-array dedup by distributed prefix doubling over content-sampled positions.

A full suffix array of all byte positions would shuffle every byte's rank pair in every round,
far over any disk budget, so only sampled suffixes are sorted: of every 100-byte window the
position whose 32-byte prefix has the least name (hash). Equal windows sample equal positions, so
no repeat is missed. Doubling goes 32 -> 66 -> 100 bytes and beyond the threshold:

* a sampled suffix's first rank is the name of its 32-byte prefix. Spark sorts pairs (that rank,
  name of the extent of all windows that sampled it, past the threshold); the first of a
  pair keeps its text, all others are removed; a suffix unique in its first rank drops out;
* suffixes with a shared rank but no equal extent are reranked at the offset 66: pairs (first
  rank, the 66 bytes from here, or ending 32 bytes behind here);
* those still not unique are reranked at 100 bytes: all their single windows, by two names.

A byte is removed if a 100-byte string covering it also starts earlier: in a smaller doc_id, or
earlier in the same document. Names are 64-bit; a wrong removal needs two independent names to
collide.

Edge cases: null text is empty; texts under 100 bytes keep everything; null doc_ids come last in
order; repeated rows (one doc_id and text) count as one and get equal rows; rows that share a
doc_id count as one document; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .bytehash import U, chunks, names, prefix, signed, sliding_min
from .common import documents

WIDTH = 100
GRAM = 32
STRETCH = 66


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per chunk the runs of windows by the suffix that they sample: key, run, doc, place, side."""
    for batch in batches:
        for ids, buf, offs in chunks(batch):
            lens = np.diff(offs)
            n_win = np.maximum(lens - WIDTH + 1, 0)
            if not n_win.sum():
                continue
            p = prefix(buf)
            at = np.arange(len(buf) - GRAM + 1)
            gram = names(p, at, at + GRAM)
            least = sliding_min(repeats.marks(gram, at), WIDTH - GRAM + 1)
            row = np.repeat(np.arange(len(ids)), n_win)
            start = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win) + np.repeat(offs[:-1], n_win)
            anchor = (least[start] & repeats.PLACE).astype(np.int64)
            first, last = repeats.cut_runs(row, start, anchor)
            lo, hi, pos, r = start[first], start[last], anchor[first], row[first]
            extent = names(p, lo, hi + WIDTH)
            # the longer stretches on either side, where a window of the run holds them
            left = np.where(pos - lo >= STRETCH - GRAM, names(p, np.maximum(pos - (STRETCH - GRAM), 0), pos + GRAM) | U(1), U(0))
            right = np.where(pos - hi < STRETCH - GRAM, names(p, pos, np.minimum(pos + STRETCH, len(buf))) | U(1), U(0))
            yield signed(gram[pos]), signed(extent), ids[r], (lo - offs[r]) << 16 | (hi - lo + 1), repeats.pair32(left, right)


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return repeats.in_pieces(_runs(batches), False)


def _window_names(buf: np.ndarray, offs: np.ndarray):
    p = prefix(buf)

    def name(i: int, starts: np.ndarray):
        starts = starts[starts + WIDTH <= offs[i + 1] - offs[i]]
        s = starts + offs[i]
        # rank pair: the first and the second half of the window
        return signed(names(p, s, s + WIDTH // 2)), signed(names(p, s + WIDTH // 2, s + WIDTH)), starts

    return name


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0), []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode()
            if not spans:
                out.append((len(data), 0, 0, repeats.sha(data)))
                continue
            gone = repeats.covered(spans, WIDTH, len(data))
            edges = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
            out.append((len(data), int(gone.sum()), edges, repeats.sha(np.frombuffer(data, np.uint8)[~gone].tobytes())))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans: places of the runs of 100-byte windows that start earlier somewhere."""
    return repeats.repeated(docs, sampled, _window_names, False)


def cut(docs: DataFrame) -> DataFrame:
    return repeated_spans(docs).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(documents(spark, sf_dir))
