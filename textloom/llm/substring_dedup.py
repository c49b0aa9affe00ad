"""Substring dedup of word windows by recompression.

Each round of recompression names, alike in all documents, first runs of one symbol and then pairs
(a, b) of neighbours where the name of a has its chosen bit unset and that of b set. A name is a
64-bit hash of its parts, so rounds need no table of names. With every symbol goes the stretch
of words that decided how it was formed; a window that holds the whole stretch holds the same
symbol wherever its words stand. A window of 13 words surely holds whole symbols of one round
(and those of further rounds ever less), so ``rounds`` is 1 for it and grows with the width.

Every window is stood for by its high-level symbol of the least name; windows without one (long
runs of a word) by their word of the least name. Spark rounds then sort the symbols with the
names of the text their windows cover, and verify repeats (see ``repeats``): equal symbols with
equal extents first, then symbols with a shared stretch of 7 or 8 words, then single windows.

A word is removed if a window over it also starts in a document with a smaller doc_id.

Edge cases: null text has no words; texts under 13 words stay whole; null doc_ids come last in
order; repeated rows (one doc_id and text) count as one document and get equal rows; rows that
share a doc_id count as one document; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import repeats
from .bytehash import U, chunks, mix, names, prefix_of, signed, sliding_min, words
from .common import documents

WIDTH = 13
LEFT, RIGHT = 6, 8
FAR = np.int64(1) << 40


def rounds_for(width: int) -> int:
    """Rounds of which every window surely holds a whole symbol, but for long runs."""
    return 1 if width < 30 else 1 + rounds_for(width // 3)


def recompress(name, first, lo, hi, row, level: int):
    """One round over the symbols of a chunk: names, first words, deciding stretches [lo, hi), texts."""
    n = len(name)
    # runs of one symbol; the single symbols beside a run decide where it ends
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, n))
    end = at + size - 1
    name = np.where(size > 1, mix(name[at] + size.astype(np.uint64) * U(0xA24BAED4963EE407)), name[at])
    edge = row[at[1:]] != row[at[1:] - 1]
    lo = np.minimum(lo[at], np.concatenate([[-FAR], np.where(edge, -FAR, lo[at[1:] - 1])]))
    hi = np.maximum(hi[end], np.concatenate([np.where(edge, FAR, hi[at[1:]]), [FAR]]))
    first, row = first[at], row[at]
    # pairs: bit 0 before bit 1
    bit = (mix(name + U(level * 2 + 1)) >> U(40) & U(1)).astype(bool)
    same = np.concatenate([row[1:] == row[:-1], [False]])
    head = np.zeros(len(name), bool)
    head[:-1] = ~bit[:-1] & bit[1:] & same[:-1]
    tail = np.concatenate([[False], head[:-1]])
    after, before = np.append(np.arange(1, len(name)), len(name) - 1), np.maximum(np.arange(len(name)) - 1, 0)
    no_after, no_before = ~same, np.concatenate([[True], ~same[:-1]])
    hi2 = np.where(head | ~bit, np.where(no_after, FAR, np.maximum(hi, hi[after])), hi)
    lo2 = np.where(bit, np.where(no_before, -FAR, np.minimum(lo, lo[before])), np.where(head, np.minimum(lo, lo[after]), lo))
    lo2 = np.where(~head & ~bit, np.minimum(lo2, lo[after]), lo2)
    hi2 = np.where(~head & bit, np.maximum(hi2, hi[before]), hi2)
    name = np.where(head, mix(name * U(0x9FB21C651E98DF25) + name[after]), name)
    keep = ~tail
    return name[keep], first[keep], lo2[keep], hi2[keep], row[keep]


def anchors(h: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the mark of the least symbol of the window there, and the symbols' names by first word."""
    n = len(h)
    place = np.arange(n)
    name, first, lo, hi, r = h, place, place, place + 1, row
    for level in range(rounds_for(width)):
        name, first, lo, hi, r = recompress(name, first, lo, hi, r, level)
    size, top = hi - lo, np.iinfo(np.uint64).max
    best = np.full(n, top, np.uint64)
    mark = repeats.marks(name >> U(1), first)  # below the marks of words
    for e in np.unique(size[size <= width]):
        these = size == e
        v = np.full(n, top, np.uint64)
        np.minimum.at(v, lo[these], mark[these])
        best = np.minimum(best, sliding_min(v, width - int(e) + 1))
    symbols = mix(h)
    symbols[first] = name
    lone = best == top
    if lone.any():
        word = sliding_min(repeats.marks(h >> U(1) | U(1 << 63), place), width)
        best = np.where(lone, word, best)
    return best, symbols


def sampler(width: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for ids, buf, offs in chunks(batch):
                _, _, h, at = words(buf, offs)
                n_words = np.diff(at)
                n_win = np.maximum(n_words - width + 1, 0)
                if not n_win.sum():
                    continue
                row = np.repeat(np.arange(len(ids)), n_words)
                best, symbols = anchors(h, row, width)
                p = prefix_of(h)
                win_row = np.repeat(np.arange(len(ids)), n_win)
                start = np.arange(n_win.sum()) - np.repeat(np.cumsum(n_win) - n_win, n_win) + np.repeat(at[:-1], n_win)
                mark = best[start]
                lone = mark >> U(63) == 1
                pos_of = (mark & repeats.PLACE).astype(np.int64)
                first, last = repeats.cut_runs(win_row, start, pos_of * 2 + lone)
                lo, hi, pos, r = start[first], start[last], pos_of[first], win_row[first]
                key = np.where(lone[first], mix(h[pos] ^ U(0x5851F42D4C957F2D)), symbols[pos])
                left = np.where(pos - lo >= LEFT, names(p, np.maximum(pos - LEFT, 0), pos + 1) | U(1), U(0))
                right = np.where(pos - hi < LEFT, names(p, pos, np.minimum(pos + width - LEFT + 1, len(h))) | U(1), U(0))
                yield signed(key), signed(names(p, lo, hi + width)), ids[r], (lo - at[r]) << 16 | (hi - lo + 1), repeats.pair32(left, right)

    return lambda batches: repeats.in_pieces(runs(batches), True)


def window_names(width: int):
    def of(buf: np.ndarray, offs: np.ndarray):
        _, _, h, at = words(buf, offs)
        p = prefix_of(h)

        def name(i: int, starts: np.ndarray):
            starts = starts[starts + width <= at[i + 1] - at[i]]
            s = starts + at[i]
            return signed(names(p, s, s + width // 2)), signed(names(p, s + width // 2, s + width)), starts

        return name

    return of


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text, spans: places (in words) of the runs of windows found in an earlier document."""
    return repeats.repeated(docs, sampler(width), window_names(width), True)


def _cutter(width: int):
    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ws = (text or "").encode().split()  # at the same white space as the contract's
                gone = repeats.covered(spans, width, len(ws)) if spans else None
                kept = ws if gone is None else [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
                out.append((len(ws), len(ws) - len(kept), repeats.sha(b" ".join(kept))))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return cut_batches


def cut(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    return repeated_spans(docs, width).mapInArrow(_cutter(width), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(documents(spark, sf_dir))
