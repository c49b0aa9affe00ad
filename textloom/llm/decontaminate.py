"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Texts and items become words (ASCII letters lower-cased, cut at everything else in ASCII). Each of
a number of random walks maps a sequence of words so that a small edit distance becomes a small
Hamming distance: at step j the walk writes its word and moves on or stays by a bit that hangs on
(j, word). Of the first n steps ``BITS`` written words are sampled as an LSH key. Every window of
every text that is as long as an item (item lengths are grouped by their own exact value) is keyed
alike, and a shared key makes a candidate. Texts are padded on both sides, so that a stretch that is
shorter than its item and stands at a text's start or end, or is the whole text, has an aligned
window too. Candidates are verified exactly: the item's edit distance in words
to the best stretch there must be at most ``DISTANCE`` of its length.

The walks of an item are as many as its length needs: ``first_hits`` measures how often a copy edited as
much as ``DISTANCE`` allows shares a key, and ``repeats`` takes the walks that reach ``TARGET`` for the
worst of scattered and adjoining substitutions, deletions and insertions. Copies edited less are found
more often, and verbatim ones always. An item of more than ``PART`` words is searched by parts of at most
so many: if the whole is edited in at most ``DISTANCE`` of its words, so is one of its parts, which is
found like an item of its length. The whole is verified around each part that is found, so memory and
walks are bounded for items of any length.

A window within that distance holds at least (1 - DISTANCE) of its words from the item, hence from
the benchmark's vocabulary; windows that do not are skipped before they are embedded, which loses
nothing. Items come in blocks of at most ``BLOCK`` and about ``BLOCK_BYTES``, so what each task gets is
bounded but for one longer item; each block passes over all documents. There is no shuffle of texts.

Result: a row for each document and item found: doc_id, item_id, first_word, distance, n_words.

Edge cases: null or empty texts and items find nothing; items under ``LEAST`` words are found
only whole; equal items are each reported; what equal rows find is reported once; null doc_ids stay and null
item_ids are skipped; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import U, chunks, mix, mixed, names, prefix_of, words
from .common import NULL_ID, documents, table, text_of, unused

DISTANCE = 0.2
BITS = 2
#: Least share of copies at the full distance to be found, for every kind of edit.
TARGET = 0.99
#: Walks by item length up to the key: above what ``measured`` gives at the key (8, 22, 26, 24, 45, 107) and
#: at the least length, where it gives 13 and one copy in a thousand takes 26.
REPEATS = {8: 26, 16: 25, 32: 30, 64: 40, 128: 60, 256: 130}
PART = max(REPEATS)
LEAST = 5
BLOCK, BLOCK_BYTES = 20_000, 1 << 25
SEED = 8
#: Words before and behind a text: a walk moves on over the first, and stays on the last as past the end.
START, END = U(mixed(15)), U(0)
OUT = "doc_id long, item_id long, first_word long, distance long, n_words long"


def most_of(n: int) -> int:
    """Most edits of an item of ``n`` words."""
    return int(DISTANCE * n) if n >= LEAST else 0


def edited(item: np.ndarray, k: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """A copy of ``item`` with ``k`` edits of a kind of ``KINDS``, new words being of no other text."""
    n, new = len(item), rng.integers(1, 2**64, k, dtype=np.uint64)
    what, where = kind.split()
    at = np.sort(rng.choice(n, k, replace=False)) if where == "scattered" else rng.integers(0, n - k + 1) + np.arange(k)
    if what == "deleted":
        return np.delete(item, at)
    if what == "inserted":
        return np.insert(item, at if where == "scattered" else np.full(k, rng.integers(0, n + 1)), new)
    out = item.copy()
    out[at] = new
    return out


KINDS = [f"{what} {where}" for what in ("replaced", "deleted", "inserted") for where in ("scattered", "adjoining")]


def first_hits(n: int, kind: str, walks: int, trials: int, seed: int = 0) -> np.ndarray:
    """Per random item of ``n`` words the number of its first walk that finds a copy with all edits allowed; walks + 1 for none."""
    rng = np.random.default_rng([seed, n, KINDS.index(kind)])
    k = most_of(n)
    items = rng.integers(1, 2**64, (trials, n), dtype=np.uint64)
    # where windows start that hold the copy, or as much of it as a window can
    starts = {"replaced": range(1), "deleted": range(-k, 1), "inserted": range(k + 1)}[kind.split()[0]]
    stack = []
    for item in items:
        text = np.concatenate([rng.integers(1, 2**64, k, dtype=np.uint64), edited(item, k, kind, rng), rng.integers(1, 2**64, k, dtype=np.uint64)])
        stack.append([text[k + s : k + s + n] for s in starts])
    stack = np.array(stack)
    out, left = np.full(trials, walks + 1), np.arange(trials)
    for i, walk in enumerate(_walks(n, walks), 1):
        theirs = keys(stack[left].reshape(-1, n), walk).reshape(len(left), -1)
        hit = (theirs == keys(items[left], walk)[:, None]).any(1)
        out[left[hit]] = i
        left = left[~hit]
        if not len(left):
            break
    return out


def measured(n: int, trials: int) -> int:
    """Walks that reach ``TARGET`` on random items of ``n`` words for the worst kind of edit."""
    walks = 64
    while True:
        need = max(int(np.quantile(first_hits(n, kind, walks, trials), TARGET, method="higher")) for kind in KINDS)
        if need <= walks:
            return need
        walks *= 4


@cache
def repeats(n: int) -> int:
    """Walks for items and parts of ``n`` words, at most ``PART``."""
    return next(walks for top, walks in REPEATS.items() if n <= top) if most_of(n) else 1


def parts_of(n: int) -> list[tuple[int, int]]:
    """(first word, words) of the parts of an item of ``n`` words: as few as can be, of about the same size."""
    k = max(1, -(-n // PART))
    ends = [n * i // k for i in range(k + 1)]
    return list(zip(ends, (b - a for a, b in zip(ends, ends[1:], strict=False)), strict=False))


def _walks(steps: int, walks: int) -> list[tuple[int, np.ndarray]]:
    """Per repeat: the seed of its walk and the steps whose words are sampled."""
    rng = np.random.default_rng(SEED)
    return [(mixed(1000 + r), np.sort(rng.choice(steps, min(BITS, steps), replace=False))) for r in range(walks)]


def keys(stack: np.ndarray, walk: tuple[int, np.ndarray]) -> np.ndarray:
    """LSH keys of the windows in the rows of ``stack`` under one walk."""
    seed, picks = walk
    m, n = stack.shape
    flat, base = stack.ravel(), np.arange(m) * n
    at, key = np.zeros(m, np.int64), np.full(m, seed, np.uint64)
    for step in range(int(picks[-1]) + 1):
        word = np.where(at < n, flat[base + np.minimum(at, n - 1)], U(0))
        if step in picks:
            key = mix(key + word)
        at += (word * U(mixed(seed + step) | 1) >> U(63)).astype(np.int64)
    return key


def distance(item: list, text: list, most: int) -> int:
    """Least edit distance of ``item`` to any stretch of ``text``; most + 1 if above ``most``."""
    above = np.zeros(len(text) + 1, np.int64)
    t = np.array(text, np.uint64)
    steps = np.arange(len(text) + 1)
    for i, word in enumerate(item, 1):
        best = np.empty_like(above)
        best[0] = i
        best[1:] = np.minimum(above[:-1] + (t != word), above[1:] + 1)
        above = np.minimum.accumulate(best - steps) + steps  # insertions
        if above.min() > most:
            return most + 1
    return int(min(above.min(), most + 1))


class Items:
    """The LSH tables of a block of items, by length of their parts; a short item is its own part."""

    def __init__(self, ids: list[int], texts: list[str]):
        data = [t.encode() for t in texts]
        buf = np.frombuffer(b"".join(data), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        _, _, h, at = words(buf, offs, lower=True, alnum=True)
        self.words = [h[at[i] : at[i + 1]] for i in range(len(ids))]
        self.ids = ids
        self.bits = _bits(h, 20)
        self.parts = [(i, a, w[a : a + n]) for i, w in enumerate(self.words) if len(w) for a, n in parts_of(len(w))]
        self.sets = [np.unique(w) for _, _, w in self.parts]
        self.tables, self.own = {}, {}
        for n in sorted({len(w) for _, _, w in self.parts}):
            rows = np.array([i for i, (_, _, w) in enumerate(self.parts) if len(w) == n])
            stack = np.stack([self.parts[i][2] for i in rows])
            self.own[n] = _bits(stack.ravel(), 16)
            self.tables[n] = []
            for walk in _walks(n, repeats(n)):
                key = keys(stack, walk)
                order = np.argsort(key, kind="stable")
                self.tables[n].append((walk, key[order], rows[order]))

    def windows(self, h: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, first words, texts, which of the different windows, those) of a chunk's windows with enough words of items.

        A window may begin before its text or end behind it, by as many words as the item may be edited.
        Words are looked up in bit tables, which hold some others too: they let more windows pass, never fewer."""
        if not len(h):
            return
        h, row, lo, hi = padded(h, at, max(map(most_of, self.own), default=0))
        known = self.bits[(h >> U(44)).astype(np.int64)]
        known[(h == START) | (h == END)] = False
        total = np.zeros(len(h) + 1, np.int32)
        np.cumsum(known, out=total[1:])
        p = None
        for n, own in self.own.items():
            if n > len(h):
                break
            most = most_of(n)
            s = np.flatnonzero(total[n:] - total[:-n] >= n - most)
            r = row[s]
            fits = (s >= lo[r] - most) & (s + n <= hi[r] + most)
            s, r = s[fits], r[fits]
            if not len(s):
                continue
            p = prefix_of(h) if p is None else p
            _, first, which = np.unique(names(p, s, s + n), return_index=True, return_inverse=True)
            stack = h[s[first][:, None] + np.arange(n)]
            good = own[(stack >> U(48)).astype(np.int64)].sum(1) >= n - most
            if good.any():
                keep = good[which]
                s, r = s[keep], r[keep]
                yield n, s - lo[r] + at[r], r, (np.cumsum(good) - 1)[which[keep]], stack[good]

    def candidates(self, n: int, stack: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, part) pairs that share an LSH key under some walk."""
        for walk, sorted_keys, rows in self.tables[n]:
            key = keys(stack, walk)
            lo, hi = np.searchsorted(sorted_keys, key, "left"), np.searchsorted(sorted_keys, key, "right")
            count = hi - lo
            window = np.repeat(np.arange(len(key)), count)
            yield window, rows[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)]

    def find(self, parts: list) -> Iterator[tuple[int, int, int, int, int]]:
        """(doc, item, first word, distance, words) over chunks (ids, names of words, offsets)."""
        held: dict[int, list] = {}
        for c, (_, h, at) in enumerate(parts):
            for n, s, row, which, stack in self.windows(h, at):
                so_far = held.setdefault(n, [])
                base = so_far[-1][3] if so_far else 0
                so_far.append(((np.full(len(s), c), s, row, which + base), stack, None, base + len(stack)))
        best: dict[tuple, tuple[int, int]] = {}
        tried: set[tuple] = set()
        for n, found in held.items():
            chunk, start, row, which = (np.concatenate(x) for x in zip(*[f[0] for f in found], strict=True))
            stack = np.concatenate([f[1] for f in found])
            pairs = np.unique(np.concatenate([np.stack(x) for x in self.candidates(n, stack)], axis=1), axis=1)
            by_window = np.argsort(which, kind="stable")
            lo = np.searchsorted(which[by_window], np.arange(len(stack) + 1))
            for k in np.unique(pairs[1]).tolist():
                i, ahead, part = self.parts[k]
                size, most = len(self.words[i]), most_of(len(self.words[i]))
                # a window within the distance has all but a few of the part's different words
                ws, own = pairs[0][pairs[1] == k], self.sets[k]
                spot = np.where(_within(own, stack[ws]), np.searchsorted(own, stack[ws]), -1)
                spot.sort(axis=1)
                different = (spot[:, 1:] != spot[:, :-1]).sum(1) + (spot[:, 0] >= 0)
                ws = ws[different >= len(own) - most_of(n)]
                # windows most like the part come first, a verbatim one before all: of equal distances the first counts
                ws = ws[np.argsort(-(stack[ws] == part).sum(1), kind="stable")]
                for w in ws.tolist():
                    for x in by_window[lo[w] : lo[w + 1]].tolist():
                        c, s, r = int(chunk[x]), int(start[x]) - ahead, int(row[x])
                        if best.get((c, r, i), (1, 0))[0] == 0 or (c, r, i, s) in tried:
                            continue
                        if n < size:  # other parts point to the same place
                            tried.add((c, r, i, s))
                        _, h, at = parts[c]
                        d = distance(self.words[i], h[max(s - most, at[r]) : max(min(s + size + most, at[r + 1]), at[r])], most)
                        if d < best.get((c, r, i), (most + 1, 0))[0]:
                            best[c, r, i] = (d, s)
        for (c, r, i), (d, s) in best.items():
            ids, _, at = parts[c]
            yield int(ids[r]), self.ids[i], max(int(s - at[r]), 0), d, len(self.words[i])


def padded(h: np.ndarray, at: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with ``pad`` sentinels before and behind every text, the text of each, and per text where it starts and ends."""
    size = np.diff(at)
    lo = at[:-1] + pad * (2 * np.arange(len(size)) + 1)
    row = np.repeat(np.arange(len(size)), size + 2 * pad)
    place = np.arange(len(row))
    out = np.where(place < lo[row], START, END)
    out[(place >= lo[row]) & (place < lo[row] + size[row])] = h
    return out, row, lo, lo + size


def _bits(h: np.ndarray, width: int) -> np.ndarray:
    """A table of the first bits of names."""
    out = np.zeros(1 << width, bool)
    out[(h >> U(64 - width)).astype(np.int64)] = True
    return out


def _within(sorted_names: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_names[np.minimum(np.searchsorted(sorted_names, x), len(sorted_names) - 1)] == x


#: Words that are searched at once, about: every search goes over all items once.
FIND_WORDS = 1 << 22


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Lists of (ids, word hashes, offsets per text) of whole batches, of ``FIND_WORDS`` words or a little more, however small the batches are."""
    parts, n = [], 0
    for batch in batches:
        for ids, buf, offs in chunks(batch):
            _, _, h, at = words(buf, offs, lower=True, alnum=True)
            parts.append((ids, h, at))
            n += len(h)
        if n >= FIND_WORDS:
            yield parts
            parts, n = [], 0
    if parts:
        yield parts


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, distance, n_words of every item found in a document."""
    spark = docs.sparkSession
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text"))
    out = None
    block, size = [], 0  # size: bytes

    def passed(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)  # at most BLOCK items of about BLOCK_BYTES

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Items([i for i, _ in sent.value], [t for _, t in sent.value])
            for parts in gathered(batches):
                rows = list(found.find(parts))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    doc = pa.array([None if x == NULL_ID else x for x in cols[0]], pa.int64())
                    yield pa.RecordBatch.from_arrays([doc, *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["doc_id", "item_id", "first_word", "distance", "n_words"])

        return docs.select("doc_id", text_of().alias("text")).mapInArrow(read, OUT)

    for r in items.toLocalIterator():  # block by block: the driver holds one block
        block.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
        if len(block) == BLOCK or size >= BLOCK_BYTES:
            out = passed(block) if out is None else out.unionByName(passed(block))
            block, size = [], 0
    if block or out is None:
        out = passed(block) if out is None else out.unionByName(passed(block))
    return out.distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    doc = unused(docs, "found_doc")
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(doc)).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(doc)), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
