"""Vectorised hashing of texts: whole Arrow batches at a time, no Python loop over words.

Names (64-bit hashes) of byte ranges come from prefix sums of ``T[byte] * M**i`` modulo the prime
2**31 - 1, for two bases M and two tables T, so that any range of a chunk is named in constant time,
equal ranges alike wherever they stand. Two different ranges of n bytes share a name only if both
bases, drawn at random once, are roots of the ranges' difference, a polynomial with at most n of them:
no text is built to collide whatever the bases, as there is modulo a power of two.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MASK = (1 << 64) - 1
CHUNK = 1 << 18
#: The prime, by which sums are folded without a division.
P = U((1 << 31) - 1)
BITS = U(31)

_draw = np.random.Generator(np.random.PCG64(20240611))
_M = [int(x) for x in _draw.integers(1 << 20, int(P) - 1, 2)]
_T = np.array([_draw.choice(int(P) - 1, 256, replace=False) + 1 for _ in _M], np.uint64)
_TL = _T.copy()
_TL[:, 65:91] = _T[:, 97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_CUT = np.ones(256, bool)
_CUT[48:58] = False
_CUT[65:91] = False
_CUT[97:123] = False
_CUT[128:] = False
_pow = {"n": 0, "m": None, "i": None}


def _fold(x: np.ndarray) -> np.ndarray:
    """The same residue, of 32 bits at most if ``x`` has 62."""
    return (x & P) + (x >> BITS)


def _residue(x: np.ndarray) -> np.ndarray:
    """The residue itself; ``x`` has 63 bits at most."""
    x = _fold(_fold(x))
    return np.where(x >= P, x - P, x)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i up to n and either base; grows with the longest chunk only."""
    if _pow["n"] < n + 1:
        size = max(n + 1, CHUNK + CHUNK // 2)
        for k, bases in (("m", _M), ("i", [pow(m, -1, int(P)) for m in _M])):
            out = np.ones((2, size), np.uint64)
            for row, base in zip(out, bases, strict=True):
                have = 1
                while have < size:  # the part that is there, by the power that follows it
                    more = min(have, size - have)
                    row[have : have + more] = _residue(row[:more] * U(pow(base, have, int(P))))
                    have += more
            _pow[k] = out
        _pow["n"] = size
    return _pow["m"], _pow["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def mixed(x: int) -> int:
    return int(mix(np.array([x & MASK], np.uint64))[0])


#: Elements that are worked on at once: larger arrays cost more in fresh memory than in arithmetic.
BLOCK = 1 << 13


def _summed(values: Callable[[int, slice], np.ndarray], n: int) -> np.ndarray:
    m, _ = powers(n)
    out = np.zeros((2, n + 1), np.uint64)
    for k in (0, 1):
        for i in range(0, n, BLOCK):
            at = slice(i, min(i + BLOCK, n))
            v = values(k, at) * m[k, at]
            v = _fold(v)
            v[0] += out[k, i]
            np.cumsum(v, out=out[k, at.start + 1 : at.stop + 1])
    return out


def prefix(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """p with p[:, i] the two sums over the first i bytes."""
    table = _TL if lower else _T
    return _summed(lambda k, at: table[k][buf[at]], len(buf))


def prefix_of(units: np.ndarray) -> np.ndarray:
    """p with p[:, i] the two sums over the first i units, which are names themselves: each sum takes half of a name."""
    return _summed(lambda k, at: units[at] >> U(31 * k) & P, len(units))


def names(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Names of the ranges [start, end)."""
    _, inv = powers(p.shape[1])
    out = np.empty(len(start), np.uint64)
    for i in range(0, len(start), BLOCK):
        s, e = start[i : i + BLOCK], end[i : i + BLOCK]
        one, two = (_residue(_fold(p[k][e] - p[k][s]) * inv[k][s]) for k in (0, 1))
        out[i : i + BLOCK] = mix((one | two << BITS) + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    return out


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) of runs of whole texts of about CHUNK bytes; batch: doc_id, text."""
    ids = batch.column(0)
    if ids.null_count:
        ids = ids.fill_null(2**63 - 1)
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    col = batch.column(1)
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
        j = min(j, len(ids))
        yield ids[i:j], data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(buf: np.ndarray, offs: np.ndarray, lower: bool = False, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, names, and per text the offsets into them.

    Words are cut at white space, or with ``alnum`` at everything in ASCII but letters and digits.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    gap = (_CUT if alnum else _SPACE)[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True
    start = ~gap
    start[1:] &= gap[:-1] | first[1:-1]
    end = ~gap
    end[:-1] &= gap[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, names(prefix(buf, lower), s, e), np.searchsorted(s, offs)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """out[i] = min(v[i:i+w]); the end is filled as if v went on with its largest value."""
    if w <= 1:
        return v
    out, have, top = v.copy(), 1, np.iinfo(v.dtype).max
    pad = np.full(min(w, len(v) + w), top, v.dtype)
    out = np.concatenate([out, pad])
    while have < w:
        step = min(have, w - have)
        out[:-step] = np.minimum(out[:-step], out[step:])
        have += step
    return out[: len(v)]
