"""Exact Jaccard self-join of documents on word n-grams, with set-relation skipping.

Sets are kept sorted by the global order of their shingles' 64-bit names, and cut into blocks by
position in that order.

* Block skipping: two sets of sizes a and b that link at t per cent differ in at most
  (a+b)(100-t)/(100+t) shingles, a 19th of a+b at 90 and a 9th at 80, so of one block more than
  that, one must be equal in both. Index lists are kept per block and content
  of the block: all lists of a block but one are skipped at once, and a list shared by chance (a
  common line) needs several equal neighbours in the order (7 or more at 90, 3 or more at 80), not
  one shingle. Sizes fall in groups of ratio 100/t; a set enters the lists of its own and of the next smaller group. Of a
  set with more filled blocks than may differ a filled one must be equal; a block empty in both sets
  counts as equal too, and other sets list their empty blocks.
* Answers from similar sets: equal sets share one answer (a class). In each list the set with the
  most list neighbours overall is the hub. A set is held against the hub it shares most
  lists with; if they link, it takes over the hub's component, and pairs with sets of that component
  are skipped. Only pairs from lists that still hold several components are tried on their own.
* A pair is verified exactly only if the parity sketches of its two sets, made when the sets are named,
  do not rule it out: they differ in at most as many places as the sets in shingles.

The result is the components of all links; every link either lies within one or is verified.
Sets are named by 64-bit sums of their shingles' names, and verified on 48 bits of each name.

Edge cases: null or empty texts have no shingles and link with nothing; texts of fewer than n words
are one shingle; repeated rows are equal sets; null doc_ids come last, their component is null if no
other document is in it; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import U, chunks, mix, mixed, signed, words
from .common import NULL_ID, bound_batches, documents, n_partitions, release, settle, text_of, unused
from .components import connect
from .repeats import SAMPLE_DOCS, hot_keys

#: Fixed values of the op10 contract: words of a shingle, least Jaccard in per cent.
N, PERCENT = 3, 90
_A, _B, _C = (U(mixed(x) | 1) for x in (11, 12, 13))
_EMPTY = U(mixed(14))


@cache
def _bounds(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Least sizes of the size groups: two linked sets are in one group or in neighbours."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * 100 // percent + 1)
    return np.array([*out, out[-1] * 100 // percent + 1], np.int64)


def _apart(total, percent: int):
    """Most shingles in which linked sets of ``total`` shingles together may differ."""
    return total * (100 - percent) // (100 + percent)


def shingles(buf: np.ndarray, offs: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of a chunk: names sorted by (text, name), their text, offsets per text."""
    _, _, h, at = words(buf, offs, lower=True)
    count = np.diff(at)
    row = np.repeat(np.arange(len(count)), count)
    short = (count > 0) & (count < n)
    name = np.full(len(h), 0, np.uint64)
    long = max(0, len(h) - n + 1)
    for i in range(n):
        name[:long] = mix(name[:long] * _A + h[i : i + long] + _B)
    left = np.repeat(at[1:], count) - np.arange(len(h))
    good = left >= n
    row_s = np.flatnonzero(short)
    if len(row_s):  # fewer words than n: the whole sequence
        whole = np.zeros(len(row_s), np.uint64)
        for i in range(n - 1):
            has = count[row_s] > i
            whole[has] = mix(whole[has] * _A + h[at[row_s[has]] + i] + _C)
        name, row = np.concatenate([name[good], whole]), np.concatenate([row[good], row_s])
    else:
        name, row = name[good], row[good]
    order = np.lexsort((name, row))
    name, row = name[order], row[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    name, row = name[new], row[new]
    return name, row, np.searchsorted(row, np.arange(len(count) + 1))


def _sums(name: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(mix(name + _C), out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _sigs(name: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return signed(mix(_sums(name, offs) + np.diff(offs).astype(np.uint64) * _A))


SKETCH_BITS = 1024
#: Sets whose sketches are counted at once.
SKETCH_ROWS = 256


def sketches(name: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Of each set the parities of its shingles over ``SKETCH_BITS`` places: two sets' sketches differ in at most as many places as the sets in shingles."""
    place = (mix(name) >> U(54)).astype(np.int64)
    out = []
    for i in range(0, len(at) - 1, SKETCH_ROWS):
        ends = at[i : i + SKETCH_ROWS + 1]
        rows = len(ends) - 1
        slot = np.repeat(np.arange(rows) * SKETCH_BITS, np.diff(ends)) + place[ends[0] : ends[-1]]
        odd = (np.bincount(slot, minlength=rows * SKETCH_BITS) & 1).astype(np.uint8)
        out += [row.tobytes() for row in np.packbits(odd.reshape(rows, SKETCH_BITS), axis=1)]
    return out


def wide_sketches(name: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """Of each set of more than ``SKETCH_BITS`` shingles its parities over as many places as it has shingles or more (a power of two), else none.

    Long sets fill a sketch of fixed width, so that it rules out nothing."""
    out = [None] * (len(at) - 1)
    for i in np.flatnonzero(np.diff(at) > SKETCH_BITS):
        own = name[at[i] : at[i + 1]]
        bits = (len(own) - 1).bit_length()
        odd = np.bincount((mix(own) >> U(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8)).tobytes()
    return out


def wide_apart(one: bytes, two: bytes) -> int:
    """Places in which two wide sketches differ; the wider one is folded: two places next to each other are one of the narrower."""
    a, b = (np.unpackbits(np.frombuffer(x, np.uint8)) for x in sorted((one, two), key=len))
    while len(b) > len(a):
        b = b[::2] ^ b[1::2]
    return int(np.count_nonzero(a ^ b))


def near_sketches(percent: int) -> Callable:
    """Rows of (a, b, a_size, b_size, a_sketch, b_sketch, a_wide, b_wide) to the pairs (a, b) that their sketches do not rule out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(len(size), SKETCH_BITS // 64) for i in (4, 5))
            near = np.bitwise_count(one ^ two).sum(1) <= _apart(size, percent)
            for i in np.flatnonzero(near & ~(batch.column(6).is_null().to_numpy(zero_copy_only=False) | batch.column(7).is_null().to_numpy(zero_copy_only=False))):
                near[i] = wide_apart(batch.column(6)[i].as_py(), batch.column(7)[i].as_py()) <= _apart(size[i], percent)
            near = pa.array(near)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], names=["a", "b"])

    return read


def likely(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) that may link by the sketches in ``held`` (sig, n, sketch, wide). The ends that may be in many pairs come first, while rows are short."""
    of = lambda x: held.select(F.col("sig").alias(x), F.col("n").alias(f"{x}_size"), F.col("sketch").alias(f"{x}_sketch"), F.col("wide").alias(f"{x}_wide"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch", "a_wide", "b_wide")
    return both.mapInArrow(near_sketches(percent), "a long, b long")


def named_sets(n: int) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, buf, offs in chunks(batch):
                name, _, at = shingles(buf, offs, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.diff(at)), pa.array(_sigs(name, at)), pa.array(sketches(name, at), pa.binary()), pa.array(wide_sketches(name, at), pa.binary())], names=["doc", "n", "sig", "sketch", "wide"])

    return read


def _listed(name: np.ndarray, row: np.ndarray, at: np.ndarray, sig: np.ndarray, percent: int):
    """Index entries of a chunk's sets: list, size, sig."""
    size, bounds = np.diff(at), _bounds(percent)
    # more blocks where they are so small that many are empty: a set with more filled blocks than may differ lists no empty ones
    spare = 2.5 * math.exp(-(100 + percent) / (2 * (100 - percent)) * (percent / 100) ** 2)
    group = np.searchsorted(bounds, size, "right") - 1
    total = np.zeros(len(name) + 1, np.uint64)
    np.cumsum(mix(name + _B), out=total[1:])
    for back in (0, 1):
        k = group - back  # the list family of groups k and k + 1
        most = _apart(2 * (bounds[np.maximum(k, 0) + 2] - 1), percent)  # shingles in which linked sets of it may differ
        use = (k >= 0) & (most > 0) & (size > 0)
        p = np.where(use, most + 2 + (most * spare).astype(np.int64), 0)
        block = ((name >> U(32)) * p[row].astype(np.uint64)) >> U(32)
        new = np.ones(len(name), bool)
        new[1:] = (row[1:] != row[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new & use[row])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(name))[np.searchsorted(starts, first)]
        r = row[first]
        which = mix((k[r].astype(np.uint64) << U(32)) + block[first])
        yield signed(mix(total[ends] - total[first] + which)), size[r], sig[r]
        filled = np.bincount(r, minlength=len(size))
        for i in np.flatnonzero(use & (filled <= most)):
            has = np.zeros(p[i], bool)
            has[block[at[i] : at[i + 1]].astype(np.int64)] = True
            none = np.flatnonzero(~has).astype(np.uint64)
            yield signed(mix(_EMPTY + mix((np.uint64(k[i]) << U(32)) + none))), np.full(len(none), size[i]), np.full(len(none), sig[i])


def listed(n: int, percent: int, turn: int = 0, turns: int = 1) -> Callable:
    """Index entries of all sets in the lists of one of ``turns`` turns; sets equal to one before them in the batch add none."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.int64)
            for ids, buf, offs in chunks(batch):
                name, row, at = shingles(buf, offs, n)
                sig = _sigs(name, at)
                fresh = np.zeros(len(ids), bool)
                fresh[np.unique(sig, return_index=True)[1]] = True
                fresh &= ~np.isin(sig, seen)
                seen = np.concatenate([seen, sig[fresh]])
                keep = fresh[row]
                name, row = name[keep], row[keep]
                at = np.searchsorted(row, np.arange(len(ids) + 1))
                parts = list(_listed(name, row, at, sig, percent))
                columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                own = columns[0] % turns == turn
                yield pa.RecordBatch.from_arrays([pa.array(c[own]) for c in columns], names=["list", "size", "sig"])

    return read


def hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by list, size, sig: each set but a list's first, with that first (the hub).

    Of hot lists, which stand in several tasks, the first of each task is kept too."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, size, sig = (batch.column(i).to_numpy() for i in range(3))
        hot = batch.column(3).to_numpy(zero_copy_only=False)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        new[0] = last is None or key[0] != last[0]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        hub, hub_size = sig[np.maximum(lead, 0)], size[np.maximum(lead, 0)]
        if last is not None:
            hub, hub_size = np.where(lead < 0, last[1], hub), np.where(lead < 0, last[2], hub_size)
        keep = hot | (~new & (sig != hub))
        same = np.zeros(len(key), bool)
        same[1:] = (key[1:] == key[:-1]) & (sig[1:] == sig[:-1])
        keep &= ~same
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, size, sig, hub, hub_size)], names=["list", "size", "sig", "hub", "hub_size"])
        last = (int(key[-1]), int(hub[-1]), int(hub_size[-1]))


def _packed(name: np.ndarray) -> bytes:
    """48 bits of each name, in order: six bytes each."""
    return np.ascontiguousarray(name.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, 2:] = six
    return out.view(">u8").astype(np.uint64).ravel()


#: Bits of the table of wanted documents that every task gets: a fixed size, whatever the input.
TABLE_BITS = 1 << 25


def wanted_table(want: DataFrame) -> np.ndarray:
    """A bit table of the hashes of wanted doc_ids; it also holds some others, the join behind it drops them."""
    bit = F.pmod(F.xxhash64("rep"), F.lit(TABLE_BITS))
    rows = want.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {TABLE_BITS}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most TABLE_BITS / 64 rows
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def wanted_sets(n: int, sent) -> Callable:
    """Rows of (doc_id, text, slot) to the sets of the texts whose slot is in the table."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            hit = (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & U(1)
            for ids, buf, offs in chunks(batch.filter(pa.array(hit.astype(bool)))):
                name, _, at = shingles(buf, offs, n)
                items = pa.array([_packed(name[at[i] : at[i + 1]]) for i in range(len(ids))], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(_sigs(name, at)), items], names=["doc", "sig", "items"])

    return read


def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by a, salt, own first: (a, salt, b, items); the common shingles of a and each b."""
    at, mine = None, None
    for batch in batches:
        out = []
        for a, salt, b, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            theirs = _unpacked(items.as_buffer())
            if b is None:
                at, mine = (a, salt), theirs
            elif at == (a, salt):
                both = np.concatenate([mine, theirs])
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                out.append((a, b, common, len(mine), len(theirs)))
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "common", "a_size", "b_size"])


SALT_ROWS = 2000
#: Sets of a list that meet in one task, about: lists are cut into blocks of so many.
BLOCK_ROWS = 1000
#: The entries of all lists are a multiple of the input, most of them alone in their list: they are shuffled in so many turns, a share of the lists each.
TURNS = 2
#: Of the open lists of a set the least so many tell in which list a pair met before.
FIRST_LISTS = 16


def verify(base: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """Exact sizes of ``pairs`` (a, b): common, a_size, b_size, settled. A hub with many partners is dealt to several tasks."""
    degree = pairs.groupBy("a").agg(F.count("*").alias("degree"))
    salts = degree.select("a", F.ceil(F.col("degree") / SALT_ROWS).cast("int").alias("salts"))
    want = settle(pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct().join(classes, "sig").select("sig", F.col("doc").alias("rep")))
    sent = pairs.sparkSession.sparkContext.broadcast(wanted_table(want))
    slot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(NULL_ID))), F.lit(TABLE_BITS))
    found = base.select("doc_id", "text", slot.alias("slot")).mapInArrow(wanted_sets(n, sent), "doc long, sig long, items binary")
    # rows that share a doc_id and text give their set once
    held = settle(found.join(want.withColumnRenamed("sig", "w_sig"), (F.col("sig") == F.col("w_sig")) & (F.col("doc") == F.col("rep")), "left_semi").select("sig", "items"))
    release(pairs.sparkSession, want)
    sets = held.dropDuplicates(["sig"])
    partners = pairs.join(salts, "a").join(sets, pairs.b == sets.sig).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "items")
    own = salts.join(sets, salts.a == sets.sig).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "items")
    dealt = partners.unionByName(own).repartition(n_partitions(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    out = settle(dealt.mapInArrow(intersect, "a long, b long, common long, a_size long, b_size long"))
    release(pairs.sparkSession, held)
    return out


def oriented(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the set that is in more of them as a, whose partners are dealt to several tasks.

    A set is then b in at most the square root of twice the number of pairs, so no join by b has a hot key."""
    ends = pairs.select(F.col("a").alias("end")).unionByName(pairs.select(F.col("b").alias("end"))).groupBy("end").agg(F.count("*").alias("degree"))
    of = lambda x: ends.select(F.col("end").alias(x), F.struct("degree", "end").alias(f"of_{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select(F.greatest("of_a", "of_b")["end"].alias("a"), F.least("of_a", "of_b")["end"].alias("b"))


def linked(percent: int) -> str:
    return f"100 * common >= {percent} * (a_size + b_size - common)"


def cross_pairs(percent: int) -> Callable:
    """Of entries sorted by list, lo, hi, size: (list, lo, hi, block, size, sig, comp, firsts, sketch): pairs across components that may link.

    A list stands in blocks, two of them (lo, hi) at a time; a set meets the sets before it in the other
    block (in its own, if both are one) whose size is near enough and whose sketch differs in no more places
    than linked sets may differ in shingles. A pair is left out where the least lists of the two show that it
    meets in a lesser list too: its least list is never left out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, m, bits = None, np.zeros((64, 4), np.int64), 0, np.zeros((64, SKETCH_BITS // 64), np.uint64)
        lesser = np.zeros((64, FIRST_LISTS), np.int64)
        for batch in batches:
            out_a, out_b = [], []
            cols = [batch.column(i).to_pylist() for i in range(9)]
            for k, lo, hi, block, size, sig, comp, firsts, data in zip(*cols, strict=True):
                if (k, lo, hi) != key:
                    key, m = (k, lo, hi), 0
                mine = np.frombuffer(data, np.uint64)
                own = np.full(FIRST_LISTS, k)  # this list and what follows it prove nothing
                own[: len(firsts)] = np.minimum(firsts, k)
                n, c = held[:m, 0], held[:m, 2]
                at = np.flatnonzero((100 * n >= percent * size) & (c != comp) & ((held[:m, 3] != block) | (lo == hi)))
                if len(at):
                    apart = np.bitwise_count(bits[at] ^ mine).sum(1)
                    near = at[apart <= _apart(n[at] + size, percent)]
                    if len(near):
                        shown = (lesser[near][:, :, None] == own[own < k]).any((1, 2))
                        near = near[~shown]
                    out_a += np.minimum(held[near, 1], sig).tolist()
                    out_b += np.maximum(held[near, 1], sig).tolist()
                if m == len(held):
                    held, bits, lesser = (np.concatenate([x, np.zeros_like(x)]) for x in (held, bits, lesser))
                held[m], bits[m], lesser[m], m = (size, sig, comp, block), mine, own, m + 1
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return read


def join(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, sig, component_id of every row of ``docs``; sets of ``n`` words link from a Jaccard of ``percent``/100 on."""
    spark = docs.sparkSession
    bound_batches(spark)
    parts = n_partitions(spark)
    base = docs.select("doc_id", text_of().alias("text"))
    sets = settle(base.mapInArrow(named_sets(n), "doc long, n long, sig long, sketch binary, wide binary"))
    classes = sets.where("n > 0").groupBy("sig").agg(F.min("doc").alias("doc"))
    rows = sets.count()
    few = base.sample(SAMPLE_DOCS / rows, seed=1) if rows > SAMPLE_DOCS else base
    hot = hot_keys(few.mapInArrow(listed(n, percent), "list long, size long, sig long").withColumnRenamed("list", "key"), min(rows, SAMPLE_DOCS))
    starred, turns = [], TURNS if rows > SAMPLE_DOCS else 1
    for turn in range(turns):
        lists = base.mapInArrow(listed(n, percent, turn, turns), "list long, size long, sig long")
        lists = lists.join(F.broadcast(hot), F.col("list") == F.col("hot_key"), "left").select("list", "size", "sig", F.col("hot_key").isNotNull().alias("hot"))
        dealt = lists.repartition(parts, "list", F.when(F.col("hot"), F.col("sig"))).sortWithinPartitions("list", "size", "sig")
        starred.append(settle(dealt.mapInArrow(hubs, "list long, size long, sig long, hub long, hub_size long")))
        release(spark)
    starred = reduce(DataFrame.unionByName, starred)
    # entries of lists with several sets; a list's hub is its set with most list neighbours overall
    entries = settle(starred.select("list", "size", "sig").unionByName(starred.select("list", F.col("hub_size").alias("size"), F.col("hub").alias("sig")).distinct()))
    release(spark, starred)
    width = entries.groupBy("list").agg(F.count("*").alias("width"))
    central = entries.join(width, "list").groupBy("sig").agg(F.sum("width").alias("central"))
    middle = entries.join(central, "sig").groupBy("list").agg(F.max(F.struct("central", "sig", "size")).alias("m")).select("list", F.col("m.sig").alias("hub"), F.col("m.size").alias("hub_size"))
    near = entries.join(middle, "list").where(f"sig <> hub AND 100 * hub_size >= {percent} * size AND 100 * size >= {percent} * hub_size")
    # of those the one that a set shares most lists with
    best = near.groupBy("sig", "hub").agg(F.count("*").alias("shared")).groupBy("sig").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"))
    # repeated sets give one sketch before they are shuffled
    held = settle(sets.where("n > 0").select("sig", "n", "sketch", "wide").dropDuplicates(["sig"]).join(entries.select("sig").distinct(), "sig", "left_semi"))
    pairs = best.select(F.least("hub", "sig").alias("lo"), F.greatest("hub", "sig").alias("hi"), F.col("hub").alias("a"), F.col("sig").alias("b")).dropDuplicates(["lo", "hi"]).select("a", "b")
    tried = verify(base, classes, settle(likely(pairs, held, percent)), n)
    links = tried.where(linked(percent)).select("a", "b")
    comps = connect(links)
    # lists that still hold several components
    sketched = held.select(F.col("sig").alias("t_sig"), "sketch")
    placed = entries.join(comps, entries.sig == comps.node, "left").select("list", "size", "sig", F.coalesce("comp", "sig").alias("comp"))
    mixed_lists = placed.groupBy("list").agg((F.min("comp") < F.max("comp")).alias("several")).where("several").select("list")
    blocks = width.select("list", F.ceil(F.col("width") / BLOCK_ROWS).cast("int").alias("blocks"))
    open_rows = settle(placed.join(mixed_lists.join(blocks, "list"), "list").withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")))
    # a set's own lists: no more than it has blocks
    firsts = open_rows.groupBy("sig").agg(F.slice(F.sort_array(F.collect_list("list")), 1, FIRST_LISTS).alias("firsts"))
    about = firsts.join(sketched, F.col("sig") == F.col("t_sig")).select("t_sig", "firsts", "sketch")
    known = open_rows.join(about, F.col("sig") == F.col("t_sig"))
    met = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "size", "sig", "comp", "firsts", "sketch")
    crossed = met.repartition(parts, "list", "lo", "hi").sortWithinPartitions("list", "lo", "hi", "size", "sig").mapInArrow(cross_pairs(percent), "a long, b long").distinct()
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    crossed = settle(crossed.join(done, ["a", "b"], "left_anti"))
    release(spark, open_rows)
    if not crossed.isEmpty():
        # pairs of long sets grow with the square of their number: their wide sketches rule out most before a set is moved
        close = settle(likely(oriented(crossed), held, percent))
        release(spark, crossed)
        more = verify(base, classes, close, n).where(linked(percent)).select("a", "b")
        comps = connect(settle(links.unionByName(more)))
    labelled = classes.join(comps, classes.sig == comps.node, "left").select("sig", "doc", F.coalesce("comp", "sig").alias("comp"))
    least = labelled.groupBy("comp").agg(F.min("doc").alias("component"))
    by_sig = labelled.join(least, "comp").select("sig", "component")
    null_id = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    alone = sets.where("n = 0").select("doc", "n", "sig", F.col("doc").alias("component"))
    return sets.where("n > 0").join(by_sig, "sig").select("doc", "n", "sig", "component").unionByName(alone).select(null_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "sig", null_id("component").alias("component_id"))


#: So many ids at most are broadcast.
SENT_IDS = 2_000_000


def keep_one(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` without all but the first document of each component; documents without shingles stay.

    A document is a doc_id: rows that share one stay or go together, and rows without one all stay."""
    doc = unused(docs, "doc")
    joined = join(docs, n, percent).where("doc_id IS NOT NULL")
    gone = settle(joined.groupBy(F.col("doc_id").alias(doc)).agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays").select(doc))
    release(docs.sparkSession)
    # the ids that go are sent to the texts, which are shuffled only if these are very many
    return docs.join(F.broadcast(gone) if gone.count() <= SENT_IDS else gone, F.col("doc_id") == F.col(doc), "left_anti")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir)).drop("sig")
