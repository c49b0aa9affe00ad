"""Packing documents into training sequences of at most ``LENGTH`` tokens.

1. every document becomes its token ids and an end id; what fills whole sequences is cut off in front,
   so that one piece shorter than a sequence is left of each document;
2. pieces are dealt to randomised groups of about ``GROUP_BYTES`` of text, by seeded hash of a row number:
   one document, source or doc_id weighs on no group more than another, and each group is packed alone;
3. a group is packed by first fit decreasing: a tournament tree over the capacities of the bins finds the
   first bin with room in as many steps as the tree is high;
4. what gaps are left is filled from the emptiest bins, whose pieces are cut where they do not fit, until at
   most one bin of the group has room; that one is cut at powers of two, which need no padding.

So a sequence is full, or as long as a power of two, and nothing is padded. Documents are tokenised once
and shuffled once, as 16-bit ids where the vocabulary allows. A group's memory is bounded by its bytes
of text, but for one document longer than that.

The tokenizer's file has to be readable at the same path on all executors. A byte-level BPE file whose
merges are in order of their ids is read into tiktoken, which finds the same ids some five times faster;
texts that hold an added token, and all other files, go to the tokenizers library itself.

Edge cases: null texts count as empty, and a document without a token still has its end id; a null doc_id
stays null; repeated rows are packed each, and their pieces cannot be told apart; texts of any length are
cut at spaces before they are tokenised; ties in length follow the row number; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_of

LENGTH, END_ID, SEED = 2048, 1, 23
GROUP_BYTES = 16_000_000
#: Characters that are tokenised at once, about.
RUN_CHARS = 1 << 18
#: Bytes of ids in a batch that a worker hands on, about.
OUT_BYTES = 1 << 22
#: How byte-level BPE splits text before its merges (fixed by the tokenizer's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def _bytes_of_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary by rank, where ids alone tell the order of the merges; else nothing."""
    model, split = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    letters, added = _bytes_of_letters(), {t["content"] for t in spec.get("added_tokens") or ()}
    vocab = {word: at for word, at in model["vocab"].items() if word not in added}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or len(vocab) != len(merged) + 256 or any(c not in letters for word in vocab for c in word):
        return None
    return {bytes(letters[c] for c in word): at for word, at in vocab.items()}


def runs(text: str, most: int = RUN_CHARS) -> Iterator[str]:
    """``text`` cut where no token can reach across: before a lone space between two characters that are no white space."""
    at = 0
    while len(text) - at > most:
        cut = text.find(" ", at + most)
        while 0 < cut < len(text) - 1 and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut <= 0 or cut == len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Encoder:
    """The ids of texts, without special tokens, by the file of a tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.whole = Tokenizer.from_file(path)
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        self.letter = "H" if self.whole.get_vocab_size() <= 1 << 16 else "I"
        self.fast = None
        if ranks := ranks_of(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.fast is None or any(a in text for a in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.letter)
        out = array(self.letter)
        for run in runs(text):
            out.extend(self.fast.encode_ordinary(run))
        return np.frombuffer(out, self.letter) if out else np.zeros(0, self.letter)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker."""
    return Encoder(path)


def _pieces(path: str, length: int, end_id: int):
    """Whole sequences and the rest of every document; ids in the vocabulary's narrowest kind."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, names, kinds = encoder(path), ("row", "doc_id", "start", "doc_tokens", "ids"), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        for batch in batches:
            for r in range(batch.num_rows):
                row, doc, text = (batch.column(c)[r].as_py() for c in range(3))
                ids = np.append(found.ids(text), np.array(end_id, found.letter))
                for start in range(0, len(ids), length):
                    rows.append((row, doc, start, len(ids), ids[start : start + length].tobytes()))
                    held += len(rows[-1][4]) + 64
                    if held > OUT_BYTES:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return read


class Bins:
    """First fit: a tournament tree whose nodes hold the larger capacity of their two halves."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, need: int) -> int:
        """The first bin with room for ``need``, which is taken from it."""
        tree, at = self.tree, 1
        while at < self.leaves:
            at *= 2
            if tree[at] < need:
                at += 1
        tree[at] -= need
        bin_ = at - self.leaves
        while at > 1:
            at //= 2
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
        return bin_


def first_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """The items of each bin, in order of falling size; sizes are 1 to ``length``, ties stay in order."""
    if not sizes:
        return []
    # two bins that are half empty would have become one: so many bins are never passed
    bins, out = Bins(2 * -(-sum(sizes) // length) + 1, length), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bins.put(sizes[item])
        if at == len(out):
            out.append([])
        out[at].append(item)
    return out


def closed(bins: list[list[tuple[int, int, int]]], length: int) -> list[list[tuple[int, int, int]]]:
    """The same pieces (item, start, size) in bins that are full or as large as a power of two.

    The fullest bins take from the emptiest, whole pieces if they fit; the last bin is cut by the digits of its size."""
    fill = [sum(p[2] for p in b) for b in bins]
    order = sorted((i for i in range(len(bins)) if fill[i] < length), key=lambda i: (-fill[i], i))
    low, high = 0, len(order) - 1
    while low < high:
        to, from_ = order[low], order[high]
        item, start, size = bins[from_].pop()
        part = min(size, length - fill[to])
        bins[to].append((item, start, part))
        fill[to] += part
        fill[from_] -= part
        if part < size:
            bins[from_].append((item, start + part, size - part))
        low += fill[to] == length
        high -= not fill[from_]
    out = [b for i, b in enumerate(bins) if b and fill[i] == length]
    for i in (i for i in range(len(bins)) if bins[i] and fill[i] < length):
        pieces = bins[i][::-1]
        for digit in (1 << k for k in reversed(range(fill[i].bit_length())) if fill[i] >> k & 1):
            out.append([])
            while digit:
                item, start, size = pieces.pop()
                part = min(size, digit)
                out[-1].append((item, start, part))
                digit -= part
                if part < size:
                    pieces.append((item, start + part, size - part))
    return out


def _packed(path: str, length: int):
    def pack(group: pa.Table) -> pa.Table:
        letter, number = encoder(path).letter, group.column("group")[0].as_py()
        group = group.sort_by([("row", "ascending"), ("start", "ascending")])
        ids = [np.frombuffer(x.as_buffer(), letter) for x in group.column("ids")]
        at, doc, tokens = (group.column(c).to_pylist() for c in ("start", "doc_id", "doc_tokens"))
        rest = [i for i, x in enumerate(ids) if len(x) < length]
        bins = [[(i, 0, length)] for i, x in enumerate(ids) if len(x) == length]
        bins += closed([[(rest[k], 0, len(ids[rest[k]])) for k in b] for b in first_fit_decreasing([len(ids[i]) for i in rest], length)], length)
        out: list[list] = [[] for _ in range(7)]
        for place, pieces in enumerate(bins):
            offset = 0
            for i, start, size in pieces:
                for column, value in zip(out, (doc[i], at[i] + start, size, tokens[i], (number << 32) + place, offset, ids[i][start : start + size].astype("<u4").tobytes()), strict=True):
                    column.append(value)
                offset += size
        return pa.Table.from_arrays([pa.array(c, pa.binary() if k == 6 else pa.int64()) for k, c in enumerate(out)], names=[c.split()[0] for c in PIECE.split(", ")])

    return pack


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, seed: int = SEED, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32-bit)."""
    size = docs.agg(F.sum(F.octet_length(text_of()).cast("long"))).head()[0] or 0  # one number
    groups = max(1, -(-size // group_bytes))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    cut = rows.mapInArrow(_pieces(path, length, end_id), "row long, doc_id long, start long, doc_tokens long, ids binary")
    dealt = cut.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row", "start"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(_packed(path, length), PIECE)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids (binary), lengths and doc_ids of its pieces: what a trainer reads; a group has one sequence's tokens."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids"))).alias("parts")
    ids = F.aggregate("parts", F.lit(b""), lambda made, p: F.concat(made, p["ids"]))
    return pieces.groupBy("sequence_id").agg(parts).select("sequence_id", ids.alias("ids"), F.col("parts.length").alias("lengths"), F.col("parts.doc_id").alias("doc_ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
