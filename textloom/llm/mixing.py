"""Mixing sources to target weights by subset-sum budget fitting.

1. size of every document; per (source, size) the number of documents: the histogram;
2. targets by weight, excess over twice a source's size reshared until none is above;
3. per source, whole passes over all documents take the target's full multiples; the rest of the
   budget goes out in equal shares over the lengths, and a bounded-knapsack dynamic programme over all
   length counts (a bit set of reachable sums) closes the gap: it may add documents that are left and
   give back documents that were taken, as long as the sum stays within ``ROOM`` mean documents' words;
4. per (source, size) the chosen number of documents is picked by seeded hash: ranges of the hash
   are counted first, and rows are ranked only in the range where the count runs out, so a
   length that a third of all rows share is never sorted in one task.

Step 3's programme has as many states as twice ``ROOM`` mean documents of the source have words, whatever
the number of documents. Where all sums of a source lie within that, its fit is the nearest there is;
otherwise it is the nearest that adding from the longest and giving back from the shortest reach without
leaving the states, and at worst the gap of the equal shares, less than the shortest document that is left. Only
source sizes (one row per source) come to the driver.

Edge cases: null text has size 0; null source is a source of its own, last in order; sources
without words take nothing; repeated rows are documents of their own and count as such; ties of
the hash are cut by text hash, and rows equal in both are interchangeable; empty tables give no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_WORD, documents, settle, text_of

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
SEED = 17
#: Documents of one length that share a range of the hash, about; only one range a length is ranked.
RANGE_ROWS = 10_000
#: Mean documents' words by which the programme may move away from the equal shares, either way.
ROOM = 64


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """Target words of each source; weights repeat over the sources in code point order, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, still = share * sum(sizes.values()), {}, list(order)
    while still:
        total = sum(weight[s] for s in still)
        over = [s for s in still if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in still}
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        still = [s for s in still if s not in over]
    return out


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take (at most its count) so that the words come nearest below ``budget``.

    The budget goes out in equal shares over the documents in order of length. The programme then moves
    away from these: for each change of the sum it keeps the item (documents of one length, added or given
    back) that first reached it, so memory is one number a state."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    if budget <= 0 or not total:
        return [0] * len(lengths)
    order = sorted((i for i in range(len(lengths)) if lengths[i] and counts[i]), key=lambda i: lengths[i])
    taken, before = [0] * len(lengths), 0
    for i in order:  # of the first k documents in order k * budget / total are taken
        taken[i] = (before + counts[i]) * budget // total - before * budget // total
        before += counts[i]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in order:  # rounding by length can take too many words: the shortest give them back
        if left < 0 and taken[i]:
            back = min(taken[i], -(left // lengths[i]))
            taken[i] -= back
            left += back * lengths[i]
    for i in reversed(order):  # or too few: the longest that fit are added
        more = min(counts[i] - taken[i], left // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    # bit w + b of ``reach`` is set if the sum can change by b; counts are split in powers of two
    w = max(left, -(-ROOM * total // before))
    items = []
    for long, short in zip(reversed(order), order, strict=True):  # what long ones add, short ones give back at once
        for i, sign, spare in ((long, 1, counts[long] - taken[long]), (short, -1, taken[short])):
            spare, k = min(spare, 2 * w // lengths[i]), 1
            while spare > 0:
                items.append((i, sign * min(k, spare)))
                spare, k = spare - k, 2 * k
    mask, reach = (1 << (2 * w + 1)) - 1, 1 << w
    first = np.full(2 * w + 1, -1, np.int32)
    for at, (i, k) in enumerate(items):
        if reach >> (w + left) & 1:  # the budget is met
            break
        step = lengths[i] * abs(k)
        fresh = (reach << step & mask if k > 0 else reach >> step) & ~reach
        if fresh:
            first[_ones(fresh)] = at
            reach |= fresh
    at = (reach & ((1 << (w + left + 1)) - 1)).bit_length() - 1
    while at != w:
        i, k = items[first[at]]
        taken[i] += k
        at -= lengths[i] * k  # a sum that earlier items alone reach
    return taken


def _ones(x: int) -> np.ndarray:
    """The places of the bits that are set."""
    data = np.frombuffer(x.to_bytes(x.bit_length() // 8 + 1, "little"), np.uint8)
    some = np.flatnonzero(data)
    row, bit = np.nonzero(np.unpackbits(data[some, None], axis=1, bitorder="little"))
    return some[row] * 8 + bit


def _sizes(docs: DataFrame) -> DataFrame:
    text = text_of()
    return docs.select("doc_id", "source", F.size(F.regexp_extract_all(text, F.lit(SPACE_WORD), F.lit(0))).cast("long").alias("size"), F.xxhash64(F.lit(SEED), "doc_id").alias("draw"), F.xxhash64(text).alias("tie"))


def mix(docs: DataFrame) -> DataFrame:
    """A row per document row: doc_id, source, size, source_size, target, taken."""
    spark = docs.sparkSession
    sized = settle(_sizes(docs))
    most = sized.groupBy("source", "size").count().agg(F.max("count")).head()[0] or 0
    sized = sized.withColumn("range", F.pmod("draw", F.lit(most // RANGE_ROWS + 1)).cast("long"))
    ranged = settle(sized.groupBy("source", "size", "range").agg(F.count("*").alias("n")))
    histogram = ranged.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sizes = {r["source"]: int(r["words"]) for r in histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()}  # a row per source
    goal = targets(sizes)
    plan_rows = [(s, sizes[s], float(goal[s]), int(goal[s] // sizes[s]) if sizes[s] else 0) for s in sizes]
    plan = spark.createDataFrame(plan_rows, "source string, source_size long, target double, passes int")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        budget = round(pdf["target"].iloc[0] - int(pdf["passes"].iloc[0]) * int(pdf["source_size"].iloc[0]))
        take = fit(pdf["size"].astype(int).tolist(), pdf["n"].astype(int).tolist(), int(budget))
        return pd.DataFrame({"key": pdf["key"], "size": pdf["size"].astype("int64"), "take": take}).astype({"take": "int64"})

    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("null"))  # noqa: E731  null-safe
    plan = plan.withColumn("key", key(F.col("source"))).drop("source")
    small = len(plan_rows) <= 10_000  # the check behind the broadcast
    plan = F.broadcast(plan) if small else plan
    # a group is one source's histogram: as many rows as it has distinct lengths
    chosen = histogram.withColumn("key", key(F.col("source"))).join(plan, "key").groupBy("key").applyInPandas(choose, "key string, size long, take long")
    # how many rows of each range of the hash to take: all below the cut, some in one range, none above
    before = F.coalesce(F.sum("n").over(W.partitionBy("key", "size").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = ranged.withColumn("key", key(F.col("source"))).drop("source").withColumn("before", before).join(chosen, ["key", "size"]).select("key", "size", "range", "n", F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("before"))).alias("quota"))
    marked = sized.withColumn("key", key(F.col("source"))).join(cuts, ["key", "size", "range"])
    whole = marked.where((F.col("quota") == 0) | (F.col("quota") == F.col("n"))).withColumn("extra", (F.col("quota") > 0).cast("long"))
    rank = F.row_number().over(W.partitionBy("key", "size", "range").orderBy("draw", "doc_id", "tie"))
    cut = marked.where((F.col("quota") > 0) & (F.col("quota") < F.col("n"))).withColumn("extra", (rank <= F.col("quota")).cast("long"))
    return whole.unionByName(cut).join(plan, "key").select("doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("extra"))).alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source")
