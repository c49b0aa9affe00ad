"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek and full-width look-alikes) to Latin letters
and digits and signs to the letters they replace. The lexicon is learned: from a bounded sample
of labelled rows outside the held-out fold, every folded word with its log-odds of standing in a
toxic document, where they are sure enough, and likewise stems (the first 4 to 8 letters of longer
words, written with a star). An automaton finds them in every whole text: words as whole words,
stems where a word starts; of what starts at one place the heaviest counts, and nothing
inside an exception phrase. The weight found, over the logarithm
of the length, becomes a score between 0 and 1 by a logistic curve fitted on the same sample.

Edge cases: null and empty texts score as texts without a match; without labels, or without a word
that is sure enough, all scores are the prior (0.5 without labels); repeated rows score alike;
null doc_ids stay; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, documents, table
from .labelled import MOST_ROWS, held_out, sample

FOLD_BY, FOLD_REST = 4, 2
THRESHOLD = 0.3
#: Look-alike letters and the Latin letters they stand for (fixed values).
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "τ": "t"}
#: Digits and signs and the letters they replace (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases whose words do not count.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "clown fish", "class clown"]
#: A word joins the lexicon with at least so many toxic sample documents and so high a lower bound of its log-odds.
LEAST_DOCS, LEAST_ODDS = 5, 1.5
STEMS = range(4, 9)

_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
_FOLD |= {ord(k.upper()): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1}
_FOLD |= {c: chr(c + 32) for c in range(65, 91)} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    return text.translate(_FOLD).lower()


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        word, y = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set(_WORD.findall(fold(text)))
            found |= {w[:k] + "*" for w in found for k in STEMS if len(w) > k}
            word += found
            y += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(y, pa.int32())], names=["word", "y"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Weights of all words that mark toxic texts; their number is bounded by the sample's."""
    totals = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("t")).first()
    n_toxic, n_clean = int(totals["t"]), int(totals["n"] - totals["t"])
    counts = rows.select("text", "y").mapInArrow(_words_of, "word string, y int").groupBy("word").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (n_clean - F.col("c") + 0.5))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    sure = counts.where(F.col("t") >= LEAST_DOCS).select("word", odds.alias("odds"), (odds - 2 * spread).alias("low")).where(F.col("low") >= LEAST_ODDS)
    return {r["word"]: float(r["odds"]) for r in sure.collect()}


def automaton(lexicon: dict[str, float]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in {w.rstrip("*") for w in lexicon}:
        found.add_word(word, (len(word), lexicon.get(word), lexicon.get(word + "*")))
    for phrase in EXCEPTIONS:
        found.add_word(phrase, (len(phrase), None, None))
    found.make_automaton()
    return found


def weigh(found, text: str) -> float:
    """Weight of the lexicon's words in a text, over the logarithm of its length."""
    low = fold(text)
    hits, spared = {}, []
    for last, (size, whole, stem) in found.iter(low):
        first = last - size + 1
        if first and low[first - 1].isalnum():
            continue
        ends = last + 1 == len(low) or not low[last + 1].isalnum()
        if whole is None and stem is None:
            if ends:
                spared.append((first, last))
            continue
        weight = max(whole if whole is not None and ends else 0.0, stem if stem is not None and not ends else 0.0)
        hits[first] = max(hits.get(first, 0.0), weight)
    total, spans = 0.0, iter(sorted(spared))
    span = next(spans, None)
    for at in sorted(hits):
        while span is not None and span[1] < at:
            span = next(spans, None)
        if span is None or at < span[0]:
            total += hits[at]
    return total / math.log(len(low) + 20.0)


def _weights(lexicon: dict[str, float], curve: tuple[float, float] | None):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon)
        for batch in batches:
            x = np.array([weigh(found, t or "") for t in batch.column(1).to_pylist()], float)
            if curve is not None:
                x = 1 / (1 + np.exp(-(curve[0] + curve[1] * x)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x)], names=[batch.schema.names[0], "score"])

    return read


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of one variable by Newton's steps, slightly held back."""
    a, b = 0.0, 0.0
    design = np.column_stack([np.ones_like(x), x])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        grad = design.T @ (y - p) - 1e-3 * np.array([0, b])
        hess = design.T @ (design * (p * (1 - p))[:, None]) + np.diag([1e-6, 1e-3])
        step = np.linalg.solve(hess, grad)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


#: The curve without any label: no text is taken for toxic.
UNTAUGHT = (-30.0, 0.0)


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[dict[str, float], tuple[float, float]]:
    """Lexicon and curve from at most ``most`` labelled rows outside the held-out fold."""
    bound_batches(docs.sparkSession)
    rows = sample(docs, labels, "toxic", FOLD_BY, FOLD_REST, most)
    lexicon = learn_lexicon(rows)
    got = rows.select(F.col("y").cast("double").alias("y"), "text").mapInArrow(_weights(lexicon, None), "y double, score double").collect()  # at most ``most`` pairs of numbers
    if not got:
        return lexicon, UNTAUGHT
    return lexicon, fit_curve(np.array([r["score"] for r in got]), np.array([r["y"] for r in got]))


def score(docs: DataFrame, lexicon: dict[str, float], curve: tuple[float, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = docs.select("doc_id", "text").mapInArrow(_weights(lexicon, curve), "doc_id long, score double")
    return scored.select("doc_id", held_out(FOLD_BY, FOLD_REST).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, lexicon: dict[str, float], curve: tuple[float, float], least: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score ``least`` or more; one pass, no shuffle."""
    at = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon)
        for batch in batches:
            x = np.array([weigh(found, t or "") for t in batch.column(at).to_pylist()], float)
            yield batch.filter(pa.array(1 / (1 + np.exp(-(curve[0] + curve[1] * x))) < least))

    return docs.mapInArrow(read, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, *learn(docs, table(spark, sf_dir, "labels")))
