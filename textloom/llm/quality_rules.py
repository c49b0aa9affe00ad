"""Quality rules: a threshold table compiled into one projection, without user functions.

``RULES`` holds (name, measure, least, most). ``measure_columns`` gives every measure as a column
and ``verdict`` the conjunction of all rows, so Catalyst plans one scan and one projection; there
is no shuffle. Windows of words are named by 64-bit hashes within their own text.

Edge cases: null or empty text has no words and fails the base rule; repeated rows are judged
alike; null doc_ids stay null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_WORD, documents, text_of

#: Frequent function words of four languages (fixed values).
STOP_WORDS = "a al als an and are as at au auf aus avec be bei but by con das de del dem den der des die dans du e ein eine el elle en es est et for from für he her his il im in is ist it la las le les los mais mit nicht no not of on or os ou para par pas pour por que qui se sich sie son sur te that the this to un una und une von was were with y zu".split()
#: name, measure, least, most (None: no bound).
RULES = [
    ("length", "n_words", 20, None),
    ("repetition", "repeat_ratio", None, 0.30),
    ("symbols", "symbol_ratio", None, 0.50),
    ("short_words", "mean_word", 2.0, None),
    ("long_words", "mean_word", None, 16.0),
    ("repeated_lines", "dup_line_ratio", None, 0.50),
    ("stop_words", "stop_ratio", 0.02, None),
]
WINDOW = 8


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the base counts of every whole text."""
    text = F.col("text")
    drop = lambda c, chars: F.length(F.translate(c, chars, ""))
    has_word = lambda line: F.length(F.translate(line, "\x20\x09\x0a\x0b\x0c\x0d", "")) > 0
    base = docs.select("doc_id", text_of().alias("text"))
    split = base.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(SPACE_WORD), F.lit(0)).alias("ws"),
        (F.length(text) - drop(text, "#*$%&|<>")).cast("long").alias("n_symbols"),
        drop(text, "\x20\x09\x0a\x0b\x0c\x0d").cast("long").alias("word_chars"),
        F.filter(F.split("text", "\n", -1), has_word).alias("lines"),
    )
    n = F.size("ws")
    named = split.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "n_symbols",
        "word_chars",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("ws", lambda w: F.lower(w).isin(STOP_WORDS))).alias("n_stop"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("ws", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("hashes"),
    )
    # most texts repeat no window; only the others are sorted
    ordered = named.withColumn("by_hash", F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    repeated = F.filter("by_hash", lambda x, j: (F.get("by_hash", j - 1)["h"] == x["h"]) | F.coalesce(F.get("by_hash", j + 1)["h"] == x["h"], F.lit(False)))
    places = ordered.withColumn("places", F.array_sort(F.transform(F.when(F.col("by_hash").isNotNull(), repeated), lambda x: x["i"])))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + i + WINDOW - F.greatest(i, acc["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda acc: acc["n"],
    )
    return places.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_stop")


def measure_columns() -> dict:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "symbol_ratio": F.col("n_symbols") / words,
        "mean_word": F.col("word_chars") / words,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "stop_ratio": F.col("n_stop") / words,
    }


def verdict(rules=RULES):
    """All rows of the table as one boolean column."""
    at = measure_columns()
    parts = []
    for _, measure, least, most in rules:
        parts += [at[measure] >= F.lit(least)] if least is not None else []
        parts += [at[measure] <= F.lit(most)] if most is not None else []
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def judge(docs: DataFrame, rules=RULES) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counts(docs).withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & verdict(rules)).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def oracle() -> str:
    at = {"n_words": "n_words", "repeat_ratio": "n_repeat_words / w", "symbol_ratio": "n_symbols / w", "mean_word": "word_chars / w", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)", "stop_ratio": "n_stop / w"}
    tests = [f"{at[m]} {op} {x}" for _, m, lo, hi in RULES for op, x in ((">=", lo), ("<=", hi)) if x is not None]
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    word = SPACE_WORD
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '{word}') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{word}')) AS lines FROM d),
    win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS s FROM w, unnest(generate_series(1, greatest(len(ws) - 7, 0))) AS u(i)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM twice, unnest(generate_series(i, i + 7)) AS u(p) GROUP BY rid),
    c AS (SELECT doc_id, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words,
        len(lines) AS n_lines, len(list_filter(ws, lambda x: lower(x) IN ({stops}))) AS n_stop, greatest(len(ws), 1) AS w
      FROM w LEFT JOIN rep USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
      NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {' AND '.join(tests)} AS kept
    FROM c"""
