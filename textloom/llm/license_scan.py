"""Licence scans: phrases, and an exact set-similarity join of text lines with licence templates.

Base labels come from phrases whose words stand consecutively. The join then finds every line
(text block) whose set of words contains at least ``THRESHOLD`` of a template's distinct words:

1. a block keeps the words it shares with the templates' vocabulary; the length filter drops
   blocks with fewer of them than the least overlap any template asks for;
2. words are ordered by how many blocks hold them, over all blocks of the corpus, rarest first;
3. the prefix filter joins a block with a template only over the template's first
   ``|T| - need + 1`` words of that order: a block with ``need`` common words must hold one;
4. the positional filter adds up what can still match behind the joined positions;
5. what is left is verified exactly.

Notices wrapped over lines are found in windows over the whole text: for each template every stretch
of as many consecutive words as it has, across line ends, is a block too, with the same threshold. A
text is looked at only if all its words together hold enough of some template; windows start at words
of the template, since any other start holds no more of it.

Only DataFrame functions are used. The templates' vocabulary is a fixed list of this module, so
the index is broadcast with a known bound; nothing else is.

Edge cases: null text counts as empty (no words, no labels, score 0); null doc_ids are kept;
rows that repeat a doc_id and text get equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, documents, settle, text_of

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Fixed values of the contract.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Licence templates: label and notice text, public notices in a normal form.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under creative commons attribution sharealike 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved unauthorized copying of this file via any medium is strictly prohibited"),
]
THRESHOLD = 0.95


def _needs() -> list[tuple[int, str, list[str], int]]:
    return [(i, label, words, math.ceil(THRESHOLD * len(words) - 1e-9)) for i, (label, text) in enumerate(TEMPLATES) for words in [sorted(set(text.split()))]]


def _blocks(docs: DataFrame) -> DataFrame:
    """One row per document row: base columns, and its blocks as sets of template words."""
    templates = _needs()
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in templates for w in t[2]})])
    least = min(need for *_, need in templates)
    alternatives = "|".join(PHRASES)
    low = docs.select("doc_id", ascii_lower(text_of()).alias("low"))
    spaced = low.select("doc_id", "low", F.concat(F.lit(" "), F.trim(F.regexp_replace("low", NOT_WORD, " ")), F.lit(" ")).alias("norm"))
    spaces = lambda c: F.length(c) - F.length(F.translate(c, " ", ""))
    has = [F.col("norm").contains(f" {p} ") for p in PHRASES]
    any_has = has[0] | has[1] | has[2]
    cut = F.when(any_has, F.split("norm", f" (?:{alternatives})(?= )", -1))
    found = F.when(any_has, F.regexp_extract_all("norm", F.lit(f" (?:{alternatives})(?= )"), F.lit(0)))
    held_all = F.transform(F.split("low", "\n", -1), lambda line: F.array_intersect(F.split(line, NOT_WORD, -1), vocabulary))
    spaced = spaced.withColumn("held", held_all).withColumn("whole", F.array_distinct(F.flatten("held")))
    held = F.filter("held", lambda h: F.size(h) >= least)
    wrapped = F.col("low").contains("\n") & (F.size("whole") >= least) & reduce(or_, [F.size(F.array_intersect("whole", F.array(*map(F.lit, words)))) >= need for *_, words, need in templates])
    placed = F.transform(F.split(F.trim("norm"), " ", -1), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    places = F.when(wrapped, F.filter(placed, lambda x: F.array_contains(vocabulary, x["word"])))
    # the hash tells apart rows that share a doc_id
    out = spaced.select("doc_id", F.xxhash64("low").alias("row_hash"), F.when(F.length("norm") > 2, spaces(F.col("norm")) - 1).otherwise(0).cast("long").alias("n_words"), cut.alias("cut"), found.alias("found"), *[h.alias(f"has_{i}") for i, h in enumerate(has)], held.alias("blocks"), places.alias("places"))
    last = F.element_at("cut", -1)
    phrase_words = F.size(F.split(F.trim(F.element_at("found", -1)), " "))
    return out.select(
        "doc_id",
        "row_hash",
        "n_words",
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_base"),
        F.when(F.col("found").isNotNull(), spaces(F.element_at("cut", 1))).cast("long").alias("first_word"),
        F.when(F.col("found").isNotNull(), F.col("n_words") - (spaces(last) - 1) - phrase_words).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(F.col(f"has_{i}"), F.lit(label)) for i, label in enumerate(PHRASES.values())])).alias("base"),
        "blocks",
        "places",
    )


def _wrapped(rows: DataFrame) -> DataFrame:
    """doc_id, row_hash, labels, score of the templates found in windows of their length over whole texts."""
    index = [(label, words, need, len(TEMPLATES[i][1].split())) for i, label, words, need in _needs()]
    templates = rows.sparkSession.createDataFrame(index, "label string, words array<string>, need int, n int")  # the fixed templates
    hits = F.filter("places", lambda x: F.array_contains(F.col("words"), x["word"]))
    near = rows.where("places IS NOT NULL").select("doc_id", "row_hash", "places").crossJoin(F.broadcast(templates)).select("doc_id", "row_hash", "label", "words", "need", "n", hits.alias("hits"))
    # a window from a hit on with enough words has its need-th hit within n words; such windows are few, and of their n words at most n are hits
    dense = F.transform("hits", lambda x, i: F.when(F.get("hits", i + F.col("need") - 1)["at"] < x["at"] + F.col("n"), F.struct(x["at"].alias("at"), i.alias("i"))))
    windows = F.transform(F.array_compact(dense), lambda s: F.filter(F.slice("hits", s["i"] + 1, F.col("n")), lambda y: y["at"] < s["at"] + F.col("n")))
    # exploded, not filtered: a filter would be pushed below the hits and find them anew for each window
    common = F.size(F.array_distinct(F.col("window.word")))
    found = near.select("doc_id", "row_hash", "label", "need", F.size("words").alias("t_size"), F.explode(windows).alias("window")).withColumn("common", common).where("common >= need")
    return found.select("doc_id", "row_hash", F.array("label").alias("labels"), (F.col("common") / F.col("t_size")).alias("score"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text): counts, places, labels and the best score."""
    rows = settle(_blocks(docs))
    # equal blocks are joined once, however many documents repeat them
    blocks = settle(rows.select(F.explode("blocks").alias("held")).groupBy("held").agg(F.count("*").alias("n")))
    df = {r["word"]: r["n"] for r in blocks.select(F.explode("held").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # at most the fixed vocabulary
    rank = {w: i for i, w in enumerate(sorted({w for t in _needs() for w in t[2]}, key=lambda w: (df.get(w, 0), w)))}
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    index = []
    for i, label, words, need in _needs():
        order = sorted(rank[w] for w in words)
        index += [(r, at, i, label, len(words), need, order) for at, r in enumerate(order[: len(words) - need + 1])]
    spark = docs.sparkSession
    index_rows = F.broadcast(spark.createDataFrame(index, "rank int, t_at int, t int, label string, t_size int, need int, t_ranks array<int>"))
    ordered = blocks.select("held", F.array_sort(F.transform("held", lambda w: ranks[w])).alias("b_ranks"))
    pairs = (
        ordered.select("held", "b_ranks", F.posexplode("b_ranks").alias("b_at", "rank"))
        .join(index_rows, "rank")
        .where(F.size("b_ranks") >= F.col("need"))
        # this is the first common word or an earlier pair stands for it; behind it at most the shorter rest can match
        .where(F.least(F.col("t_at"), F.col("b_at")) + 1 + F.least(F.col("t_size") - F.col("t_at") - 1, F.size("b_ranks") - F.col("b_at") - 1) >= F.col("need"))
        .withColumn("common", F.size(F.array_intersect("b_ranks", "t_ranks")))
        .where(F.col("common") >= F.col("need"))
    )
    labelled = pairs.groupBy("held").agg(F.collect_set("label").alias("labels"), F.max(F.col("common") / F.col("t_size")).alias("score"))  # labels: at most the templates'
    by_row = (
        rows.where(F.size("blocks") > 0)
        .select("doc_id", "row_hash", F.explode("blocks").alias("held"))
        .join(labelled, "held")
        .select("doc_id", "row_hash", "labels", "score")
        .unionByName(_wrapped(rows))
        .groupBy("doc_id", "row_hash")
        .agg(F.array_distinct(F.flatten(F.collect_set("labels"))).alias("labels"), F.max("score").alias("score"))
        .withColumnsRenamed({"doc_id": "l_doc", "row_hash": "l_hash"})
    )
    joined = rows.drop("blocks", "places").join(by_row, F.col("doc_id").eqNullSafe(F.col("l_doc")) & (F.col("row_hash") == F.col("l_hash")), "left")
    joined_labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(F.concat("base", F.coalesce("labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def oracle() -> str:
    """Brute force: every line, and every window as long as a template, against every template."""
    templates = ", ".join(f"({i}, '{label}', {words!r}::varchar[], {need}, {len(TEMPLATES[i][1].split())})" for i, label, words, need in _needs())
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"({p.split()!r}::varchar[], '{label}')" for p, label in PHRASES.items())
    return f"""
    WITH t(t, label, ws, need, n) AS (VALUES {templates}),
    ph(ws, label) AS (VALUES {phrases}),
    d AS (SELECT row_number() OVER () AS rid, doc_id, {low} AS low FROM documents),
    w AS (SELECT rid, doc_id, regexp_extract_all(low, '{pattern}') AS ws FROM d),
    starts AS (
      SELECT rid, ph.label, i FROM w, ph, unnest(generate_series(1, greatest(len(w.ws) - len(ph.ws) + 1, 0))) AS u(i)
      WHERE w.ws[i] = ph.ws[1] AND w.ws[i:i + len(ph.ws) - 1] = ph.ws),
    base AS (SELECT rid, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels FROM starts GROUP BY rid),
    lines AS (SELECT rid, list_distinct(regexp_extract_all(line, '{pattern}')) AS ws FROM (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM d)),
    hits AS (SELECT rid, label, len(list_intersect(lines.ws, t.ws)) / len(t.ws) AS score FROM lines, t WHERE len(list_intersect(lines.ws, t.ws)) >= need),
    pos AS (SELECT rid, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM w),
    held AS (SELECT rid, t.t, i, word FROM pos JOIN (SELECT t, unnest(ws) AS word FROM t) x USING (word) JOIN t ON t.t = x.t),
    wins AS (SELECT a.rid, a.t, a.i, count(DISTINCT b.word) AS common FROM held a JOIN t ON t.t = a.t JOIN held b ON b.rid = a.rid AND b.t = a.t AND b.i >= a.i AND b.i < a.i + t.n GROUP BY a.rid, a.t, a.i),
    both_hits AS (SELECT * FROM hits UNION ALL SELECT rid, label, common / len(t.ws) FROM wins JOIN t USING (t) WHERE common >= need),
    found AS (SELECT rid, list(DISTINCT label) AS labels, max(score) AS score FROM both_hits GROUP BY rid)
    SELECT w.doc_id, len(w.ws)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word,
      array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
      CASE WHEN n_base > 0 THEN 1.0::double ELSE coalesce(found.score, 0)::double END AS score
    FROM w LEFT JOIN base USING (rid) LEFT JOIN found USING (rid)"""
