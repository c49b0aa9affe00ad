"""Secret scans over an incremental ledger of blobs.

Every version of a text is addressed by the SHA-256 of its content (its blob). A ledger table
holds (blob, rule_version, spans). A scan looks only at blobs that the ledger lacks for the
current rule version, each once however many paths carry it, appends what it found, and joins
the findings back to all paths. With no ledger given a fresh one is made in the shared folder.

Only DataFrame functions are used. A span is kind:start:end of a whole match, in code points,
end exclusive; places come from the lengths of the pieces between matches.

Edge cases: null text counts as empty; documents without findings get a row; null doc_ids stay;
repeated rows get equal rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, settle, shared_dir, text_of, unused

#: kind, pattern, group whose length counts, least length. The first three are fixed by the contract.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = [
    ("assign", ASSIGN, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # maximal runs: the same matches as of any length, then cut at 24
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
]
N_BASE = 3
RULE_VERSION = hashlib.sha256(json.dumps(RULES).encode()).hexdigest()[:16]
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text, number: int):
    """All spans of one rule in the order of the text."""
    _, pattern, group, least = RULES[number]
    pieces = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part"),
    )
    empty = F.array().cast(SPANS)

    def step(acc, x):
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["all"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"))).cast(SPANS)
        return F.struct(end.alias("pos"), F.when(F.length(x["part"]) >= least, F.concat(acc["spans"], found)).otherwise(acc["spans"]).alias("spans"))

    folded = F.aggregate(pieces, F.struct(F.lit(0).alias("pos"), empty.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def find(text):
    """The spans of all rules, by start, then kind as listed."""
    extra = "|".join(f"(?:{p})" for _, p, *_ in RULES[N_BASE:])
    more = F.when(text.rlike(extra), F.concat(*[_spans(text, i) for i in range(N_BASE, len(RULES))])).otherwise(F.array().cast(SPANS))
    return F.array_sort(F.concat(*[_spans(text, i) for i in range(N_BASE)], more))


def scan(docs: DataFrame, ledger: str | None = None) -> DataFrame:
    """(doc_id, blob, spans) of every row of ``docs``; the ledger at that path is read and grown."""
    spark = docs.sparkSession
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    versions = docs.select("doc_id", text_of().alias("text"))
    paths = versions.select("doc_id", F.sha2("text", 256).alias("blob"))
    path, fresh = spark._jvm.org.apache.hadoop.fs.Path(ledger), versions.withColumn("blob", F.sha2("text", 256))
    looked = True
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        known = spark.read.parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
        unseen = settle(paths.select("blob").distinct().join(known.select("blob"), "blob", "left_anti"))  # hashes only
        looked = not unseen.isEmpty()
        fresh = fresh.join(unseen, "blob", "left_semi")
    if looked:
        blobs = fresh.groupBy("blob").agg(F.first("text").alias("text"))
        blobs.select("blob", F.lit(RULE_VERSION).alias("rule_version"), find(F.col("text")).alias("spans")).write.mode("append").parquet(ledger)
    entries = spark.read.schema(f"blob string, rule_version string, spans {SPANS}").parquet(ledger).where(F.col("rule_version") == RULE_VERSION)
    # blobs without findings need no join partner; an entry that was written twice counts once
    once = entries.where(F.size("spans") > 0).groupBy("blob").agg(F.first("spans").alias("spans"))
    return paths.join(once, "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def _said(spans):
    names = F.array(*[F.lit(r[0]) for r in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[n(k).alias(f"n_{RULES[k][0]}") for k in range(N_BASE)],
        F.sha2(_said(F.filter("spans", lambda s: s["kind"] < N_BASE)), 256).alias("base_sha256"),
        _said(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced; rows and other columns stay."""
    columns = docs.columns
    own, blob, held = (unused(docs, name) for name in ("own_blob", "found_blob", "found_spans"))
    found = scan(docs)
    spans = found.where(F.size("spans") > 0).groupBy(F.col("blob").alias(blob)).agg(F.first("spans").alias(held))
    text = F.col("text")

    def step(acc, s):  # overlapping spans are masked once
        fresh = s["start"] >= acc["pos"]
        out = F.when(fresh, F.concat(acc["out"], text.substr(acc["pos"] + 1, s["start"] - acc["pos"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), out.alias("out"))

    masked = F.aggregate(held, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], text.substr(acc["pos"] + 1, F.length(text))))
    return docs.withColumn(own, F.sha2(text_of(), 256)).join(spans, F.col(own) == F.col(blob), "left").withColumn("text", F.when(F.col(held).isNull(), text).otherwise(masked)).select(*columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(documents(spark, sf_dir)))


def oracle() -> str:
    kinds = []
    for i, (_, pattern, group, least) in enumerate(RULES):
        p = pattern.replace("'", "''")
        kinds.append(f"SELECT rid, {i} AS kind, {least} AS least, string_split_regex(text, '{p}') AS gap, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {group}) AS part FROM d WHERE regexp_matches(text, '{p}')")
    names = ", ".join(f"'{r[0]}'" for r in RULES)
    one = "[" + names + "][kind + 1] || ':' || s || ':' || e"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    k AS ({' UNION ALL '.join(kinds)}),
    x AS (SELECT rid, kind, least, i, length(m[i]) AS n, length(part[i]) AS p, sum(length(gap[i])) OVER w AS g, sum(length(m[i])) OVER w AS t FROM k, unnest(generate_series(1, len(m))) AS u(i) WINDOW w AS (PARTITION BY rid, kind ORDER BY i)),
    f AS (SELECT rid, kind, (g + t - n)::int AS s, (g + t)::int AS e FROM x WHERE p >= least),
    a AS (SELECT rid, count(*) FILTER (kind = 0) AS c0, count(*) FILTER (kind = 1) AS c1, count(*) FILTER (kind = 2) AS c2,
        string_agg({one}, ',' ORDER BY s, kind) FILTER (kind < {N_BASE}) AS base, string_agg({one}, ',' ORDER BY s, kind) AS spans FROM f GROUP BY rid)
    SELECT doc_id, coalesce(c0, 0)::bigint AS n_assign, coalesce(c1, 0)::bigint AS n_access, coalesce(c2, 0)::bigint AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (rid)"""
