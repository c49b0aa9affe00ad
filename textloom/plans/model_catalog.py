"""Queries of contextual encoders, of the persistent index and of the vector cache."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contextual, vectors
from ..functions import text as T
from ..operators import chunking
from ..sources import index
from .catalog import BUCKET, DOC_ITEMS, TERMS, TWO, _doc_items, _passages, _queries, bm25_sql, docs, fixed_sql, query
from .sources_catalog import folder

# --- token states ------------------------------------------------------------------------------
DIM, SIZE, LIMIT, SHARED = 32, 128, 200, 40
STATE_SQL = f"""pc AS (SELECT doc_id, regexp_extract_all(text, '{T.PIECE}') AS p FROM documents),
    tok AS (SELECT doc_id, i - 1 AS i, lower(regexp_replace(p[i], '^[{T.SPACE}]+', '')) AS t, CASE WHEN i <= {LIMIT} THEN 0 ELSE (i - 1 - {LIMIT} + {LIMIT - SHARED}) // {LIMIT - SHARED} END AS w FROM pc, unnest(generate_series(1, len(p))) AS u(i)),
    win AS (SELECT doc_id, chunk_order AS w, {BUCKET.format(dim=DIM).replace('md5(t)', 'md5(lower(text))')} AS wb FROM ({fixed_sql(LIMIT, SHARED)})),
    ones AS (SELECT doc_id, i // {SIZE} AS c, {BUCKET.format(dim=DIM)} AS b FROM tok UNION ALL SELECT doc_id, i // {SIZE}, wb FROM tok JOIN win USING (doc_id, w)),
    cells AS (SELECT doc_id, c, b, count(*) AS n FROM ones GROUP BY ALL)"""


@query(f"WITH {STATE_SQL} SELECT doc_id || ':late:' || c AS item_id, b::int AS bucket, round(round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, c)), 9), 6) AS weight FROM cells")
def contextual_pooling(spark, sf):
    """Chunks of 128 tokens pooled from states that an encoder made of windows of 200 tokens, 40 of them shared."""
    d = docs(spark, sf)
    made = contextual.pooled_states(d, chunking.late(d, SIZE), contextual.hash_encoder(DIM), LIMIT, SHARED, "window")
    return made.select("item_id", F.posexplode("vector").alias("bucket", "weight")).where("weight > 0").withColumn("weight", F.round(F.round("weight", 9), 6))


# --- index and vectors on disk -----------------------------------------------------------------
@query(f"WITH {bm25_sql(DOC_ITEMS, 10, 'h')} SELECT query_id, item_id, round(score, 6) AS score, rank FROM h")
def bm25_from_index(spark, sf):
    """The index of all documents is written, opened again and searched."""
    at = folder(spark)
    index.build(_doc_items(spark, sf), at)
    return index.build(_doc_items(spark, sf), at).search(_queries(spark, sf), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {TWO} SELECT query_id, item_id, round(score, 6) AS score, rank FROM h")
def bm25_passages_from_index(spark, sf):
    """Both stages from indexes: documents, then passages of those documents."""
    at = folder(spark)
    within = index.build(_doc_items(spark, sf), at).search(_queries(spark, sf), 5).select("query_id", F.col("item_id").alias("document_id"))
    return index.build(_passages(spark, sf), at).search(_queries(spark, sf), 10, within=within).withColumn("score", F.round("score", 6))


CACHE_DIM = 64


@query(f"""WITH tf AS (SELECT doc_id, t, count(*) AS c FROM (SELECT doc_id, unnest({TERMS}) AS t FROM documents) GROUP BY ALL),
    v AS (SELECT doc_id, {BUCKET.format(dim=CACHE_DIM)} AS b, sum(CASE WHEN substr(md5(t), 16, 1) >= '8' THEN -c ELSE c END) AS w FROM tf GROUP BY ALL),
    u AS (SELECT doc_id, b, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS x FROM v WHERE w <> 0)
    SELECT (SELECT count(DISTINCT coalesce(text, '')) FROM documents)::bigint AS embedded_first, 0::bigint AS embedded_again, d.doc_id::varchar AS item_id, coalesce(round(sum(x * (b + 1)), 6), 0) AS moment FROM documents d LEFT JOIN u USING (doc_id) GROUP BY d.doc_id""")
def cached_embeddings(spark, sf):
    """All documents embedded by way of the cache, twice: each different text is embedded once, and none again."""
    at, items = folder(spark), _doc_items(spark, sf)
    embed = lambda x: vectors.signed_vectors(x, CACHE_DIM, True)
    _, first = index.cached_vectors(items, at, "signed", embed)
    got, again = index.cached_vectors(items, at, "signed", embed)
    moment = F.aggregate(F.transform("vector", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return got.select(F.lit(first).cast("long").alias("embedded_first"), F.lit(again).cast("long").alias("embedded_again"), "item_id", F.round(moment, 6).alias("moment"))
