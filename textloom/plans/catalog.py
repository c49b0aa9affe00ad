"""The queries of the engine over the driver's tables, and the SQL that they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors
from ..operators import chunking, evaluation, retrieval
from ..sources import tables
from ..streaming import stream
from . import hierarchy

FLAGSHIP = "chunk_statistics"
QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def oracles() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf) -> DataFrame:
    return tables.spread(read(spark, sf, "documents").select("doc_id", "text"), "doc_id")


# --- SQL parts ---------------------------------------------------------------------------------
LEX = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
TERMS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
BUCKET = "(('0x' || substr(md5(t), 1, 15))::bigint % {dim})"


def fixed_sql(size: int, overlap: int = 0, method: str = "fixed") -> str:
    """CTE body: chunks of fixed windows."""
    return f"""SELECT doc_id, (s // {size - overlap})::int AS chunk_order, doc_id || ':{method}:' || (s // {size - overlap}) AS chunk_id,
      regexp_replace(array_to_string(p[s + 1:s + {size}], ''), '^[{T.SPACE}]+', '') AS text, least({size}, len(p) - s)::int AS token_count
      FROM (SELECT doc_id, regexp_extract_all(text, '{T.PIECE}') AS p FROM documents) d, unnest(generate_series(0, greatest(len(p) - {overlap} - 1, 0), {size - overlap})) AS u(s) WHERE len(p) > 0"""


TOKENS = f"regexp_extract_all({{}}, '{T.TOKEN}')"
SEGMENTS = f"""sent AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])([{T.SPACE}]+)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS ss FROM documents),
    cutting AS (SELECT doc_id, i, ss[i] AS piece, sum(length(ss[i])) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sent, unnest(generate_series(1, len(ss))) AS u(i)),
    trimmed AS (SELECT doc_id, i, upto - length(regexp_replace(piece, '^[{T.SPACE}]+', '')) AS start, regexp_replace(piece, '^[{T.SPACE}]+|[{T.SPACE}]+$', '', 'g') AS text FROM cutting),
    seg AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::int AS pos, text, len({TOKENS.format('text')})::int AS token_count, start::int AS start, (start + length(text))::int AS "end" FROM trimmed WHERE text <> '')"""


def merged_sql(method: str) -> str:
    """CTEs from ``marked`` (segments with cut): chunks are slices of the documents."""
    return f"""cutted AS (SELECT *, coalesce(sum(cut::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::int AS g FROM marked)
    SELECT doc_id, g AS chunk_order, doc_id || ':{method}:' || g AS chunk_id, n AS token_count, md5(substr(text, s + 1, e - s)) AS text_md5
    FROM (SELECT doc_id, g, min(start) AS s, max("end") AS e, sum(token_count)::int AS n FROM cutted GROUP BY doc_id, g) JOIN documents USING (doc_id)"""


def _short(df: DataFrame) -> DataFrame:
    """Chunk rows with the md5 of the text in its place."""
    return df.select("doc_id", "chunk_order", "chunk_id", "token_count", F.md5("text").alias("text_md5"))


def _short_sql(cte: str) -> str:
    return f"WITH c AS ({cte}) SELECT doc_id, chunk_order, chunk_id, token_count, md5(text) AS text_md5 FROM c"


# --- chunks and their statistics ---------------------------------------------------------------
@query(_short_sql(fixed_sql(256)))
def fixed_chunks_256(spark, sf):
    return _short(chunking.fixed(docs(spark, sf), 256))


@query(_short_sql(fixed_sql(512, 64)))
def fixed_chunks_512_overlap(spark, sf):
    return _short(chunking.fixed(docs(spark, sf), 512, 64))


@query(f'WITH {SEGMENTS} SELECT doc_id, pos, token_count, start, "end", md5(text) AS text_md5 FROM seg')
def sentence_segments(spark, sf):
    return chunking.segments(docs(spark, sf)).select("doc_id", "pos", "token_count", "start", "end", F.md5("text").alias("text_md5"))


@query(f"""WITH RECURSIVE {SEGMENTS},
    units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, j) AS n, least(256, token_count - j * 256)::int AS c FROM seg, unnest(generate_series(0, (token_count - 1) // 256)) AS u(j)),
    walk AS (SELECT doc_id, n, c, c AS run, 0 AS g FROM units WHERE n = 1
      UNION ALL SELECT u.doc_id, u.n, u.c, CASE WHEN w.run + u.c > 256 THEN u.c ELSE w.run + u.c END, CASE WHEN w.run + u.c > 256 THEN w.g + 1 ELSE w.g END FROM walk w JOIN units u ON u.doc_id = w.doc_id AND u.n = w.n + 1),
    sized AS (SELECT doc_id, g, sum(c)::int AS c FROM walk GROUP BY doc_id, g), placed AS (SELECT *, (sum(c) OVER (PARTITION BY doc_id ORDER BY g) - c)::int AS b FROM sized),
    pc AS (SELECT doc_id, regexp_extract_all(text, '{T.PIECE}') AS p FROM documents)
    SELECT doc_id, g::int AS chunk_order, doc_id || ':sentence:' || g AS chunk_id, c AS token_count, md5(regexp_replace(array_to_string(p[b + 1:b + c], ''), '^[{T.SPACE}]+', '')) AS text_md5 FROM placed JOIN pc USING (doc_id)""")
def sentence_fixed_256(spark, sf):
    return _short(chunking.sentence_fixed(docs(spark, sf), 256))


def _stat_sql(scope: str) -> str:
    key = ("doc_id, " if scope == "within_document" else "") + "trim(regexp_replace(lower(text), '[" + T.SPACE + "]+', ' ', 'g'))"
    return f"""WITH c AS ({fixed_sql(256)}), d AS (SELECT count(*) AS n FROM c GROUP BY doc_id), g AS (SELECT count(*) AS n FROM c GROUP BY {key})
    SELECT s.*, p.*, (SELECT sum(n - 1) FROM g)::bigint AS duplicate_chunk_count FROM
    (SELECT count(*)::bigint AS total_chunks, round(avg(token_count), 6) AS tokens_mean, round(quantile_cont(token_count, 0.5), 6)::double AS tokens_median, min(token_count)::double AS tokens_min, max(token_count)::double AS tokens_max,
      round(quantile_cont(token_count, 0.9), 6)::double AS tokens_p90, round(quantile_cont(token_count, 0.95), 6)::double AS tokens_p95, round(avg(CASE WHEN token_count > 256 THEN 100.0 ELSE 0 END), 6) AS pct_over_256,
      round(avg(CASE WHEN token_count > 512 THEN 100.0 ELSE 0 END), 6) AS pct_over_512, round(avg(CASE WHEN token_count > 1024 THEN 100.0 ELSE 0 END), 6) AS pct_over_1024, 0.0::double AS pct_non_contiguous, (count(*) FILTER (trim(text) = ''))::bigint AS empty_chunk_count FROM c) s,
    (SELECT round(avg(n), 6) AS chunks_per_doc_mean, round(quantile_cont(n, 0.5), 6)::double AS chunks_per_doc_median, round(quantile_cont(n, 0.95), 6)::double AS chunks_per_doc_p95 FROM d) p"""


@query(_stat_sql("within_document"))
def chunk_statistics(spark, sf):
    return evaluation.statistics(chunking.fixed(docs(spark, sf), 256).withColumn("is_contiguous", F.lit(True)))


@query(_stat_sql("corpus"))
def chunk_statistics_corpus(spark, sf):
    return evaluation.statistics(chunking.fixed(docs(spark, sf), 256).withColumn("is_contiguous", F.lit(True)), "corpus")


@query(f"SELECT md5(trim(regexp_replace(lower(text), '[{T.SPACE}]+', ' ', 'g'))) AS text_md5, count(*)::bigint AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_documents(spark, sf):
    return docs(spark, sf).groupBy(F.md5(T.squeeze(F.col("text"))).alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(f"SELECT doc_id, len({TOKENS.format('text')})::int AS tokens, len({LEX})::int AS lexical, len({TERMS})::int AS terms, length(text)::int AS chars, strlen(text)::int AS bytes FROM documents")
def token_counts(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", T.token_count(t).alias("tokens"), F.size(T.lexical_tokens(t)).alias("lexical"), F.size(T.terms(t)).alias("terms"), F.length(t).alias("chars"), F.octet_length(t).alias("bytes"))


@query(f"WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id)::bigint AS df, count(*)::bigint AS cf, round(ln(1 + ((SELECT count(*) FROM documents) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)), 6) AS idf FROM t GROUP BY term")
def vocabulary_df(spark, sf):
    d = docs(spark, sf)
    n = d.agg(F.count("*").alias("n"))
    per_doc = d.select("doc_id", F.explode(T.terms(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    v = per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return v.crossJoin(F.broadcast(n)).select("term", "df", "cf", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))  # n: one row


# --- evidence, BM25, metrics -------------------------------------------------------------------
PAIRS = "pairs AS (SELECT item_id, doc_id, (strpos(d.text, b.text) - 1)::int AS start FROM documents d, benchmark b WHERE contains(d.text, b.text))"


@query(f"WITH {PAIRS} SELECT * FROM pairs")
def evidence_pairs(spark, sf):
    return evaluation.containing(read(spark, sf, "benchmark"), docs(spark, sf))


def _evidence(spark, sf) -> DataFrame:
    """An evidence row for each benchmark item and document that holds it."""
    b = read(spark, sf, "benchmark")
    p = evaluation.containing(b, docs(spark, sf))
    return p.join(b, "item_id").select(F.col("item_id").cast("string").alias("query_id"), F.concat_ws(":", F.col("item_id").cast("string"), F.col("doc_id").cast("string")).alias("evidence_id"), "doc_id", "text", T.token_count(F.col("text")).alias("ev_count"))


EVIDENCE = f"{PAIRS}, ev AS (SELECT item_id::varchar AS query_id, item_id || ':' || doc_id AS evidence_id, doc_id, b.text AS text, len({TOKENS.format('b.text')})::int AS ev_count FROM pairs JOIN benchmark b USING (item_id))"
COVER = rf"chunk AS ({fixed_sql(256)}), ct AS (SELECT doc_id, chunk_id, list_distinct({LEX}) AS ct FROM chunk), cov AS (SELECT query_id, evidence_id, chunk_id, ev_count, list_filter(generate_series(0, len(et) - 1), lambda i: list_contains(ct, et[i + 1])) AS covered FROM (SELECT query_id, evidence_id, doc_id, ev_count, {LEX} AS et FROM ev) JOIN ct USING (doc_id))"


@query(f"WITH {EVIDENCE}, {COVER} SELECT query_id, evidence_id, chunk_id, ev_count, array_to_string(covered, ',') AS covered FROM cov")
def evidence_coverage(spark, sf):
    c = evaluation.coverage(_evidence(spark, sf), chunking.fixed(docs(spark, sf), 256))
    return c.withColumn("covered", F.array_join(F.transform("covered", lambda x: x.cast("string")), ","))


def bm25_sql(items: str, k: int, name: str, within: str | None = None) -> str:
    """CTEs: ``name`` with query_id, item_id, score, rank."""
    carry = ", document_id" if within else ""
    join = f"JOIN {within} USING (query_id, document_id)" if within else ""
    pool = f"(SELECT query_id, item_id FROM {within} JOIN {name}_t USING (document_id))" if within else f"(SELECT query_id, item_id FROM (SELECT item_id::varchar AS query_id FROM benchmark), {name}_t)"
    return rf"""{name}_t AS (SELECT item_id{carry}, {TERMS} AS ts FROM ({items})),
    {name}_s AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_t),
    {name}_p AS (SELECT item_id{carry}, dl, t, count(*) AS tf FROM (SELECT item_id{carry}, len(ts) AS dl, unnest(ts) AS t FROM {name}_t) GROUP BY ALL),
    {name}_f AS (SELECT t, count(*) AS df FROM {name}_p GROUP BY t),
    {name}_q AS (SELECT query_id, t, count(*) AS qtf FROM (SELECT item_id::varchar AS query_id, unnest({TERMS}) AS t FROM benchmark) GROUP BY ALL),
    {name}_h AS (SELECT query_id, item_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
      FROM {name}_p JOIN {name}_f USING (t) JOIN {name}_q USING (t) {join}, {name}_s GROUP BY query_id, item_id),
    {name} AS (SELECT query_id, item_id, score, rank FROM (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS rank
      FROM (SELECT query_id, item_id, coalesce(score, 0) AS score FROM {pool} LEFT JOIN {name}_h USING (query_id, item_id))) WHERE rank <= {k})"""


def _queries(spark, sf) -> DataFrame:
    return read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def _doc_items(spark, sf) -> DataFrame:
    return docs(spark, sf).select(F.col("doc_id").cast("string").alias("item_id"), "text")


def _passages(spark, sf) -> DataFrame:
    return chunking.fixed(docs(spark, sf), 256).select(F.col("chunk_id").alias("item_id"), F.col("doc_id").cast("string").alias("document_id"), "text")


DOC_ITEMS = "SELECT doc_id::varchar AS item_id, text FROM documents"
PASSAGES = f"SELECT chunk_id AS item_id, doc_id::varchar AS document_id, text FROM ({fixed_sql(256)})"


@query(f"WITH {bm25_sql(DOC_ITEMS, 10, 'h')} SELECT query_id, item_id, round(score, 6) AS score, rank FROM h")
def bm25_documents_top10(spark, sf):
    return retrieval.bm25(_queries(spark, sf), _doc_items(spark, sf), 10).withColumn("score", F.round("score", 6))


TWO = f"{bm25_sql(DOC_ITEMS, 5, 'd')}, w AS (SELECT query_id, item_id AS document_id FROM d), {bm25_sql(PASSAGES, 10, 'h', 'w')}"


@query(f"WITH {TWO} SELECT query_id, item_id, round(score, 6) AS score, rank FROM h")
def bm25_passages_restricted(spark, sf):
    within = retrieval.bm25(_queries(spark, sf), _doc_items(spark, sf), 5).select("query_id", F.col("item_id").alias("document_id"))
    return retrieval.bm25(_queries(spark, sf), _passages(spark, sf), 10, within=within).withColumn("score", F.round("score", 6))


@query(f"""WITH {TWO}, j AS (SELECT h.query_id, h.item_id, h.score AS ps, d.score AS ds FROM h JOIN ({PASSAGES}) p USING (item_id) JOIN d ON d.query_id = h.query_id AND d.item_id = p.document_id),
    n AS (SELECT *, min(ps) OVER w AS pl, max(ps) OVER w AS ph, min(ds) OVER w AS dl, max(ds) OVER w AS dh FROM j WINDOW w AS (PARTITION BY query_id)),
    f AS (SELECT query_id, item_id, round(0.7 * CASE WHEN pl = ph THEN 1.0 ELSE (ps - pl) / (ph - pl) END + 0.3 * CASE WHEN dl = dh THEN 1.0 ELSE (ds - dl) / (dh - dl) END, 9) AS score FROM n),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS rank FROM f) SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5""")
def weighted_two_stage(spark, sf):
    out = retrieval.two_stage(_queries(spark, sf), _doc_items(spark, sf), _passages(spark, sf), 5, 10, 5, 0.3)
    return out.select("query_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _hits(spark, sf, k: int = 10) -> DataFrame:
    d, q = docs(spark, sf), _queries(spark, sf)
    h = tables.settled(retrieval.bm25(q, chunking.fixed(d, 256).select(F.col("chunk_id").alias("item_id"), "text"), k).withColumnRenamed("item_id", "chunk_id"))
    # documents of hits alone are cut again, and their chunks of hits alone into tokens
    held = h.select(F.split_part("chunk_id", F.lit(":"), F.lit(1)).cast("long").alias("doc_id")).distinct()
    chunks = chunking.fixed(d.join(retrieval.of_queries(q, held), "doc_id", "left_semi"), 256)
    own = chunking.kept(chunks.join(retrieval.of_queries(q, h), "chunk_id"))
    return own.select("query_id", "chunk_id", "score", "rank", "doc_id", "token_count", F.array_distinct(T.lexical_tokens(F.col("text"))).alias("tokens"))


HITS = f"{bm25_sql('SELECT chunk_id AS item_id, text FROM (' + fixed_sql(256) + ')', 10, 'b')}, hits AS (SELECT query_id, chunk_id, rank, doc_id, token_count, list_distinct({LEX}) AS tokens FROM b JOIN ({fixed_sql(256)}) c ON b.item_id = c.chunk_id)"


@query(f"WITH {HITS}, u AS (SELECT query_id, chunk_id, rank, token_count, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM hits) SELECT query_id, chunk_id, rank, used::bigint AS used FROM u WHERE used <= 1024")
def token_budget_strict(spark, sf):
    return evaluation.within_budget(_hits(spark, sf), 1024, True).select("query_id", "chunk_id", "rank", "used")


@query(f"WITH {HITS}, u AS (SELECT query_id, chunk_id, rank, token_count, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM hits) SELECT query_id, chunk_id, rank, used::bigint AS used FROM u WHERE used - token_count < 1024")
def token_budget_relaxed(spark, sf):
    return evaluation.within_budget(_hits(spark, sf), 1024, False).select("query_id", "chunk_id", "rank", "used")


def _red_sql(k: int) -> str:
    return f"(SELECT round(coalesce(avg(coalesce(j, 0)), 0), 6) FROM (SELECT DISTINCT query_id FROM hits WHERE rank <= {k}) LEFT JOIN (SELECT a.query_id, avg(CASE WHEN len(list_distinct(list_concat(a.tokens, b.tokens))) = 0 THEN 0.0 ELSE len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) END) AS j FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.rank < b.rank AND b.rank <= {k} GROUP BY 1) USING (query_id))"


@query(f"WITH {HITS} SELECT 3 AS k, {_red_sql(3)} AS redundancy UNION ALL SELECT 5, {_red_sql(5)} UNION ALL SELECT 10, {_red_sql(10)}")
def redundancy_at_k(spark, sf):
    h = _hits(spark, sf)
    parts = [evaluation.redundancy(h.where(F.col("rank") <= k)).select(F.lit(k).alias("k"), F.round("redundancy", 6).alias("redundancy")) for k in (3, 5, 10)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _metrics_sql() -> str:
    cols = []
    for k in (3, 5, 10):
        cols += [f"round(avg((coalesce(full{k}, 0) > 0)::int), 6) AS hit_{k}", f"round(avg(CASE WHEN first <= {k} THEN 1.0 / first ELSE 0 END), 6) AS mrr_{k}", f"round(avg(coalesce(full{k} / n_ev, 0)), 6) AS evidence_recall_macro_{k}", f"round(coalesce(sum(full{k}) / sum(n_ev), 0), 6) AS evidence_recall_micro_{k}", f"round(avg(coalesce(d{k} / n_rel, 0)), 6) AS document_recall_{k}", f"round(avg(coalesce(cov{k} / tokens, 0)), 6) AS evidence_coverage_{k}", f"{_red_sql(k)} AS redundancy_{k}"]
    cols += ["round(avg(coalesce(fullb / n_ev, 0)), 6) AS evidence_recall_macro_budget", "round(avg(coalesce(covb / tokens, 0)), 6) AS evidence_coverage_budget"]
    tests = {"3": "r <= 3", "5": "r <= 5", "10": "r <= 10", "b": "fits"}
    return f"""WITH {EVIDENCE}, {COVER}, {HITS},
    fit AS (SELECT query_id, chunk_id, sum(token_count) OVER (PARTITION BY query_id ORDER BY rank) <= 2048 AS fits FROM hits),
    found AS (SELECT hits.query_id, evidence_id, ev_count, rank, fits, covered FROM hits JOIN cov USING (query_id, chunk_id) JOIN fit USING (query_id, chunk_id)),
    tok AS (SELECT query_id, evidence_id, t, min(rank) AS r, bool_or(fits) AS fits FROM (SELECT query_id, evidence_id, rank, fits, unnest(covered) AS t FROM found) GROUP BY ALL),
    pe AS (SELECT query_id, evidence_id, {', '.join(f'count(*) FILTER ({x}) AS c{k}' for k, x in tests.items())} FROM tok GROUP BY ALL),
    pq AS (SELECT query_id, count(*) AS n_ev, sum(ev_count) AS tokens, {', '.join(f'count(*) FILTER (coalesce(c{k}, 0) >= ev_count) AS full{k}, sum(coalesce(c{k}, 0)) AS cov{k}' for k in tests)} FROM ev LEFT JOIN pe USING (query_id, evidence_id) GROUP BY query_id),
    one AS (SELECT query_id, min(rank) AS first FROM found WHERE len(covered) >= ev_count GROUP BY query_id),
    dr AS (SELECT query_id, count(*) AS n_rel, {', '.join(f'count(*) FILTER (r <= {k}) AS d{k}' for k in (3, 5, 10))} FROM (SELECT DISTINCT query_id, doc_id FROM ev) LEFT JOIN (SELECT query_id, doc_id, min(rank) AS r FROM hits GROUP BY ALL) USING (query_id, doc_id) GROUP BY query_id)
    SELECT {', '.join(cols)} FROM (SELECT item_id::varchar AS query_id FROM benchmark) LEFT JOIN pq USING (query_id) LEFT JOIN one USING (query_id) LEFT JOIN dr USING (query_id)"""


@query(_metrics_sql())
def metrics_23(spark, sf):
    ev = tables.settled(_evidence(spark, sf))
    own = docs(spark, sf).join(retrieval.small(ev.select("doc_id").distinct()), "doc_id", "left_semi")
    cover = evaluation.coverage(ev, chunking.fixed(own, 256))
    return evaluation.metrics(_queries(spark, sf).select("query_id"), ev, ev.select("query_id", "doc_id"), _hits(spark, sf), cover)


# --- vectors, fusion, graded metrics -----------------------------------------------------------
def _vectors(spark, sf) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector"), "label")


EMB = """q AS (SELECT vec_id::varchar AS query_id, embedding AS v, label FROM embeddings WHERE vec_id % 20 = 0), i AS (SELECT vec_id::varchar AS item_id, embedding AS v, label FROM embeddings),
    s AS (SELECT query_id, item_id, round(list_cosine_similarity(q.v::double[], i.v::double[]), 9) AS score FROM q, i WHERE query_id <> item_id),
    cosine AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS rank FROM s QUALIFY rank <= 10)"""


def _cosine(spark, sf, asked) -> DataFrame:
    v = _vectors(spark, sf)
    return retrieval.cosine_top_k(v.where(asked).select(F.col("item_id").alias("query_id"), "vector"), v, 10, True)


@query(f"WITH {EMB.replace(' WHERE vec_id % 20 = 0', '')} SELECT query_id, item_id, round(score, 6) AS score, rank FROM cosine")
def cosine_embeddings_top10(spark, sf):
    """Every vector is a query, against all others."""
    # halves as the SQL rounds them, by the product with 10^6 and not by decimal digits
    return _cosine(spark, sf, F.lit(True)).withColumn("score", F.signum("score") * F.floor(F.abs("score") * 1e6 + 0.5) / 1e6)


@query(f"""WITH {EMB}, qr AS (SELECT query_id, item_id FROM q JOIN i ON q.label = i.label AND query_id <> item_id), n AS (SELECT query_id, count(*) AS n FROM qr GROUP BY 1),
    g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, count(*) AS got FROM cosine JOIN qr USING (query_id, item_id) GROUP BY 1)
    SELECT query_id, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(x + 1)) FROM unnest(generate_series(1, least(10, n))) AS u(x)), 6) AS ndcg, round(coalesce(got, 0) / n, 6) AS recall FROM n LEFT JOIN g USING (query_id)""")
def label_ndcg_recall(spark, sf):
    return evaluation.graded_by_label(_vectors(spark, sf).select("item_id", "label"), _cosine(spark, sf, every := F.col("item_id").cast("long") % 20 == 0), 10, every)


FUSE = f"""WITH {bm25_sql(DOC_ITEMS, 10, 'sp')},
    bt AS (SELECT item_id::varchar AS query_id, list_distinct({TERMS}) AS ts FROM benchmark), dd AS (SELECT doc_id::varchar AS item_id, list_distinct({TERMS}) AS ts FROM documents),
    cc AS (SELECT query_id, item_id, qn, dn, count(*) AS c FROM (SELECT query_id, len(ts) AS qn, unnest(ts) AS t FROM bt) JOIN (SELECT item_id, len(ts) AS dn, unnest(ts) AS t FROM dd) USING (t) GROUP BY ALL),
    de AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS rank FROM (SELECT query_id, item_id, round(c / sqrt(greatest(qn, 1) * greatest(dn, 1)), 9) AS score FROM cc) QUALIFY rank <= 10)"""


def _dense(spark, sf, k: int = 10) -> DataFrame:
    """Cosine of binary term vectors: a dense stand-in that SQL can follow."""
    return retrieval.binary_cosine(_queries(spark, sf), _doc_items(spark, sf), k)


@query(FUSE + """, f AS (SELECT query_id, item_id, sp.rank AS sparse_rank, de.rank AS dense_rank, round(coalesce(1 / (60 + sp.rank), 0) + coalesce(1 / (60 + de.rank), 0), 9) AS score FROM sp FULL JOIN de USING (query_id, item_id))
    SELECT query_id, item_id, sparse_rank, dense_rank, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS rank FROM f QUALIFY rank <= 10""")
def rrf_fusion(spark, sf):
    out = retrieval.reciprocal_rank(retrieval.bm25(_queries(spark, sf), _doc_items(spark, sf), 10), _dense(spark, sf), 10)
    return out.select("query_id", "item_id", "sparse_rank", "dense_rank", F.round("score", 6).alias("score"), "rank")


@query(FUSE + """, u AS (SELECT query_id, item_id, 0 AS s, rank AS r, score FROM sp WHERE rank <= 4 UNION ALL SELECT query_id, item_id, 1, rank, score FROM de WHERE rank <= 3),
    f AS (SELECT query_id, item_id, max(CASE WHEN s = 0 THEN r END) AS sparse_rank, max(CASE WHEN s = 1 THEN r END) AS dense_rank, arg_min(score, s) AS score, min(s * 1000 + r) AS o FROM u GROUP BY ALL)
    SELECT query_id, item_id, sparse_rank, dense_rank, round(score, 6) AS score, CASE WHEN sparse_rank IS NOT NULL AND dense_rank IS NOT NULL THEN 'sparse+dense' WHEN sparse_rank IS NOT NULL THEN 'sparse' ELSE 'dense' END AS source_method, row_number() OVER (PARTITION BY query_id ORDER BY o)::int AS rank FROM f""")
def interleave_fusion(spark, sf):
    out = retrieval.interleave(retrieval.bm25(_queries(spark, sf), _doc_items(spark, sf), 10), _dense(spark, sf), 7)
    return out.withColumn("score", F.round("score", 6))


# --- dense and combined stages -----------------------------------------------------------------
def _data(spark, sf) -> tables.Retrieval:
    """The driver's tables as a normalised data set: documents, their 256-token passages, benchmark items as queries."""
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("title"), "text")
    p = chunking.fixed(docs(spark, sf), 256).select(F.col("chunk_id").alias("passage_id"), F.col("doc_id").cast("string").alias("document_id"), F.col("text").alias("passage_text"), F.col("chunk_order").alias("passage_position"))
    q = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query_text"), F.lit("documents").alias("dataset"), F.lit("test").alias("split"))
    ev = _evidence(spark, sf).select("query_id", F.col("doc_id").cast("string").alias("document_id"))
    r = ev.join(p, "document_id").select("query_id", "passage_id", F.lit(1.0).alias("relevance")).distinct()
    return tables.Retrieval("documents", d, p, q, r)


def _stages(spark, sf, **more) -> hierarchy.Retrievers:
    return hierarchy.Retrievers(_data(spark, sf), hierarchy.Config(document_k=5, passage_k=10, final_k=10, native_hash=True, dim=512, lead=2000, **more))


def dense_sql(items: str, name: str) -> str:
    """CTE: signed hash vectors of unit length (item_id, b, w)."""
    return f"""{name}_h AS (SELECT item_id, {BUCKET.format(dim=512)} AS b, sum(CASE WHEN substr(md5(t), 16, 1) >= '8' THEN -1 ELSE 1 END) AS w FROM (SELECT item_id, unnest({TERMS}) AS t FROM ({items})) GROUP BY ALL),
    {name} AS (SELECT item_id, b, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS w FROM {name}_h)"""


ASKED = dense_sql("SELECT item_id::varchar AS item_id, text FROM benchmark", "qv")
DENSE_DOCS = f"""{ASKED}, {dense_sql('SELECT doc_id::varchar AS item_id, trim(substr(text, 1, 2000)) AS text FROM documents', 'dv')},
    dd AS (SELECT q.item_id::varchar AS query_id, d.doc_id::varchar AS item_id, coalesce(score, 0.0) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN (SELECT qv.item_id AS qi, dv.item_id AS di, round(sum(qv.w * dv.w), 9) AS score FROM qv JOIN dv ON qv.b = dv.b GROUP BY ALL) s ON qi = q.item_id::varchar AND di = d.doc_id::varchar),
    de AS (SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS rank FROM dd QUALIFY rank <= {{k}})"""


@query(f"WITH {DENSE_DOCS.replace("{k}", "5")} SELECT query_id, item_id AS document_id, round(score, 6) AS document_score, rank AS document_rank FROM de")
def dense_documents_top5(spark, sf):
    return _stages(spark, sf).documents_by("dense").select("query_id", "document_id", F.round("document_score", 6).alias("document_score"), "document_rank")


DENSE_PASSAGES = f"""{DENSE_DOCS.replace("{k}", "5")}, pp AS ({PASSAGES}), {dense_sql('SELECT item_id, text FROM pp', 'pv')},
    cd AS (SELECT de.query_id, pp.item_id, pp.document_id, coalesce(s.score, 0.0) AS score FROM de JOIN pp ON pp.document_id = de.item_id LEFT JOIN (SELECT qv.item_id AS qi, pv.item_id AS pi, round(sum(qv.w * pv.w), 9) AS score FROM qv JOIN pv ON qv.b = pv.b GROUP BY ALL) s ON qi = de.query_id AND pi = pp.item_id),
    dp AS (SELECT query_id, item_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS rank FROM cd QUALIFY rank <= 10)"""


@query(f"WITH {DENSE_PASSAGES} SELECT query_id, item_id AS passage_id, document_id, round(score, 6) AS passage_score, rank AS passage_rank FROM dp")
def dense_passages_restricted(spark, sf):
    s = _stages(spark, sf)
    return s.passages_by("dense", s.documents_by("dense")).select("query_id", "passage_id", "document_id", F.round("passage_score", 6).alias("passage_score"), "passage_rank")


COMBINED = f"WITH {bm25_sql(DOC_ITEMS, 10, 'sp')}, {DENSE_DOCS.replace("{k}", "10")}"


@query(COMBINED + """, u AS (SELECT query_id, item_id, 0 AS s, rank AS r FROM sp WHERE rank <= 3 UNION ALL SELECT query_id, item_id, 1, rank FROM de WHERE rank <= 2),
    f AS (SELECT query_id, item_id, max(CASE WHEN s = 0 THEN r END) AS sparse_rank, max(CASE WHEN s = 1 THEN r END) AS dense_rank, min(s * 1000 + r) AS o FROM u GROUP BY ALL)
    SELECT query_id, item_id AS document_id, sparse_rank, dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY o)::int AS document_rank FROM f""")
def combined_interleave(spark, sf):
    return _stages(spark, sf).documents_by("combined").select("query_id", "document_id", "sparse_rank", "dense_rank", "document_rank")


@query(COMBINED + """, f AS (SELECT query_id, item_id, sp.rank AS sparse_rank, de.rank AS dense_rank, round(coalesce(1 / (60 + sp.rank), 0) + coalesce(1 / (60 + de.rank), 0), 9) AS score FROM sp FULL JOIN de USING (query_id, item_id))
    SELECT query_id, item_id AS document_id, sparse_rank, dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id)::int AS document_rank FROM f QUALIFY document_rank <= 5""")
def combined_rrf(spark, sf):
    return _stages(spark, sf, combined="rrf").documents_by("combined").select("query_id", "document_id", "sparse_rank", "dense_rank", "document_rank")


GRADES = "qrel AS (SELECT DISTINCT ev.query_id, pp.item_id FROM ev JOIN pp ON pp.document_id = ev.doc_id::varchar), nr AS (SELECT query_id, count(*) AS n FROM qrel GROUP BY 1)"


@query(f"""WITH {EVIDENCE}, {DENSE_PASSAGES}, {GRADES}, g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, count(*) AS got10, count(*) FILTER (rank <= 5) AS got5 FROM dp JOIN qrel USING (query_id, item_id) GROUP BY 1),
    sv AS (SELECT query_id, avg((de.item_id IS NOT NULL)::int) AS alive FROM (SELECT DISTINCT query_id, doc_id::varchar AS item_id FROM ev) e LEFT JOIN de USING (query_id, item_id) GROUP BY 1),
    q AS (SELECT query_id, round(coalesce(dcg, 0) / (SELECT sum(1 / log2(x + 1)) FROM unnest(generate_series(1, least(10, n))) AS u(x)), 6) AS ndcg, round(coalesce(got5, 0) / n, 6) AS r5, round(coalesce(got10, 0) / n, 6) AS r20, round(alive, 6) AS alive FROM nr LEFT JOIN g USING (query_id) LEFT JOIN sv USING (query_id))
    SELECT round(avg(ndcg), 6) AS "passage_ndcg@10", round(avg(r5), 6) AS "passage_recall@5", round(avg(r20), 6) AS "passage_recall@20", round(avg(alive), 6) AS candidate_survival_rate FROM q""")
def two_stage_dense_metrics(spark, sf):
    s = _stages(spark, sf)
    d = s.documents_by("dense")
    made = hierarchy.averaged(hierarchy.per_query(_data(spark, sf), d, s.passages_by("dense", d)))
    return made.select("`passage_ndcg@10`", "`passage_recall@5`", "`passage_recall@20`", "candidate_survival_rate")


@query(f"SELECT (SELECT sum(strlen(t) + 8) FROM (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest({TERMS}) AS t FROM documents)))::bigint + 8 * (SELECT count(*) FROM documents) AS storage_bytes")
def sparse_storage_bytes(spark, sf):
    return hierarchy.storage_bytes(_doc_items(spark, sf))


@query("SELECT round(avg(n_chars), 6) AS mean_query_latency_ms, round(quantile_cont(n_chars, 0.5), 6)::double AS p50_query_latency_ms, round(quantile_cont(n_chars, 0.95), 6)::double AS p95_query_latency_ms FROM documents")
def latency_statistics(spark, sf):
    return hierarchy.latencies(read(spark, sf, "documents").select(F.col("n_chars").alias("latency_ms")))


@query(f"WITH {EVIDENCE}, ch AS ({fixed_sql(256)}) SELECT DISTINCT query_id, doc_id::varchar AS document_id, 1.0::double AS relevance FROM ev JOIN ch USING (doc_id)")
def document_qrels(spark, sf):
    p = _passages(spark, sf)
    ev = _evidence(spark, sf).select("query_id", F.col("doc_id").cast("string").alias("document_id"))
    qrels = ev.join(p, "document_id").select("query_id", "item_id", F.lit(1.0).alias("relevance")).distinct()
    return evaluation.document_qrels(qrels, p)


SURVIVE = f"WITH {EVIDENCE}, {bm25_sql(DOC_ITEMS, 3, 'h')}, sv AS (SELECT query_id, round(avg((h.item_id IS NOT NULL)::int), 6) AS candidate_survival_rate FROM (SELECT DISTINCT query_id, doc_id::varchar AS item_id FROM ev) e LEFT JOIN h USING (query_id, item_id) GROUP BY query_id)"


def _survival(spark, sf) -> DataFrame:
    qrels = _evidence(spark, sf).select("query_id", F.col("doc_id").cast("string").alias("document_id"), F.lit(1.0).alias("relevance"))
    return evaluation.survival(qrels, retrieval.bm25(_queries(spark, sf), _doc_items(spark, sf), 3).select("query_id", F.col("item_id").alias("document_id")))


@query(SURVIVE + " SELECT * FROM sv")
def candidate_survival(spark, sf):
    return _survival(spark, sf)


@query(SURVIVE + """, m AS (SELECT query_id, candidate_survival_rate AS v, unnest(list_distinct(['overall', CASE WHEN query_id::int % 2 = 0 THEN 'CR' ELSE 'MT' END, CASE WHEN query_id::int % 3 = 0 THEN 'MHR' ELSE 'MT' END])) AS category FROM sv)
    SELECT c.category, count(v)::bigint AS n, round(avg(v), 6) AS mean FROM (SELECT unnest(['overall', 'CR', 'MT', 'MHR', 'AC']) AS category) c LEFT JOIN m ON c.category = m.category GROUP BY c.category""")
def category_breakdown(spark, sf):
    q = _queries(spark, sf)
    n = F.col("query_id").cast("int")
    meta = q.select("query_id", F.concat(F.when(n % 2 == 0, "cr").otherwise("MT"), F.lit(", "), F.when(n % 3 == 0, "MHR").otherwise("MT")).alias("question_type"))
    return evaluation.by_category(_survival(spark, sf), meta, "candidate_survival_rate")


# --- semantic, perplexity and summary chunks ---------------------------------------------------
HASHED = f"""{SEGMENTS}, tk AS (SELECT doc_id, pos, unnest({LEX}) AS t FROM seg), vec AS (SELECT doc_id, pos, {BUCKET.format(dim=256)} AS b, count(*) AS c FROM tk GROUP BY ALL), nrm AS (SELECT doc_id, pos, sqrt(sum(c * c)) AS norm FROM vec GROUP BY ALL)"""
ADJ = HASHED + """, dt AS (SELECT a.doc_id, a.pos, sum(a.c * b.c) AS dot FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.pos + 1 = b.pos AND a.b = b.b GROUP BY ALL),
    adj AS (SELECT s.doc_id, s.pos, round(CASE WHEN n1.norm IS NULL OR n2.norm IS NULL THEN 1.0 ELSE 1 - coalesce(dot, 0) / (n1.norm * n2.norm) END, 9) AS distance FROM seg s JOIN seg s2 ON s.doc_id = s2.doc_id AND s.pos + 1 = s2.pos
      LEFT JOIN nrm n1 ON n1.doc_id = s.doc_id AND n1.pos = s.pos LEFT JOIN nrm n2 ON n2.doc_id = s.doc_id AND n2.pos = s.pos + 1 LEFT JOIN dt ON dt.doc_id = s.doc_id AND dt.pos = s.pos),
    th AS (SELECT doc_id, round(quantile_cont(distance, 0.9), 9) AS threshold FROM adj GROUP BY 1)"""


@query(f"WITH {ADJ} SELECT doc_id, pos, round(distance, 6) AS distance FROM adj")
def adjacent_distances(spark, sf):
    return chunking.adjacent_distances(docs(spark, sf)).withColumn("distance", F.round("distance", 6))


@query(f"WITH {ADJ} SELECT doc_id, round(quantile_cont(distance, 0.75), 6) AS percentile_75, round(avg(distance) + stddev_pop(distance), 6) AS mean_std, round(avg(distance) + 1.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25)), 6) AS mean_iqr, 0.5::double AS absolute FROM adj GROUP BY doc_id")
def threshold_policies(spark, sf):
    d = chunking.distances(docs(spark, sf)).where(F.size("d") > 0)
    named = {"percentile_75": ("percentile", 75.0), "mean_std": ("mean_std", 1.0), "mean_iqr": ("mean_iqr", 1.5), "absolute": ("absolute", 0.5)}
    return d.select("doc_id", *[F.round(chunking.threshold(F.col("d"), *how), 6).alias(n) for n, how in named.items()])


@query(f"WITH {ADJ}, marked AS (SELECT seg.*, coalesce(distance > threshold, false) AS cut FROM seg LEFT JOIN adj USING (doc_id, pos) LEFT JOIN th USING (doc_id)), " + merged_sql("semantic"))
def semantic_breakpoint(spark, sf):
    return _short(chunking.semantic_breakpoint(docs(spark, sf), least=0))


MARKED = f"{ADJ}, marked AS (SELECT seg.*, coalesce(distance > threshold, false) AS cut FROM seg LEFT JOIN adj USING (doc_id, pos) LEFT JOIN th USING (doc_id))"


@query(f"""WITH RECURSIVE {MARKED.replace(', marked AS', ', found AS')},
    walk AS (SELECT doc_id, pos, cut AND token_count >= 32 AS cut, CASE WHEN cut AND token_count >= 32 THEN 0 ELSE token_count END AS run FROM found WHERE pos = 0
      UNION ALL SELECT f.doc_id, f.pos, f.cut AND w.run + f.token_count >= 32, CASE WHEN f.cut AND w.run + f.token_count >= 32 THEN 0 ELSE w.run + f.token_count END FROM walk w JOIN found f ON f.doc_id = w.doc_id AND f.pos = w.pos + 1),
    ends AS (SELECT doc_id, max(pos) FILTER (cut) AS last_cut, arg_max(run, pos) AS left_over FROM walk GROUP BY 1),
    marked AS (SELECT seg.*, walk.cut AND NOT coalesce(left_over > 0 AND left_over < 32 AND pos = last_cut, false) AS cut FROM seg JOIN walk USING (doc_id, pos) JOIN ends USING (doc_id)), """ + merged_sql("semantic"))
def semantic_merged_32(spark, sf):
    """Groups under 32 tokens join the next one, a last small one the one before."""
    return _short(chunking.semantic_breakpoint(docs(spark, sf)))


def scored_sql(context: str) -> str:
    """CTEs: segments with the deterministic transition score, and ``marked`` with cuts at its minima."""
    seen = {"all_previous_segments": "SELECT doc_id, pos, count(*) FILTER (f = pos) AS fresh, count(*) AS n FROM (SELECT *, min(pos) OVER (PARTITION BY doc_id, t) AS f FROM wd) GROUP BY ALL", "previous_segment": "SELECT a.doc_id, a.pos, count(*) FILTER (b.t IS NULL) AS fresh, count(*) AS n FROM wd a LEFT JOIN wd b ON b.doc_id = a.doc_id AND b.pos = a.pos - 1 AND b.t = a.t GROUP BY ALL", "none": "SELECT doc_id, pos, count(*) AS fresh, count(*) AS n FROM wd GROUP BY ALL"}[context]
    jitter = BUCKET.format(dim=65536).replace("md5(t)", "md5(text)") + " / 65535.0 / 1000"
    return f"""{SEGMENTS}, wd AS (SELECT DISTINCT doc_id, pos, t FROM (SELECT doc_id, pos, unnest({TOKENS.format('lower(text)')}) AS t FROM seg)), fs AS ({seen}),
    sc AS (SELECT seg.*, round(fresh / n + {jitter}, 9) AS score FROM seg JOIN fs USING (doc_id, pos)),
    lm AS (SELECT *, lag(score) OVER w AS a, lead(score) OVER w AS c FROM sc WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    marked AS (SELECT *, coalesce(score < a AND score <= c AND greatest(a - score, c - score) >= 0.05 - 1e-12, false) AS cut FROM lm)"""


@query(f"WITH {scored_sql('all_previous_segments')} SELECT doc_id, pos, score, cut FROM marked")
def local_minima(spark, sf):
    m = chunking.minima(chunking.scored_segments(docs(spark, sf)), 0.05)
    rows = F.zip_with("scores", "cuts", lambda s, c: F.struct(s.alias("score"), c.alias("cut")))
    return m.select("doc_id", F.posexplode(rows).alias("pos", "x")).select("doc_id", "pos", "x.score", "x.cut")


@query(f"WITH {scored_sql('all_previous_segments')}, " + merged_sql("ppl"))
def perplexity_chunks(spark, sf):
    return _short(chunking.perplexity_chunks(docs(spark, sf)))


@query(f"WITH {scored_sql('previous_segment')}, " + merged_sql("ppl"))
def perplexity_previous_segment(spark, sf):
    return _short(chunking.perplexity_chunks(docs(spark, sf), context="previous_segment"))


@query(f"WITH {scored_sql('none')}, " + merged_sql("ppl"))
def perplexity_no_context(spark, sf):
    return _short(chunking.perplexity_chunks(docs(spark, sf), context="none"))


def capped_sql(cte: str, method: str, most: int) -> str:
    """Chunks after groups over ``most`` tokens are split greedily between segments."""
    return f"""WITH RECURSIVE {cte}, mk AS (SELECT *, coalesce(lag(cut) OVER (PARTITION BY doc_id ORDER BY pos), false) AS before FROM marked),
    walk AS (SELECT doc_id, pos, token_count AS run, 0 AS g FROM mk WHERE pos = 0
      UNION ALL SELECT m.doc_id, m.pos, CASE WHEN m.before OR w.run + m.token_count > {most} THEN m.token_count ELSE w.run + m.token_count END, CASE WHEN m.before OR w.run + m.token_count > {most} THEN w.g + 1 ELSE w.g END FROM walk w JOIN mk m ON m.doc_id = w.doc_id AND m.pos = w.pos + 1)
    SELECT doc_id, g::int AS chunk_order, doc_id || ':{method}:' || g AS chunk_id, n AS token_count, md5(substr(text, s + 1, e - s)) AS text_md5
    FROM (SELECT doc_id, g, min(start) AS s, max("end") AS e, sum(token_count)::int AS n FROM walk JOIN seg USING (doc_id, pos) GROUP BY doc_id, g) JOIN documents USING (doc_id)"""


@query(capped_sql(scored_sql("all_previous_segments"), "ppl", 512))
def perplexity_dynamic_512(spark, sf):
    return _short(chunking.perplexity_chunks(docs(spark, sf), most=512))


PIC = f"""{HASHED}, hv AS (SELECT doc_id, {BUCKET.format(dim=256)} AS b, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(lower(array_to_string({TOKENS.format('text')}[1:48], ' ')), '{T.LEXICAL}')) AS t FROM documents) GROUP BY ALL),
    hn AS (SELECT doc_id, sqrt(sum(c * c)) AS norm FROM hv GROUP BY ALL), ds AS (SELECT v.doc_id, v.pos, sum(v.c * hv.c) AS dot FROM vec v JOIN hv ON v.doc_id = hv.doc_id AND v.b = hv.b GROUP BY ALL),
    sm AS (SELECT seg.*, round(coalesce(dot / (nrm.norm * hn.norm), 0.0), 9) AS similarity FROM seg LEFT JOIN nrm USING (doc_id, pos) LEFT JOIN hn USING (doc_id) LEFT JOIN ds USING (doc_id, pos)),
    ab AS (SELECT *, similarity >= round(avg(similarity) OVER (PARTITION BY doc_id), 9) AS above FROM sm),
    marked AS (SELECT *, coalesce(above <> lead(above) OVER (PARTITION BY doc_id ORDER BY pos), false) AS cut FROM ab)"""


@query(f"WITH {PIC}, " + merged_sql("pic"))
def pic_islands(spark, sf):
    return _short(chunking.pic_chunks(docs(spark, sf)))


@query(capped_sql(PIC, "pic", 512))
def pic_capped_512(spark, sf):
    return _short(chunking.pic_chunks(docs(spark, sf), most=512))


@query(f"""WITH {HASHED}, nn AS (SELECT doc_id, count(*) AS n FROM seg GROUP BY 1), dt AS (SELECT a.doc_id, a.pos AS i, b.pos AS j, sum(a.c * b.c) AS dot FROM vec a JOIN vec b ON a.doc_id = b.doc_id AND a.b = b.b AND a.pos < b.pos GROUP BY ALL)
    SELECT a.doc_id, a.pos AS i, b.pos AS j, round(0.5 * (b.pos - a.pos) / n + 0.5 * greatest(0.0, least(1.0, coalesce(1 - coalesce(dot, 0) / (x.norm * y.norm), 1.0))) + 1e-10, 6) AS distance
    FROM seg a JOIN seg b ON a.doc_id = b.doc_id AND a.pos < b.pos JOIN nn ON nn.doc_id = a.doc_id LEFT JOIN dt ON dt.doc_id = a.doc_id AND dt.i = a.pos AND dt.j = b.pos LEFT JOIN nrm x ON x.doc_id = a.doc_id AND x.pos = a.pos LEFT JOIN nrm y ON y.doc_id = a.doc_id AND y.pos = b.pos""")
def pairwise_distance(spark, sf):
    return chunking.pairwise_distance(docs(spark, sf))


@query()
def single_linkage(spark, sf):
    return chunking.single_linkage(docs(spark, sf))


@query()
def hash_embed_blake2b(spark, sf):
    return vectors.hashing(docs(spark, sf).select(F.col("doc_id").cast("string").alias("item_id"), "text"), 256)


@query()
def late_pooling_blake2b(spark, sf):
    d = docs(spark, sf)
    return vectors.late_pooling(d, chunking.late(d, 256), 256, policy="window")


@query(f"""WITH ch AS ({fixed_sql(256, method='late')}), tk AS (SELECT chunk_id, doc_id, token_count AS n, unnest({TOKENS.format('lower(text)')}) AS t FROM ch),
    own AS (SELECT chunk_id, n, {BUCKET.format(dim=256)} AS b, count(*) AS c FROM tk GROUP BY ALL),
    ctx AS (SELECT chunk_id, token_count AS n, {BUCKET.format(dim=256)} AS b, token_count AS c FROM ch JOIN (SELECT doc_id, lower(text) AS t FROM documents) USING (doc_id))
    SELECT chunk_id AS item_id, b::int AS bucket, round(sum(c) / min(n), 6) AS weight FROM (SELECT * FROM own UNION ALL SELECT * FROM ctx) GROUP BY chunk_id, b""")
def late_pooling(spark, sf):
    d = docs(spark, sf)
    return vectors.late_pooling(d, chunking.late(d, 256), 256, policy="window", native=True).withColumn("weight", F.round("weight", 6))


OWED = f"{SEGMENTS}, owed AS (SELECT doc_id, sum(token_count) AS owed, max(token_count) AS longest FROM seg GROUP BY 1), c AS ({fixed_sql(256)})"


@query(f"""WITH {OWED}, n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
    SELECT rule, count(*)::bigint AS n FROM (SELECT 'segments lost' AS rule, doc_id FROM n WHERE doc_id % 4 = 1 UNION ALL SELECT 'chunk orders have holes', doc_id FROM n WHERE doc_id % 4 = 2 UNION ALL SELECT 'segments repeated', doc_id FROM n WHERE doc_id % 4 = 3 UNION ALL SELECT 'chunk orders have holes', doc_id FROM n WHERE doc_id % 4 = 3
      UNION ALL SELECT 'chunks over the cap', doc_id FROM n JOIN owed USING (doc_id) WHERE longest <= 250 AND (SELECT max(token_count) FROM c WHERE c.doc_id = n.doc_id AND (n.doc_id % 4 <> 1 OR c.chunk_order < n.n - 1)) > 250 UNION ALL SELECT 'chunks of an unknown document', 0) GROUP BY rule""")
def advanced_chunk_contract(spark, sf):
    """Chunks of three methods, which break no rule, and chunks with planted faults: a last one lost, orders from 1, a last one twice, all over the cap."""
    d = docs(spark, sf)
    sound = [(chunking.semantic_breakpoint(d), None), (chunking.perplexity_chunks(d, most=512), 512), (chunking.pic_chunks(d, most=512), 512)]
    # what several parts of the plan read is made once; the rules look at orders and counts only
    segs, fixed = tables.settled(chunking.owed(d)), tables.settled(chunking.fixed(d, 256).select("doc_id", "chunk_order", "token_count"))
    c = fixed.withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    of, last = F.col("doc_id") % 4, F.col("chunk_order") == F.col("n") - 1
    broken = c.where(~((of == 1) & last)).withColumn("chunk_order", F.col("chunk_order") + (of == 2).cast("int")).unionByName(c.where((of == 3) & last)).drop("n")
    broken = broken.unionByName(c.limit(1).withColumn("doc_id", F.lit(-1).cast("long")).withColumn("chunk_order", F.lit(0)).drop("n"))
    whole = chunking.advanced_violations(d, broken, 250, segs)
    for made, most in sound:
        whole = whole.unionByName(chunking.advanced_violations(d, made, most, segs))
    return whole.groupBy("rule").agg(F.count("*").alias("n"))


# --- relational, streams ------------------------------------------------------------------------
@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*)::bigint AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf):
    li = read(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*)::bigint AS n FROM events GROUP BY ALL")
def streamed_event_counts(spark, sf):
    return stream.windowed_counts(spark, sf)
