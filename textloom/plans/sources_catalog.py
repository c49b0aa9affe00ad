"""Queries of readers, contracts and streams: files made from the driver's tables in the formats that the readers take."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, evaluation, retrieval, validation
from ..sources import raw, tables
from ..sources.tables import folder  # noqa: F401  others find it here too
from ..streaming import stream
from . import catalog, hierarchy, matrix
from .catalog import EVIDENCE, PAIRS, TOKENS, docs, fixed_sql, query, read
from .matrix import write_json


def put_lines(df: DataFrame, path: str, **options) -> str:
    """A row of ``df`` (one string column) to a line of text files."""
    df.write.options(**options).text(path)
    return path


#: Rows of an object or list that a file holds, about.
FILE_ROWS = 500


def put_whole(rows: DataFrame, key: str, whole, path: str) -> str:
    """Rows dealt by ``key`` to groups of about ``FILE_ROWS``; ``whole`` gathers a group into one JSON value, a file each."""
    n = max(1, rows.count() // FILE_ROWS)
    dealt = rows.withColumn("file", F.pmod(F.xxhash64(key), F.lit(n))).groupBy("file").agg(whole.alias("value"))
    return put_lines(dealt.select("value"), path, maxRecordsPerFile=1)


def _pairs(spark, sf) -> DataFrame:
    return evaluation.containing(read(spark, sf, "benchmark"), docs(spark, sf)).select("item_id", "doc_id")


# --- raw formats -------------------------------------------------------------------------------
LINES = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f\\v]'))"


@query(f"""WITH {PAIRS}, b AS (SELECT doc_id, array_to_string({LINES}, chr(10) || chr(10)) AS body FROM documents),
    q AS (SELECT item_id, doc_id, body, i.text AS t FROM pairs JOIN b USING (doc_id) JOIN (SELECT item_id, text FROM benchmark) i USING (item_id))
    SELECT item_id || '-' || doc_id || ':e0' AS evidence_id, 'qasper:' || doc_id AS document_id, CASE WHEN contains(body, t) THEN (strpos(body, t) - 1)::int END AS start, CASE WHEN contains(body, t) THEN (strpos(body, t) - 1 + length(t))::int END AS "end", CASE WHEN NOT contains(body, t) THEN 'not found verbatim' END AS reason FROM q
    UNION ALL SELECT item_id || '-' || doc_id || ':e1', 'qasper:' || doc_id, NULL, NULL, 'not found verbatim' FROM q""")
def papers_evidence(spark, sf):
    """Documents that hold an item as papers in JSON objects; each item asks for itself and for a text that no paper has."""
    b = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    answer = F.array(F.struct(F.struct(F.lit(False).alias("unanswerable"), F.array("item", F.lit("~ nowhere ~")).alias("evidence")).alias("answer")))
    asked = _pairs(spark, sf).join(b, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct(F.concat_ws("-", "item_id", "doc_id").alias("question_id"), F.lit("?").alias("question"), answer.alias("answers"))).alias("qas"))  # a document's own items
    lines = F.split("text", "\n")
    d = read(spark, sf, "documents").join(asked, "doc_id")
    rest = F.struct(F.lit("Body").alias("section_name"), F.slice(lines, 2, F.size(lines)).alias("paragraphs"))
    paper = F.struct(F.col("source").alias("title"), F.slice(lines, 1, 1).alias("abstract"), F.array(rest).alias("full_text"), "qas")
    whole = F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), F.col("paper")))))
    path = put_whole(d.select("doc_id", paper.alias("paper")), "doc_id", whole, folder(spark))
    return raw.papers(spark, path).evidence.select("evidence_id", "document_id", "start", "end", "reason")


HOPS = f"""{PAIRS}, h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) - 1 AS nth FROM pairs),
    l AS (SELECT doc_id, text, regexp_extract(text, '[^\\n]*$') AS last FROM documents)"""


@query(f"WITH {HOPS} SELECT item_id::varchar AS query_id, item_id || ':e' || nth AS evidence_id, 'hotpotqa:Doc-' || doc_id AS document_id, md5(last) AS text_md5, len({TOKENS.format('last')})::int AS token_count, (length(text) - length(last))::int AS start, length(text)::int AS \"end\" FROM h JOIN l USING (doc_id)")
def multi_hop_evidence(spark, sf):
    """All documents as a corpus of articles in compressed JSON lines; items ask for the last line of the documents that hold them."""
    at = folder(spark)
    article = F.to_json(F.struct(F.concat(F.lit("Doc_"), F.col("doc_id")).alias("title"), F.split("text", "\n").alias("text")))
    put_lines(docs(spark, sf).select(article), f"{at}/corpus", compression="bzip2")
    last = F.size(F.split("text", "\n")) - 1
    pairs = retrieval.small(tables.settled(_pairs(spark, sf)))
    facts = docs(spark, sf).join(pairs, "doc_id").groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", last.alias("i")))).alias("f"))  # an item's documents
    said = F.transform("f", lambda x: F.array(F.concat(F.lit("Doc  "), x["doc_id"]), x["i"].cast("string")))
    q = facts.select(F.struct(F.col("item_id").cast("string").alias("_id"), F.lit("?").alias("question"), F.lit("!").alias("answer"), said.alias("supporting_facts")).alias("q"))
    put_whole(q, "q._id", F.to_json(F.collect_list("q")), f"{at}/questions")
    e = raw.multi_hop(spark, f"{at}/questions", f"{at}/corpus").evidence
    return e.select("query_id", "evidence_id", "document_id", F.md5("text").alias("text_md5"), "token_count", "start", "end")


# --- normalised tables, contracts --------------------------------------------------------------
AUDIT = f"""ch AS ({fixed_sql(256)}), ql AS (SELECT DISTINCT item_id, ch.chunk_id FROM pairs JOIN ch USING (doc_id))
    SELECT (SELECT count(*) FROM documents)::bigint AS documents, (SELECT round(avg((source IS NULL OR trim(source) = '')::int), 6) FROM documents) AS missing_title_rate, (SELECT round(avg((length(source) > 300)::int), 6) FROM documents) AS noisy_title_rate, (SELECT count(*) FROM ch)::bigint AS passages,
    (SELECT round(count(*) / count(DISTINCT doc_id), 6) FROM ch) AS mean_passages_per_document, (SELECT count(*) FROM benchmark)::bigint AS queries, 'test' AS splits, (SELECT count(*) FROM ql)::bigint AS qrels, false AS graded_qrels"""


def _titled(spark, sf) -> tables.Retrieval:
    d = tables.spread(read(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("title"), "text")
    return replace(catalog._data(spark, sf), documents=d)


def _audited(data: tables.Retrieval) -> DataFrame:
    a = validation.audit(data)
    return a.select(*[F.round(c, 6).alias(c) if "rate" in c or "mean" in c else c for c in a.columns])


@query(f"WITH {PAIRS}, {AUDIT}")
def dataset_audit(spark, sf):
    return _audited(_titled(spark, sf))


@query(f"WITH {PAIRS}, {AUDIT}")
def manifest_tables(spark, sf):
    """The normalised tables written in four formats under names of a source, and read back by their manifest."""
    at, data = folder(spark), _titled(spark, sf)
    tables.write_table(data.documents.withColumnRenamed("document_id", "id"), f"{at}/d.parquet")
    tables.write_table(data.passages, f"{at}/p.jsonl", "json")
    tables.write_table(data.queries, f"{at}/q.parquet")
    tables.write_table(data.qrels.withColumnRenamed("relevance", "grade"), f"{at}/r.csv", "csv")
    write_json(spark, f"{at}/manifest.json", {"documents": "d.parquet", "passages": "p.jsonl", "queries": "q.parquet", "qrels": "r.csv", "column_maps": {"documents": {"document_id": "id"}, "qrels": {"relevance": "grade"}}})
    got = tables.from_manifest(spark, at, "documents")
    validation.check(validation.retrieval_violations(got))
    return _audited(got)


def _bundle(spark, sf) -> raw.Bundle:
    d = docs(spark, sf).select(F.col("doc_id").cast("string").alias("document_id"), "text")
    b = read(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")
    hits = evaluation.containing(read(spark, sf, "benchmark"), docs(spark, sf)).select(F.col("item_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("document_id"), "start")
    rel = hits.groupBy("query_id").agg(F.collect_set("document_id").alias("rel"))  # an item's documents
    q = b.join(rel, "query_id", "left").select("query_id", "text", F.coalesce("rel", F.array().cast("array<string>")).alias("relevant_document_ids"), F.col("rel").isNull().alias("unanswerable"))
    e = hits.join(b, "query_id").select("query_id", F.concat_ws(":", "query_id", "document_id").alias("evidence_id"), "document_id", "text", T.token_count(F.col("text")).alias("token_count"), "start", (F.col("start") + F.length("text")).alias("end"))
    return raw.Bundle(d, q, e)


def _faulty(spark, sf) -> raw.Bundle:
    """The bundle with planted faults: repeated queries, references to no document, texts out of place, wrong counts."""
    b = _bundle(spark, sf)
    odd = F.col("query_id").cast("long") % 2 == 1
    q = b.queries.unionByName(b.queries.where(odd)).withColumn("relevant_document_ids", F.concat("relevant_document_ids", F.array(F.concat(F.lit("no-"), F.col("query_id")))))
    e = b.evidence.withColumn("token_count", F.col("token_count") + odd.cast("int")).withColumn("start", F.col("start") + (~odd).cast("int")).withColumn("end", F.col("end") + (~odd).cast("int"))
    blank = b.documents.withColumn("text", F.when(F.col("document_id").cast("long") % 10 == 3, F.lit(" \n")).otherwise(F.col("text")))
    return raw.Bundle(blank, q, e)


@query(f"""WITH {EVIDENCE} SELECT (SELECT count(*) FROM documents)::bigint AS document_count, (SELECT count(*) - count(DISTINCT doc_id) FROM documents)::bigint AS duplicate_document_count, (SELECT count(*) FROM benchmark)::bigint AS query_count, (SELECT count(*) - count(DISTINCT item_id) FROM benchmark)::bigint AS duplicate_query_count,
    (SELECT count(*) FROM ev)::bigint AS evidence_count, (SELECT count(*) FROM ev)::bigint AS evidence_mapping_success_count, 0::bigint AS evidence_mapping_failure_count, 0::bigint AS missing_relevant_document_count, (SELECT count(*) FROM benchmark WHERE item_id::varchar NOT IN (SELECT query_id FROM ev))::bigint AS unanswerable_query_count, 1.0::double AS evidence_mapping_rate""")
def dataset_diagnostics(spark, sf):
    return validation.diagnostics(_bundle(spark, sf))


@query(f"""WITH {EVIDENCE}, o AS (SELECT count(*) FILTER (item_id % 2 = 1) AS odd FROM benchmark), x AS (SELECT count(*) FILTER (query_id::int % 2 = 1) AS eo FROM ev), bd AS (SELECT count(*) AS n FROM documents WHERE doc_id % 10 = 3 OR trim(text, ' ' || chr(10) || chr(9) || chr(13)) = '' OR text IS NULL)
    SELECT * FROM (SELECT 'duplicate query ids' AS rule, odd::bigint AS n FROM o UNION ALL SELECT 'documents without text', n::bigint FROM bd UNION ALL SELECT 'queries reference unknown documents', (SELECT count(*) FROM benchmark)::bigint UNION ALL SELECT 'token counts of evidence', eo::bigint FROM x) WHERE n > 0""")
def bundle_contract(spark, sf):
    return validation.bundle_violations(_faulty(spark, sf)).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"""WITH {EVIDENCE} SELECT CASE WHEN query_id::int % 2 = 1 THEN NULL WHEN start + 1 + length(text) > length(body) THEN 'span out of bounds' ELSE 'another text stands there' END AS problem, evidence_id FROM (SELECT ev.*, pairs.start, d.text AS body FROM ev JOIN pairs ON pairs.item_id::varchar = ev.query_id AND pairs.doc_id = ev.doc_id JOIN documents d ON d.doc_id = ev.doc_id) WHERE ev_count > 0""")
def evidence_mapping(spark, sf):
    b, f = _bundle(spark, sf), _faulty(spark, sf)
    return validation.mapping(raw.Bundle(b.documents, b.queries, f.evidence)).select("problem", "evidence_id")


@query(f"""WITH {PAIRS}, ch AS ({fixed_sql(256)}), ql AS (SELECT DISTINCT item_id, ch.chunk_id FROM pairs JOIN ch USING (doc_id)), s AS (SELECT count(*) AS n, count(*) FILTER (item_id % 2 = 1) AS odd FROM ql)
    SELECT * FROM (SELECT 'qrels repeat a query and passage' AS rule, odd::bigint AS n FROM s UNION ALL SELECT 'relevance not a non-negative number', (2 * odd)::bigint FROM s UNION ALL SELECT 'passages reference unknown documents', 1::bigint UNION ALL SELECT 'passage_position negative', 1::bigint UNION ALL SELECT 'qrels reference unknown queries', 1::bigint UNION ALL SELECT 'qrels reference unknown passages', 1::bigint) WHERE n > 0""")
def retrieval_contract(spark, sf):
    data = catalog._data(spark, sf)
    odd = F.col("query_id").cast("long") % 2 == 1
    r = data.qrels.unionByName(data.qrels.where(odd)).withColumn("relevance", F.when(odd, -1.0).otherwise(F.col("relevance")))
    r = r.unionByName(spark.createDataFrame([("nobody", "nothing", 1.0)], "query_id string, passage_id string, relevance double"))
    p = data.passages.unionByName(spark.createDataFrame([("p", "no-document", "text", -1)], "passage_id string, document_id string, passage_text string, passage_position int"))
    return validation.retrieval_violations(replace(data, passages=p, qrels=r)).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH c AS ({fixed_sql(256)}) SELECT 'token counts of chunks' AS rule, count(*)::bigint AS n FROM c WHERE chunk_order % 2 = 1 UNION ALL SELECT 'duplicate chunk ids', count(*)::bigint FROM c WHERE chunk_order = 0")
def chunk_contract(spark, sf):
    c = chunking.fixed(docs(spark, sf), 256)
    c = c.withColumn("token_count", F.col("token_count") + F.col("chunk_order") % 2).unionByName(c.where("chunk_order = 0"))
    return validation.chunk_violations(c).groupBy("rule").agg(F.count("*").alias("n"))


@query(f"WITH {EVIDENCE}, {catalog.COVER} SELECT evidence_id, count(*)::bigint AS n FROM cov WHERE len(covered) > 0 AND list_max(covered) >= ev_count - 1 GROUP BY 1")
def coverage_contract(spark, sf):
    c = evaluation.coverage(catalog._evidence(spark, sf), chunking.fixed(docs(spark, sf), 256))
    short = c.withColumn("ev_count", F.col("ev_count") - 1)  # as if each evidence had a token less
    return validation.coverage_violations(short).groupBy(F.col("example").alias("evidence_id")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'tune' WHEN 1 THEN 'select' ELSE 'report' END AS purpose, CASE WHEN lang = 'en' THEN 'ms_marco' WHEN lang = 'de' THEN 'nq_hard' ELSE lang END AS dataset, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 3 THEN 'test' ELSE 'dev' END AS split, doc_id % 5 <> 0 AS uses FROM documents), c AS (SELECT * FROM e WHERE purpose <> 'report')
    SELECT 'choices outside the training sets' AS rule, dataset AS example, count(*)::bigint AS n FROM c WHERE dataset <> 'ms_marco' OR split = 'test' GROUP BY 2 UNION ALL SELECT 'test labels used in a choice', dataset, count(*)::bigint FROM c WHERE split = 'test' AND uses GROUP BY 2 UNION ALL SELECT 'diagnostic sets used in a choice', dataset, count(*)::bigint FROM c WHERE dataset = 'nq_hard' GROUP BY 2""")
def protocol_contract(spark, sf):
    """An event for every document: its language stands for a data set, its number for purpose and split."""
    of = lambda by, *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % by).cast("int") + 1)
    dataset = F.when(F.col("lang") == "en", "ms_marco").when(F.col("lang") == "de", "nq_hard").otherwise(F.col("lang"))
    events = read(spark, sf, "documents").select(of(3, "tune", "select", "report").alias("purpose"), dataset.alias("dataset"), of(4, "train", "dev", "dev", "test").alias("split"), (F.col("doc_id") % 5 != 0).alias("uses_labels"))
    return validation.protocol_violations(events).groupBy("rule", "example").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(concat_ws(' ', nullif(trim(source), ''), nullif(substr(text, 1, 120), ''))) AS both, md5(coalesce(trim(source), '')) AS title, md5(substr(text, 1, 120)) AS lead FROM documents")
def document_representation(spark, sf):
    d = read(spark, sf, "documents")
    say = lambda how: F.md5(T.representation(F.col("source"), T.text_of(), how, 120))
    return d.select("doc_id", say("title_plus_lead").alias("both"), say("title_only").alias("title"), say("lead_only").alias("lead"))


@query(f"WITH {PAIRS}, ch AS ({fixed_sql(256)}), pick AS (SELECT item_id FROM benchmark ORDER BY md5('7:' || item_id), item_id::varchar LIMIT 10) SELECT item_id::varchar AS query_id, (SELECT count(DISTINCT ch.chunk_id) FROM pairs JOIN ch USING (doc_id) WHERE pairs.item_id = pick.item_id)::bigint AS judged FROM pick")
def sampled_queries(spark, sf):
    s = hierarchy.sampled(catalog._data(spark, sf), 10, 7, "test")
    return s.queries.join(s.qrels, "query_id", "left").groupBy("query_id").agg(F.count("passage_id").alias("judged"))


SETS = "('synthetic documents', 3), ('synthetic queries', 2), ('synthetic evidence', 2), ('small documents', 4), ('small passages', 7), ('small queries', 4), ('small qrels', 4)"


@query(f"""WITH {EVIDENCE}, ch AS ({fixed_sql(256)}), n AS (SELECT 'corpus documents' AS what, count(*)::bigint AS n FROM documents UNION ALL SELECT 'corpus queries', count(*)::bigint FROM benchmark UNION ALL SELECT 'corpus evidence', count(*)::bigint FROM ev
    UNION ALL SELECT 'tables documents', count(*)::bigint FROM documents UNION ALL SELECT 'tables passages', count(*)::bigint FROM ch UNION ALL SELECT 'tables queries', count(*)::bigint FROM benchmark UNION ALL SELECT 'tables qrels', count(DISTINCT (ev.query_id, ch.chunk_id))::bigint FROM ev JOIN ch USING (doc_id))
    SELECT * FROM n UNION ALL SELECT what, n::bigint FROM (VALUES {SETS}) AS t(what, n)""")
def synthetic_sets(spark, sf):
    """Rows of the corpus in both forms of a data set, beside those of the synthetic ones."""
    named = {}
    for name, b in (("corpus", _bundle(spark, sf)), ("synthetic", raw.synthetic(spark))):
        named |= {f"{name} documents": b.documents, f"{name} queries": b.queries, f"{name} evidence": b.evidence.where("start IS NOT NULL")}
    for name, r in (("tables", catalog._data(spark, sf)), ("small", tables.synthetic_retrieval(spark))):
        named |= {f"{name} documents": r.documents, f"{name} passages": r.passages, f"{name} queries": r.queries, f"{name} qrels": r.qrels}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(what).alias("what"), F.count("*").alias("n")) for what, df in named.items()])


@query(catalog._short_sql(fixed_sql(256)))
def streamed_chunks(spark, sf):
    """The documents read as a stream, chunked, and written as Parquet; one trigger over what is there."""
    at = folder(spark)
    source = spark.readStream.schema(spark.read.parquet(f"{sf}/documents.parquet").schema).parquet(f"{sf}/documents.parquet*")
    made = catalog._short(stream.chunk_stream(source.select("doc_id", "text")))
    made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{at}/out")


@query(catalog._SQL["vocabulary_df"])
def streamed_vocabulary(spark, sf):
    """All documents as a stream of several batches, each document twice: what repeats is dropped, the frequencies are those of the table."""
    at = folder(spark)
    d = docs(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000))
    d.unionByName(d).repartition(8).write.parquet(f"{at}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{at}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{at}/in")
    # no document is late here: their times spread over less than this
    fresh = stream.once(source, "36500 days", "ts")
    q = fresh.writeStream.foreachBatch(stream.keep_vocabulary(f"{at}/counts", 3)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.vocabulary(spark, f"{at}/counts").withColumn("idf", F.round("idf", 6))


# --- results of a run ---------------------------------------------------------------------------
#: The methods of the run, one of which cannot work, and one that is only planned.
RUN_METHODS, PLANNED = ("fixed_256", "fixed_512", "late_fixed_256"), "pic_paper_reimplementation"
_runs: dict[tuple[str, str], str] = {}


def _language(spark, c) -> raw.Bundle:
    """Documents of a language, without those that have no token: no method makes a chunk of these, and the contract refuses them."""
    own = (F.coalesce("lang", F.lit("none")) == c["lang"]) & F.col("text").rlike(f"[^{T.SPACE}]")
    d = spark.read.parquet(c["path"]).where(own).select(F.col("doc_id").cast("string").alias("document_id"), "text")
    # the optimiser sees that these are empty, so no text is shuffled to meet them
    empty = lambda schema: spark.createDataFrame([], schema).where(F.lit(False))
    return raw.Bundle(d, empty("query_id string, text string, relevant_document_ids array<string>, unanswerable boolean"), empty("query_id string, evidence_id string, document_id string, text string, token_count int, start int, end int, reason string"))


def results(spark, sf) -> DataFrame:
    """dataset, method, status, total_chunks: the table that the runner wrote about the documents of every language by every method."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _runs:
        at = folder(spark)
        langs = [r[0] for r in read(spark, sf, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang")).distinct().orderBy("lang").collect()]  # the run's configuration
        for lang in langs:
            if f"documents_{lang}" not in matrix.DATASETS.names():
                matrix.DATASETS.add(f"documents_{lang}", _language)
        methods = [{"name": "fixed_256"}, {"name": "fixed_512"}, {"name": "late_fixed_256", "overlap": 256}]
        sets = [{"name": f"documents_{lang}", "lang": lang, "path": f"{sf}/documents.parquet", "validation": {"minimum_mapping_rate": 0.0, "fail_on_mapping_error": False}} for lang in langs]
        out = matrix.run(spark, matrix.Experiment("languages", sets, methods, at, execution={"only": "chunks"}))
        # a method that refuses its configuration is a result of the run; anything else that failed says nothing about it
        if broken := [f"{x['dataset']}, {x['method']}: {x['error']}" for x in out["failed"] if not x["error"].startswith("ValueError: ")]:
            raise validation.RunError("; ".join(broken))
        _runs[key] = f"{at}/languages"
    return tables.read_result(spark, f"{_runs[key]}/chunk_statistics.csv").select("dataset", "method", "status", F.col("total_chunks").cast("long").alias("total_chunks"))


RESULTS = f"""t AS (SELECT 'documents_' || coalesce(lang, 'none') AS dataset, len(regexp_extract_all(text, '{T.PIECE}')) AS n FROM documents),
    r AS (SELECT dataset, 'fixed_' || size AS method, 'completed' AS status, sum((n + size - 1) // size)::bigint AS total_chunks FROM t, (VALUES (256), (512)) AS s(size) GROUP BY ALL UNION ALL SELECT DISTINCT dataset, 'late_fixed_256', 'failed', NULL FROM t)"""


@query(f"WITH {RESULTS} SELECT * FROM r UNION ALL SELECT DISTINCT dataset, '{PLANNED}', 'not_run', NULL FROM t")
def matrix_not_run(spark, sf):
    """The written results, and the planned pairs that have none."""
    r = results(spark, sf)
    expected = r.select("dataset").distinct().crossJoin(F.broadcast(spark.createDataFrame([(m,) for m in (*RUN_METHODS, PLANNED)], "method string")))  # the configured methods
    missing = expected.join(r, ["dataset", "method"], "left_anti")
    return r.unionByName(missing.select("dataset", "method", F.lit("not_run").alias("status"), F.lit(None).cast("long").alias("total_chunks")))


STATUS = ", ".join(f"max(status) FILTER (method = '{m}') AS {m}" for m in RUN_METHODS)


@query(f"WITH {RESULTS} SELECT dataset, {STATUS} FROM r GROUP BY dataset")
def pivot_status(spark, sf):
    return results(spark, sf).groupBy("dataset").pivot("method", list(RUN_METHODS)).agg(F.first("status"))


@query(f"WITH {RESULTS} SELECT method, count(DISTINCT dataset)::bigint AS datasets, round(avg(total_chunks), 6) AS mean_chunks, row_number() OVER (ORDER BY avg(total_chunks) DESC, method)::int AS place FROM r WHERE status = 'completed' GROUP BY method HAVING count(DISTINCT dataset) = (SELECT count(DISTINCT dataset) FROM r)")
def method_ranking(spark, sf):
    """Methods that ended on every data set, by their mean."""
    return evaluation.rank_methods(results(spark, sf), "total_chunks").select("method", "datasets", F.col("mean").alias("mean_chunks"), "place")
