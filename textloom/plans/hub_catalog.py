"""Queries of the hub converters: tables in the hubs' nested form are made from all documents, with faults planted, and converted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import convert, raw
from .catalog import query, read

# --- questions with distractors: four documents share a title, spelled in two ways; every question has a title of its own too ---
DISTRACTED = """r AS (SELECT doc_id, doc_id // 4 AS g, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    ctx AS (SELECT doc_id, 0 AS nth, CASE WHEN doc_id % 2 = 0 THEN 'Art_' || g ELSE ' Art  ' || g END AS title, lines AS said FROM r UNION ALL SELECT doc_id, 1, 'Own ' || doc_id, lines[1:1] FROM r),
    keyed AS (SELECT *, regexp_replace(trim(replace(nfc_normalize(title), '_', ' ')), ' +', ' ', 'g') AS key FROM ctx),
    fact AS (SELECT doc_id, 0 AS nth, 'Own_' || doc_id AS title, CASE WHEN doc_id % 8 = 6 THEN 999999 ELSE 0 END AS idx FROM r UNION ALL SELECT doc_id, 1, 'Art ' || g, 0 FROM r WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 1, 'Nowhere', 0 FROM r WHERE doc_id % 8 = 2),
    placed AS (SELECT f.*, k.key, k.said[idx + 1] AS gold, CASE WHEN k.key IS NULL THEN 'supporting title absent: ' || f.title WHEN idx >= len(k.said) THEN 'supporting sentence out of range: ' || f.title || ' / ' || idx END AS wrong FROM fact f LEFT JOIN keyed k ON k.doc_id = f.doc_id AND k.key = replace(f.title, '_', ' ')),
    judged AS (SELECT doc_id, count(*) AS n, min(nth) FILTER (wrong IS NOT NULL) AS bad, arg_min(wrong, nth) FILTER (wrong IS NOT NULL) AS reason FROM placed GROUP BY 1),
    needs AS (SELECT DISTINCT key, idx, gold FROM placed JOIN judged USING (doc_id) WHERE bad IS NULL OR nth < bad),
    variant AS (SELECT key, said, arg_max(title, doc_id * 2 + nth) AS title FROM keyed GROUP BY key, said),
    fits AS (SELECT v.*, (SELECT count(*) FROM needs n WHERE n.key = v.key AND v.said[n.idx + 1] IS DISTINCT FROM n.gold) AS missing FROM variant v)"""


def _distracted(spark, sf) -> DataFrame:
    r = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("g"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    even = F.col("doc_id") % 2 == 0
    shared = F.when(even, F.concat(F.lit("Art_"), "g")).otherwise(F.concat(F.lit(" Art  "), "g"))
    titles = F.array(shared, F.concat(F.lit("Own "), "doc_id"))
    more = F.when(F.col("doc_id") % 4 == 1, F.array(F.concat(F.lit("Art "), "g"))).when(F.col("doc_id") % 8 == 2, F.array(F.lit("Nowhere"))).otherwise(F.array().cast("array<string>"))
    facts = F.concat(F.array(F.concat(F.lit("Own_"), "doc_id")), more)
    at = F.concat(F.array(F.when(F.col("doc_id") % 8 == 6, 999999).otherwise(0)), F.transform(more, lambda _: F.lit(0)))
    return r.select("doc_id", F.col("doc_id").alias("id"), F.lit("?").alias("question"), F.lit("!").alias("answer"), F.struct(titles.alias("title"), F.array("lines", F.slice("lines", 1, 1)).alias("sentences")).alias("context"), F.struct(facts.alias("title"), at.alias("sent_id")).alias("supporting_facts"))


@query(f"""WITH {DISTRACTED} SELECT key, arg_max(title, pick) AS title, max(n_variants)::bigint AS variants, len(arg_max(said, pick))::int AS sentences, md5(array_to_string(arg_max(said, pick), chr(10))) AS text_md5
    FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n_variants, row(len(said), length(array_to_string(said, '')), '{{"text": [[' || array_to_string(list_transform(said, lambda x: to_json(x)::varchar), ', ') || ']], "title": ' || to_json(title)::varchar || '}}') AS pick FROM fits) WHERE missing = 0 GROUP BY key""")
def distractor_articles(spark, sf):
    """One article per title, in the variant that holds the gold sentences."""
    a = convert.distractors(_distracted(spark, sf), "doc_id").articles
    return a.select("key", "title", "variants", F.size(F.col("text")[0]).alias("sentences"), F.md5(F.array_join(F.col("text")[0], "\n")).alias("text_md5"))


@query(f"WITH {DISTRACTED} SELECT doc_id::varchar AS query_id, CASE WHEN bad IS NULL THEN n END::bigint AS facts, reason FROM judged")
def distractor_questions(spark, sf):
    """All questions: those that stay with the number of their facts, the others with the reason."""
    d = convert.distractors(_distracted(spark, sf), "doc_id")
    kept = d.questions.select(F.col("_id").alias("query_id"), F.size("supporting_facts").cast("long").alias("facts"), F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(d.excluded.select("query_id", F.lit(None).cast("long").alias("facts"), "reason"))


# --- papers: a document's first line is the abstract, each has a caption and five questions, one without supported evidence ---
PAPER = "p AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, 'cap ' || doc_id AS cap FROM documents), b AS (SELECT *, array_to_string(lines, chr(10) || chr(10)) || chr(10) || chr(10) || 'FLOAT SELECTED: ' || cap AS body FROM p)"


def _papers(spark, sf) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    cap = F.concat(F.lit("cap "), "doc_id")
    mark = lambda unanswerable, *evidence: F.struct(F.lit(unanswerable).alias("unanswerable"), F.array(*evidence).cast("array<string>").alias("evidence"))
    asked = {
        "abstract": F.array(mark(False, lines[0], F.lit("~ no such line ~"))),
        "nowhere": F.array(mark(False, F.lit("~ nowhere ~"))),
        "open": F.array(mark(True), mark(False, F.lit("~ nowhere ~"))),
        "caption": F.array(mark(False, F.concat(F.lit("FLOAT SELECTED: "), cap))),
        "last": F.array(mark(False, F.element_at(lines, -1)), mark(True)),
    }
    qas = F.struct(F.array(*(F.concat("doc_id", F.lit(f"-{k}")) for k in asked)).alias("question_id"), F.array(*map(F.lit, asked)).alias("question"), F.struct(F.array(*asked.values()).alias("answer")).alias("answers"))
    sections = F.struct(F.array(F.lit("Body"), F.lit("Rest")).alias("section_name"), F.array(F.slice(lines, 2, F.size(lines)), F.array().cast("array<string>")).alias("paragraphs"))
    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), lines[0].alias("abstract"), sections.alias("full_text"), F.struct(F.array(cap, F.lit(" ")).alias("caption")).alias("figures_and_tables"), qas.alias("qas"))


@query(f"WITH {PAPER} SELECT 'qasper:' || doc_id AS document_id, 3 AS sections, 4 AS questions, 1 AS excluded_questions, 3 AS excluded_evidence, 5::bigint AS annotations FROM b")
def hub_papers(spark, sf):
    """Of five questions a paper the one without supported evidence goes."""
    p = convert.papers(_papers(spark, sf))
    return p.select(F.concat(F.lit("qasper:"), "id").alias("document_id"), F.size("p.full_text").alias("sections"), F.size("p.qas").alias("questions"), "excluded_questions", "excluded_evidence", F.aggregate("p.qas", F.lit(0), lambda n, q: n + F.size(q["answers"])).cast("long").alias("annotations"))


@query(f"""WITH {PAPER}, shown AS (SELECT doc_id, array_to_string(list_filter(list_concat(lines, ['FLOAT SELECTED: ' || cap]), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f\\v]')), chr(10) || chr(10)) AS seen, lines[1] AS first, lines[len(lines)] AS last, 'FLOAT SELECTED: ' || cap AS cap FROM b),
    e AS (SELECT doc_id, doc_id || '-abstract' AS q, first AS t, seen FROM shown UNION ALL SELECT doc_id, doc_id || '-caption', cap, seen FROM shown)
    SELECT q || ':e0' AS evidence_id, 'qasper:' || doc_id AS document_id, (strpos(seen, t) - 1)::int AS start, (strpos(seen, t) - 1 + length(t))::int AS "end" FROM e WHERE regexp_matches(t, '[^ \\t\\n\\r\\f\\v]')""")
def hub_paper_evidence(spark, sf):
    """The evidence of converted papers as the reader of papers places it, without a file in between; questions that an annotator found open are left out."""
    e = raw.paper_bundle(convert.papers(_papers(spark, sf)).select("id", "p")).evidence
    return e.where("query_id LIKE '%-abstract' OR query_id LIKE '%-caption'").select("evidence_id", "document_id", "start", "end")


# --- questions on paragraphs: a question a document, its answer the text's first word; some impossible, some blank ---
@query("""WITH r AS (SELECT doc_id, coalesce(source, '') AS title, text, regexp_extract(text, '[!-~]+') AS word FROM documents WHERE text IS NOT NULL AND doc_id % 5 <> 0 AND doc_id % 7 <> 0)
    SELECT 'uit_viquad:' || left(sha256(title || chr(0) || text), 16) AS document_id, title, count(*)::bigint AS questions, min(doc_id) AS first_question, sum(strpos(text, word) - 1)::bigint AS starts FROM r WHERE word <> '' GROUP BY title, text""")
def hub_paragraphs(spark, sf):
    """Questions on the same paragraph of one title meet in one document."""
    d = read(spark, sf, "documents").where("text IS NOT NULL").withColumn("word", F.regexp_extract("text", "[!-~]+", 0))
    # after the answer a blank one, and for every seventh document only that
    texts = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(" "))).otherwise(F.array("word", F.lit("\n")))
    answers = F.struct(texts.alias("text"), F.transform(texts, lambda t: F.instr("text", F.col("word")) - 1).alias("answer_start"))
    rows = d.select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("context"), F.lit("?").alias("question"), answers.alias("answers"), (F.col("doc_id") % 5 == 0).alias("is_impossible"))
    documents, asked = convert.paragraphs(rows)
    counted = asked.groupBy("document_id").agg(F.count("*").alias("questions"), F.min(F.col("q.id").cast("long")).alias("first_question"), F.sum(F.aggregate("q.answers", F.lit(0), lambda n, a: n + a["answer_start"])).alias("starts"))
    return documents.join(counted, "document_id").select("document_id", "title", "questions", "first_question", "starts")
