"""Readers of raw question-answering corpora in four public formats.

Each gives a ``Bundle``: documents (document_id, text, title), queries (query_id, text,
relevant_document_ids, unanswerable) and evidence (query_id, evidence_id, document_id, text,
token_count, start, end, reason). Offsets count code points, end exclusive; ``reason`` says why a text
could not be located (start and end are null then). Broken references raise ``ValueError``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..operators.validation import SourceError

EXAMPLES = 5
PAPERS = "MAP<STRING, STRUCT<title: STRING, abstract: ARRAY<STRING>, full_text: ARRAY<STRUCT<section_name: STRING, paragraphs: ARRAY<STRING>>>, qas: ARRAY<STRUCT<question_id: STRING, question: STRING, answers: ARRAY<STRUCT<answer: STRUCT<unanswerable: BOOLEAN, evidence: ARRAY<STRING>>>>>>>>"
QUESTIONS = "_id STRING, question STRING, answer STRING, supporting_facts ARRAY<ARRAY<STRING>>, context ARRAY<ARRAY<STRING>>"
ARTICLES = "title STRING, text ARRAY<STRING>"
SPANS = "data ARRAY<STRUCT<title: STRING, paragraphs: ARRAY<STRUCT<context: STRING, qas: ARRAY<STRUCT<id: STRING, question: STRING, answers: ARRAY<STRUCT<text: STRING, answer_start: INT>>>>>>>>"
#: A run of . ! ? before white space ends a sentence, but for runs of several that begin with a dot.
SENTENCE = r"(?sU)(?=\S).*?(?:(?<![.!?])(?:\.|[!?][.!?]*)(?=\s|\z)|(?=\s*\z))"


@dataclass(frozen=True)
class Bundle:
    documents: DataFrame
    queries: DataFrame
    evidence: DataFrame
    metadata: dict = field(default_factory=dict)


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).replace("_", " ").split()))


@F.pandas_udf(StringType())
def folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def _slug(key: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(key, r"[^\p{L}\p{N}_]+", "-"), "^-+|-+$", "")


def _refuse(bad: DataFrame, what: str) -> None:
    """Raise with up to ``EXAMPLES`` rows of ``bad`` if it has any."""
    rows = bad.limit(EXAMPLES).collect()
    if rows:
        raise SourceError(f"{what}: {[tuple(r) for r in rows]}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def _parts(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is a folder of part files that a job wrote to its end."""
    return _exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def split_file(spark: SparkSession, path: str, split: str) -> str:
    """``path`` itself if it is a file, else the split's file in that folder."""
    names = [split] + (["dev", "validation"] if split == "validation" else [])
    for tried in [path, *(f"{path.rstrip('/')}/{n}.json" for n in names)]:
        if _exists(spark, tried):
            return tried
    raise FileNotFoundError(f"no file of split {split!r} in {path}")


def _ids(rows: DataFrame, key: str) -> Column:
    return F.concat_ws(":e", key, F.col("nth").cast("string"))


def _located(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", _ids(rows, "query_id").alias("evidence_id"), "document_id", "text", T.token_count(F.col("text")).alias("token_count"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "reason")


def paper_parts(papers: DataFrame) -> DataFrame:
    """Adds text and parts (section, idx, start, end) of a paper: abstract, then sections; blank paragraphs are left out."""
    said = papers.withColumn("said", F.expr("filter(concat(transform(coalesce(p.abstract, array()), (t, i) -> struct('Abstract' AS section, i AS idx, t AS t)), flatten(transform(coalesce(p.full_text, array()), s -> transform(coalesce(s.paragraphs, array()), (t, i) -> struct(coalesce(s.section_name, '') AS section, i AS idx, t AS t))))), x -> x.t RLIKE '\\\\S')"))
    size = "transform(said, x -> length(x.t) + 2)"
    begins = f"transform(said, (x, i) -> aggregate(slice({size}, 1, i), 0, (s, n) -> s + n))"
    return said.withColumn("text", F.expr("array_join(transform(said, x -> x.t), '\n\n')")).withColumn("parts", F.expr(f"zip_with(said, {begins}, (x, b) -> struct(x.section AS section, x.idx AS idx, b AS start, b + length(x.t) AS end))")).drop("said")


def papers(spark: SparkSession, path: str, split: str = "validation", unanswerable: str = "exclude") -> Bundle:
    """Papers keyed by id, with questions and annotated evidence paragraphs (QASPER). A folder that is no split's may
    hold several such objects, each a file, which are read side by side."""
    if unanswerable not in ("include", "exclude", "mark"):
        raise ValueError(f"unanswerable is include, exclude or mark, not {unanswerable!r}")
    try:
        path = split_file(spark, path, split)
    except FileNotFoundError:
        if not _parts(spark, path):
            raise
    whole = spark.read.text(path, wholetext=True).where("value != ''").select(F.from_json("value", PAPERS).alias("m"))
    if not whole.where("m IS NULL").isEmpty():
        raise ValueError(f"{path}: an object keyed by paper is asked for")
    return paper_bundle(whole.select(F.explode("m").alias("id", "p")), split, unanswerable)


def paper_bundle(table: DataFrame, split: str = "validation", unanswerable: str = "exclude") -> Bundle:
    """The bundle of papers (id, p), a row each."""
    docs = paper_parts(table.select("id", "p").withColumn("document_id", F.concat(F.lit("qasper:"), "id")))
    asked = docs.select("document_id", F.col("text").alias("body"), "parts", F.explode("p.qas").alias("q"))
    asked = asked.withColumn("unanswerable", F.expr("coalesce(size(q.answers) > 0 AND forall(q.answers, a -> coalesce(a.answer.unanswerable, false)), false)"))
    kept = asked.where("NOT unanswerable") if unanswerable == "exclude" else asked
    texts = F.expr("array_distinct(filter(flatten(transform(coalesce(q.answers, array()), a -> coalesce(a.answer.evidence, array()))), t -> t RLIKE '\\\\S'))")
    found = kept.select(F.col("q.question_id").alias("query_id"), "document_id", "body", "parts", F.posexplode(texts).alias("nth", "text")).withColumn("at", F.expr("instr(body, text) - 1"))
    found = found.withColumn("start", F.expr("if(at >= 0, at, null)")).withColumn("end", F.expr("start + length(text)")).withColumn("reason", F.expr("if(at < 0, 'not found verbatim', null)"))
    part = found.withColumn("part", F.expr("get(filter(parts, l -> l.start <= start AND end <= l.end), 0)"))
    queries = kept.select(F.col("q.question_id").alias("query_id"), F.col("q.question").alias("text"), F.array("document_id").alias("relevant_document_ids"), "unanswerable")
    left_out = asked.where("unanswerable").count() if unanswerable == "exclude" else 0
    evidence = part.select("query_id", _ids(part, "query_id").alias("evidence_id"), "document_id", "text", T.token_count(F.col("text")).alias("token_count"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "reason", F.col("part.section").alias("section"), F.col("part.idx").alias("paragraph"))
    return Bundle(docs.select("document_id", "text", F.col("p.title").alias("title")), queries, evidence, {"dataset_name": "qasper", "split": split, "language": "en", "excluded_unanswerable_count": left_out})


def articles(spark: SparkSession, path: str) -> DataFrame:
    """(title, text, place) of .json (one value or a list), .jsonl and .bz2 files at or below ``path``."""
    read = spark.read.schema(ARTICLES).option("recursiveFileLookup", True)
    both = [read.option("pathGlobFilter", "*.json").option("multiLine", True).json(path), read.option("pathGlobFilter", "*.{jsonl,bz2}").option("multiLine", False).json(path)]
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    one, two = (d.select("title", "text", place.alias("place")) for d in both)
    return one.unionByName(two)


def joined_sentences(rows: DataFrame, sentences: Column) -> DataFrame:
    """Adds sentences, text (joined by one space) and begins (offset of each)."""
    rows = rows.withColumn("sentences", sentences)
    return rows.withColumn("text", F.array_join("sentences", " ")).withColumn("begins", F.expr("transform(sentences, (x, i) -> aggregate(slice(sentences, 1, i), 0, (s, y) -> s + length(y) + 1))"))


#: Paragraphs are lists of sentences or plain texts; lists arrive as JSON text.
FLAT = "flatten(transform(text, x -> coalesce(if(x LIKE '[%', from_json(x, 'array<string>'), null), array(x))))"


def _facts(questions: DataFrame, key) -> DataFrame:
    rows = questions.select(F.col("_id").alias("query_id"), F.posexplode("supporting_facts").alias("nth", "fact"))
    return rows.select("query_id", "nth", key(F.col("fact")[0]).alias("key"), F.col("fact")[1].cast("int").alias("idx"))


def _from_facts(questions: DataFrame, facts: DataFrame, docs: DataFrame, name: str, split: str, language: str) -> Bundle:
    """Queries and evidence of supporting facts (query_id, nth, key, idx) over docs (key, document_id, sentences, begins)."""
    hit = facts.join(docs.select("key", "document_id", "sentences", "begins"), "key")
    _refuse(hit.where("idx IS NULL OR idx < 0 OR idx >= size(sentences)").select("query_id", "key", "idx"), "supporting fact out of range")
    hit = hit.withColumn("text", F.expr("get(sentences, idx)")).withColumn("start", F.expr("get(begins, idx)")).withColumn("end", F.expr("start + length(text)")).withColumn("reason", F.lit(None).cast("string"))
    relevant = hit.groupBy("query_id").agg(F.expr("array_distinct(transform(array_sort(collect_list(struct(nth, document_id))), x -> x.document_id))").alias("relevant_document_ids"))
    queries = questions.select(F.col("_id").alias("query_id"), F.col("question").alias("text"), "answer").join(relevant, "query_id", "left")
    queries = queries.select("query_id", "text", F.coalesce("relevant_document_ids", F.expr("cast(array() AS array<string>)")).alias("relevant_document_ids"), F.lit(False).alias("unanswerable"), "answer", F.expr("coalesce(size(relevant_document_ids) > 1, false)").alias("multi_hop"))
    return Bundle(docs.select("document_id", "text", "title"), queries, _located(hit), {"dataset_name": name, "split": split, "language": language})


def multi_hop(spark: SparkSession, questions_path: str, corpus_path: str, split: str = "validation") -> Bundle:
    """Questions with supporting facts over a separate article corpus (HotpotQA full wiki). Titles keep their case."""
    from .tables import settled  # which reads this module

    questions = spark.read.schema(QUESTIONS).option("multiLine", True).json(questions_path)
    _refuse(questions.where("supporting_facts IS NULL").select("_id"), "queries without supporting facts")
    facts = _facts(questions, nfc)
    wanted = facts.select("key").distinct()
    w = W.partitionBy("key").orderBy("place")
    # the corpus is read once; the articles asked for are written, as checks and evidence read them again
    found = settled(articles(spark, corpus_path).withColumn("key", nfc("title")).join(wanted, "key", "left_semi").withColumn("r", F.row_number().over(w)).where("r = 1").select("key", "title", "text"))
    _refuse(wanted.join(found, "key", "left_anti"), "articles missing from the corpus")
    docs = joined_sentences(found, F.expr(FLAT)).withColumn("document_id", F.concat(F.lit("hotpotqa:"), _slug(F.col("key"))))
    return _from_facts(questions, facts, docs, "hotpotqa_fullwiki", split, "en")


def multi_hop_contexts(spark: SparkSession, path: str, split: str = "validation") -> Bundle:
    """Questions that carry their articles (ViMQA). Titles match whatever their case; one title with two contents is refused."""
    questions = spark.read.schema(QUESTIONS).option("multiLine", True).json(split_file(spark, path, split)).withColumn("row", F.monotonically_increasing_id())
    _refuse(questions.where("_id IS NULL OR question IS NULL OR context IS NULL OR supporting_facts IS NULL").select("_id"), "rows without a required field")
    seen = questions.select("row", F.posexplode("context").alias("at", "c")).select(F.struct("row", "at").alias("place"), F.col("c")[0].alias("title"), F.col("c")[1].alias("said"))
    _refuse(seen.groupBy("title").agg(F.count_distinct("said").alias("n")).where("n > 1").select("title"), "titles with several contents")
    one = seen.groupBy("title").agg(F.min("place").alias("place"), F.first("said").alias("said")).withColumn("key", folded(nfc("title")))
    one = one.withColumn("r", F.row_number().over(W.partitionBy("key").orderBy(F.desc("place")))).where("r = 1")
    docs = joined_sentences(one, F.expr("from_json(said, 'array<string>')")).withColumn("document_id", F.concat(F.lit("vimqa:"), _slug(F.col("key"))))
    facts = _facts(questions, lambda c: folded(nfc(c)))
    _refuse(facts.join(docs, "key", "left_anti").select("query_id", "key"), "facts on unknown titles")
    return _from_facts(questions, facts, docs, "vimqa", split, "vi")


def sentence_spans(text: str) -> Column:
    """Array of (start, end) of the sentences of column ``text``."""
    parts = f"regexp_extract_all({text}, r'{SENTENCE}', 0)"
    fold = "aggregate(parts, struct(1 AS at, cast(array() AS array<struct<start:int,end:int>>) AS out), (a, s) -> struct(locate(s, body, a.at) + length(s) AS at, concat(a.out, array(struct(locate(s, body, a.at) - 1 AS start, locate(s, body, a.at) - 1 + length(s) AS end))) AS out)).out"
    return F.expr(fold.replace("parts", parts).replace("body", text))


def answer_spans(spark: SparkSession, path: str, split: str = "validation") -> Bundle:
    """Paragraphs with answer offsets (UIT-ViQuAD): evidence is the least run of sentences that covers an answer.

    An answer that does not stand at its offset but one further on is moved there."""
    root = spark.read.schema(SPANS).option("multiLine", True).json(split_file(spark, path, split))
    arts = root.select(F.posexplode("data").alias("a", "article")).select("a", "article.title", F.posexplode("article.paragraphs").alias("p", "para"))
    docs = arts.select(F.format_string("uit_viquad:%d:%d", "a", "p").alias("document_id"), F.col("para.context").alias("text"), "title", "para.qas")
    return span_bundle(docs.drop("qas"), docs.select("document_id", F.col("text").alias("body"), F.explode("qas").alias("q")), split)


def span_bundle(docs: DataFrame, asked: DataFrame, split: str = "validation") -> Bundle:
    """The bundle of paragraphs (document_id, text, title) and their questions (document_id, body, q{id, question, answers})."""
    queries = asked.select(F.col("q.id").alias("query_id"), F.col("q.question").alias("text"), F.array("document_id").alias("relevant_document_ids"), F.expr("coalesce(size(q.answers), 0) <= 0").alias("unanswerable"))
    rows = asked.where("size(q.answers) > 0").withColumn("spans", sentence_spans("body")).select(F.col("q.id").alias("query_id"), "document_id", "body", "spans", F.explode("q.answers").alias("x"))
    rows = rows.withColumn("from", F.expr("CASE WHEN substring(body, x.answer_start + 1, length(x.text)) = x.text THEN x.answer_start WHEN substring(body, x.answer_start + 2, length(x.text)) = x.text THEN x.answer_start + 1 END"))
    _refuse(rows.where("from IS NULL").select("query_id", "x"), "answers that do not stand at their offset")
    rows = rows.withColumn("cover", F.expr("filter(spans, s -> s.start < from + length(x.text) AND from < s.end)"))
    _refuse(rows.where("size(cover) = 0").select("query_id", "x"), "answers outside all sentences")
    spans = rows.select("query_id", "document_id", "body", F.expr("cover[0].start").alias("start"), F.expr("element_at(cover, -1).end").alias("end"), F.size("cover").alias("sentence_count")).distinct()
    hit = spans.withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("start", "end")) - 1)
    hit = hit.withColumn("text", F.expr("substring(body, start + 1, end - start)")).withColumn("reason", F.lit(None).cast("string"))
    return Bundle(docs, queries, _located(hit), {"dataset_name": "uit_viquad", "split": split, "language": "vi"})


def synthetic(spark: SparkSession, split: str = "test") -> Bundle:
    """Three documents, two queries, two evidence phrases of our own wording."""
    said = [("doc_alpha", "The alpha team measures heat pumps. They save one third of the power. Tests took a winter."), ("doc_beta", "The beta team counts river fish. Salmon came back after the weir was opened."), ("doc_gamma", "Gamma is about choirs and organs.")]
    docs = spark.createDataFrame([(i, t, None) for i, t in said], "document_id STRING, text STRING, title STRING")
    queries = spark.createDataFrame([("q1", "How much power do heat pumps save?", ["doc_alpha"], False), ("q2", "What came back to the river?", ["doc_beta"], False)], "query_id STRING, text STRING, relevant_document_ids ARRAY<STRING>, unanswerable BOOLEAN")
    phrases = [("q1", 0, "doc_alpha", "one third of the power"), ("q2", 0, "doc_beta", "Salmon came back after the weir was opened.")]
    ev = spark.createDataFrame(phrases, "query_id STRING, nth INT, document_id STRING, text STRING").join(docs.select("document_id", F.col("text").alias("body")), "document_id")
    ev = ev.withColumn("start", F.expr("instr(body, text) - 1")).withColumn("end", F.expr("start + length(text)")).withColumn("reason", F.lit(None).cast("string"))
    return Bundle(docs, queries, _located(ev), {"dataset_name": "synthetic", "split": split, "language": "en"})
