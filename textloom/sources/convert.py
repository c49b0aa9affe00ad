"""Hub tables of three public corpora to what the readers of ``raw`` take: a row per question or paper in, normalised tables out.

A hub table nests what belongs together in parallel arrays; here they are zipped, checked and cut loose
from each other. All work is joins and groupings by content; nothing is gathered over a whole corpus. A rule
that only a broken table breaks is asserted inside the plan, so it is raised by the job that reads the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import raw

#: Names that the converted papers carry.
FIGURES, CAPTION = "Figures and Tables", "FLOAT SELECTED: "


def asserted(rule: Column, said: Column | str) -> Column:
    """True where ``rule`` holds; raises with ``said`` where it is false or null."""
    return F.when(rule, F.lit(True)).otherwise(F.raise_error(F.lit(said) if isinstance(said, str) else said).cast("boolean"))


def quoted(text: Column) -> Column:
    """A text as JSON writes it."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


# --- questions with distractors ------------------------------------------------------------------
@dataclass(frozen=True)
class Distractors:
    """questions (_id, question, answer, supporting_facts) and articles (title, text) in the form that ``raw.multi_hop``
    reads, articles with key and variants besides; excluded (query_id, reason)."""

    questions: DataFrame
    articles: DataFrame
    excluded: DataFrame

    def provenance(self) -> DataFrame:
        """One row of counts."""
        kept = self.questions.agg(F.count("*").alias("query_count"), F.coalesce(F.sum(F.size("supporting_facts")), F.lit(0)).alias("supporting_fact_count"))
        made = self.articles.agg(F.count("*").alias("article_count"), F.count_if(F.col("variants") > 1).alias("conflicting_article_title_count"))
        return kept.crossJoin(made).crossJoin(self.excluded.agg(F.count("*").alias("excluded_invalid_query_count")))  # rows of one


def distractors(rows: DataFrame, order: str | None = None) -> Distractors:
    """Questions (id, question, answer, context{title, sentences}, supporting_facts{title, sent_id}) whose articles
    come with them: one article per title, in the variant that holds the gold sentences of all questions.

    Titles are one if they agree in NFC with spaces for underscores. A question is left out, with its reason, at its
    first fact on a title that its context lacks or on a sentence that the article lacks; its facts before that still
    bind the article. Of the variants that satisfy all gold sentences the one with most sentences, then most
    characters, then the greatest JSON text is taken; of equal texts the last title by ``order`` (the order of
    reading if there is none). Two texts for one gold sentence, a title that no variant satisfies, parallel arrays of
    different length and questions without facts are refused."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    base = rows.select(at.alias("at"), F.col("id").cast("string").alias("id"), "question", "answer", F.col("context.title").alias("titles"), F.col("context.sentences").alias("said"), F.col("supporting_facts.title").alias("fact_titles"), F.col("supporting_facts.sent_id").alias("fact_at"))
    base = base.where(asserted(F.size("titles") == F.size("said"), F.concat(F.lit("titles and sentences differ in number: "), F.col("id"))))
    base = base.where(asserted((F.size("fact_titles") == F.size("fact_at")) & (F.size("fact_titles") > 0), F.concat(F.lit("no facts, or titles and sentences of facts differ in number: "), F.col("id"))))
    # the articles of a question; of one title twice the last counts for its facts
    seen = base.select("at", "id", F.posexplode(F.arrays_zip("titles", "said")).alias("nth", "a")).select("at", "id", "nth", F.col("a.titles").alias("title"), raw.nfc("a.titles").alias("key"), F.col("a.said").alias("sentences"))
    own = seen.groupBy("id", "at", "key").agg(F.max_by("sentences", "nth").alias("sentences"))
    facts = base.select("at", "id", F.posexplode(F.arrays_zip("fact_titles", "fact_at")).alias("nth", "f")).select("at", "id", "nth", F.col("f.fact_titles").alias("title"), raw.nfc("f.fact_titles").alias("key"), F.col("f.fact_at").cast("int").alias("idx"))
    placed = facts.join(own, ["at", "id", "key"], "left")
    wrong = F.when(F.col("sentences").isNull(), F.concat(F.lit("supporting title absent: "), "title")).when((F.col("idx") < 0) | (F.col("idx") >= F.size("sentences")), F.concat(F.lit("supporting sentence out of range: "), "title", F.lit(" / "), F.col("idx").cast("string")))
    placed = placed.withColumn("wrong", wrong).withColumn("gold", F.get("sentences", "idx"))
    # a question's facts: as many as it names
    judged = placed.groupBy("at", "id").agg(F.min(F.when(F.col("wrong").isNotNull(), F.struct("nth", "wrong"))).alias("first"), F.sort_array(F.collect_list(F.struct("nth", "title", "idx", "key", "gold"))).alias("facts"))
    binding = F.filter("facts", lambda f: F.col("first").isNull() | (f["nth"] < F.col("first.nth")))
    needs = judged.select(F.explode(binding).alias("f")).select("f.key", "f.idx", "f.gold").groupBy("key", "idx").agg(F.min("gold").alias("gold"), F.max("gold").alias("other"))
    needs = needs.where(asserted(F.col("gold") == F.col("other"), F.concat(F.lit("two texts for one gold sentence: "), F.col("key"), F.lit(" / "), F.col("idx").cast("string"))))
    needs = needs.groupBy("key").agg(F.collect_list(F.struct("idx", "gold")).alias("needs"))  # one per sentence of an article
    variants = seen.groupBy("key", "sentences").agg(F.max_by("title", F.struct("at", "nth")).alias("title"))
    holds = F.forall("needs", lambda n: F.coalesce(F.get("sentences", n["idx"]) == n["gold"], F.lit(False)))
    text = F.concat(F.lit('{"text": [['), F.array_join(F.transform("sentences", quoted), ", "), F.lit(']], "title": '), quoted(F.col("title")), F.lit("}"))
    size = F.aggregate("sentences", F.lit(0).cast("long"), lambda n, s: n + F.length(s))
    ranked = variants.join(needs, "key", "left").withColumn("good", F.coalesce(holds, F.lit(True)))
    best = ranked.groupBy("key").agg(F.count("*").alias("variants"), F.max(F.when(F.col("good"), F.struct(F.size("sentences").alias("n"), size.alias("size"), text.alias("json"), "title", "sentences"))).alias("best"))
    best = best.where(asserted(F.col("best").isNotNull(), F.concat(F.lit("no variant satisfies all gold sentences: "), F.col("key"))))
    articles = best.select(F.col("best.title").alias("title"), F.array("best.sentences").alias("text"), "key", "variants")
    good = judged.where("first IS NULL").select("at", "id", F.transform("facts", lambda f: F.array(f["title"], f["idx"].cast("string"))).alias("supporting_facts"))
    questions = base.select("at", "id", "question", "answer").join(good, ["at", "id"]).select(F.col("id").alias("_id"), "question", "answer", "supporting_facts")
    return Distractors(questions, articles, judged.where("first IS NOT NULL").select(F.col("id").alias("query_id"), F.col("first.wrong").alias("reason")))


# --- papers --------------------------------------------------------------------------------------
def papers(rows: DataFrame) -> DataFrame:
    """Papers (id, title, abstract, full_text{section_name, paragraphs}, figures_and_tables{caption},
    qas{question_id, question, answers}) as ``raw.paper_bundle`` takes them: id, p; and excluded_questions, excluded_evidence.

    Captions become a section of their own. Of every annotation the evidence that stands verbatim in the paper is
    kept; a question stays if an annotation of it has such evidence or calls it unanswerable. ``answers`` is a list of
    {answer: list of annotations}, or one {answer: list of such lists}. Parallel arrays of different length are refused."""
    nested = rows.schema["qas"].dataType["answers"].dataType.typeName() == "array"
    lists = F.transform("qas.answers", lambda a: a["answer"]) if nested else F.col("qas.answers.answer")
    alike = (F.size("full_text.section_name") == F.size("full_text.paragraphs")) & (F.size("qas.question_id") == F.size("qas.question")) & (F.size("qas.question_id") == F.size(lists))
    given = rows.where(asserted(alike, F.concat(F.lit("parallel arrays differ in length: "), F.col("id"))))
    captions = F.filter(F.coalesce("figures_and_tables.caption", F.array().cast("array<string>")), lambda c: c.rlike(r"\S")) if "figures_and_tables" in rows.columns else F.array().cast("array<string>")
    own = F.zip_with("full_text.section_name", "full_text.paragraphs", lambda s, p: F.struct(s.alias("section_name"), p.alias("paragraphs")))
    figures = F.array(F.struct(F.lit(FIGURES).alias("section_name"), F.transform(captions, lambda c: F.concat(F.lit(CAPTION), c)).alias("paragraphs")))
    whole = given.withColumn("sections", F.when(F.size(captions) > 0, F.concat(own, figures)).otherwise(own)).withColumn("lists", lists)
    # every row's text is built once, though each annotation is looked up in it
    body = F.array_join(F.concat(F.array(F.coalesce("abstract", F.lit(""))), F.flatten(F.transform("sections", lambda s: s["paragraphs"]))), "\n\n")
    asked = whole.select("id", "title", "abstract", "sections", F.struct(body.alias("body")).alias("b"), F.arrays_zip(F.col("qas.question_id"), F.col("qas.question"), "lists").alias("asked"))
    evidence = lambda a: F.coalesce(a["evidence"], F.array().cast("array<string>"))
    found = lambda a: F.filter(evidence(a), lambda t: F.contains(F.col("b.body"), t))
    checked = F.transform("asked", lambda q: F.struct(q["question_id"].cast("string").alias("question_id"), q["question"].alias("question"), F.transform(F.coalesce(q["lists"], F.array().cast(f"array<{_annotation(rows, nested)}>")), lambda a: F.struct(F.coalesce(a["unanswerable"], F.lit(False)).alias("unanswerable"), found(a).alias("evidence"), F.size(evidence(a)).alias("given"))).alias("marks")))
    judged = asked.select("id", "title", "abstract", "sections", checked.alias("asked"))
    supported = lambda m: m["unanswerable"] | (F.size(m["evidence"]) > 0)
    answers = lambda q: F.transform(F.filter(q["marks"], supported), lambda m: F.struct(F.struct(m["unanswerable"].alias("unanswerable"), m["evidence"].alias("evidence")).alias("answer")))
    qas = F.transform(F.filter("asked", lambda q: F.exists(q["marks"], supported)), lambda q: F.struct(q["question_id"].alias("question_id"), q["question"].alias("question"), answers(q).alias("answers")))
    lost = F.aggregate(F.flatten(F.transform("asked", lambda q: q["marks"])), F.lit(0), lambda n, m: n + m["given"] - F.size(m["evidence"]))
    abstract = F.when(F.col("abstract") != "", F.array("abstract")).otherwise(F.array().cast("array<string>"))
    return judged.select(
        F.col("id").cast("string").alias("id"), F.struct("title", abstract.alias("abstract"), F.col("sections").alias("full_text"), qas.alias("qas")).alias("p"),
        (F.size("asked") - F.size(qas)).alias("excluded_questions"), lost.alias("excluded_evidence"),
    )


def _annotation(rows: DataFrame, nested: bool) -> str:
    kind = rows.schema["qas"].dataType["answers"].dataType
    kind = kind.elementType["answer"].dataType.elementType if nested else kind["answer"].dataType.elementType.elementType
    return kind.simpleString()


# --- questions on paragraphs ---------------------------------------------------------------------
def paragraphs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (id, title, context, question, answers{text, answer_start}, is_impossible) as ``raw.span_bundle`` takes
    them: documents (document_id, text, title), one for each title and context, and asked (document_id, body, q).

    A document is named by its content, so a paragraph that many questions share is gathered nowhere. Impossible
    questions and those whose answers are all blank are left out, blank answers of others too; arrays of different length are refused."""
    texts, starts = F.coalesce("answers.text", F.array().cast("array<string>")), F.coalesce("answers.answer_start", F.array().cast("array<int>"))
    given = rows.where(~F.coalesce("is_impossible", F.lit(False))).where(F.size(texts) > 0)
    given = given.where(asserted(F.size(texts) == F.size(starts), F.concat(F.lit("texts and starts of answers differ in number: "), F.col("id").cast("string"))))
    pairs = F.zip_with(texts, starts, lambda t, s: F.struct(t.alias("text"), s.cast("int").alias("answer_start")))
    said = F.filter(pairs, lambda a: a["text"].rlike(r"\S"))
    title = F.coalesce("title", F.lit(""))
    name = F.concat(F.lit("uit_viquad:"), F.left(F.sha2(F.concat(title, F.lit("\0"), "context"), 256), F.lit(16)))
    asked = given.where(F.size(said) > 0).select(name.alias("document_id"), title.alias("title"), F.col("context").alias("body"), F.struct(F.col("id").cast("string").alias("id"), "question", said.alias("answers")).alias("q"))
    documents = asked.select("document_id", F.col("body").alias("text"), "title").distinct()
    return documents, asked.drop("title")
