"""Hub tables: planted variants and faults, and the readers over what the converters make."""

import pytest
from pyspark.sql import functions as F

from textloom.sources import convert, raw

HOPS = "at int, id string, question string, answer string, context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>,sent_id:array<int>>"
PAPER = "id string, title string, abstract string, full_text struct<section_name:array<string>,paragraphs:array<array<string>>>, figures_and_tables struct<caption:array<string>>, qas struct<question_id:array<string>,question:array<string>,answers:{}>"
MARK = "array<struct<unanswerable:boolean,evidence:array<string>>>"
SPAN = "id string, title string, context string, question string, answers struct<text:array<string>,answer_start:array<int>>, is_impossible boolean"


def hop(at, titles, said, facts):
    return (at, f"q{at}", "?", "!", (titles, said), ([t for t, _ in facts], [i for _, i in facts]))


def hops(spark, *rows):
    return spark.createDataFrame(rows, HOPS)


def test_variants_and_reasons(spark, tmp_path):
    rows = hops(
        spark,
        hop(0, ["New_York", "B"], [["a.", "b."], ["x"]], [("New York", 1), ("B", 0)]),
        hop(1, ["New  York", "C"], [["a.", "b.", "c."], ["y"]], [("New York", 0)]),  # longest that satisfies
        hop(2, ["New York", "C"], [["z.", "b.", "c.", "d."], ["y!"]], [("Missing", 0)]),  # longer, but another first sentence
        hop(3, ["D"], [["only"]], [("D", 0), ("D", 1), ("D", 5)]),  # binds D 0, then out of range
        hop(4, ["D"], [["only", "more"]], [("D", 0)]),
        hop(5, ["d"], [["lower"]], [("d", 0)]),  # titles keep their case
        hop(6, ["Ñ"], [["one"]], [("Ñ", 0)]),  # one title in NFC
    )
    d = convert.distractors(rows, "at")
    got = {r["key"]: (r["title"], r["text"], r["variants"]) for r in d.articles.collect()}
    assert got["New York"] == ("New  York", [["a.", "b.", "c."]], 3)
    assert got["C"] == ("C", [["y!"]], 2) and got["D"] == ("D", [["only", "more"]], 2) and got["d"][1] == [["lower"]]
    assert {r["query_id"]: r["reason"] for r in d.excluded.collect()} == {"q2": "supporting title absent: Missing", "q3": "supporting sentence out of range: D / 1"}
    assert d.provenance().head().asDict() == {"query_count": 5, "supporting_fact_count": 6, "article_count": 6, "conflicting_article_title_count": 3, "excluded_invalid_query_count": 2}
    d.questions.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(str(tmp_path / "questions"))
    d.articles.select(F.to_json(F.struct("title", "text"))).write.text(str(tmp_path / "corpus"), compression="bzip2")
    bundle = raw.multi_hop(spark, str(tmp_path / "questions"), str(tmp_path / "corpus"))
    assert sorted((r["evidence_id"], r["document_id"], r["text"]) for r in bundle.evidence.collect())[:3] == [("q0:e0", "hotpotqa:New-York", "b."), ("q0:e1", "hotpotqa:B", "x"), ("q1:e0", "hotpotqa:New-York", "a.")]


def test_ties_go_by_json_text_and_last_title(spark):
    rows = hops(spark, hop(0, ["A_b"], [["x", "yz"]], [("A b", 0)]), hop(1, ["A b"], [["x", "zy"]], [("A b", 0)]), hop(2, ["A  b"], [["x", "zy"]], [("A b", 0)]))
    assert [tuple(r) for r in convert.distractors(rows, "at").articles.collect()] == [("A  b", [["x", "zy"]], "A b", 2)]


@pytest.mark.parametrize(
    "rows, said",
    [
        ([hop(0, ["A"], [["x"]], [("A", 0)]), hop(1, ["A"], [["y"]], [("A", 0)])], "two texts for one gold sentence: A / 0"),
        ([hop(0, ["A"], [["x", "y"]], [("A", 0)]), hop(1, ["A"], [["z", "w"]], [("A", 1)])], "no variant satisfies all gold sentences: A"),
        ([hop(0, ["A", "B"], [["x"]], [("A", 0)])], "titles and sentences differ in number"),
        ([hop(0, ["A"], [["x"]], [])], "no facts"),
    ],
)
def test_refused_distractors(spark, rows, said):
    with pytest.raises(Exception, match=said):
        convert.distractors(hops(spark, *rows), "at").articles.collect()


@pytest.mark.parametrize("nested", [True, False], ids=["list of annotations", "list of lists"])
def test_papers(spark, nested):
    marks = [[(False, ["One two.", "nowhere"])], [(False, ["nowhere"])], [(True, []), (False, ["nowhere"])], [(False, ["FLOAT SELECTED: A figure"])], None]
    answers = [(m,) for m in marks] if nested else (marks,)
    kind = f"array<struct<answer:{MARK}>>" if nested else f"struct<answer:array<{MARK}>>"
    names = [f"q{i}" for i in range(5)]
    row = ("p1", "T", "One two.", (["S"], [["Body text.", " "]]), (["A figure", " "],), (names, names, answers))
    bare = ("p2", "U", None, ([], []), None, ([], [], [] if nested else ([],)))
    got = {r["id"]: r for r in convert.papers(spark.createDataFrame([row, bare], PAPER.format(kind))).collect()}
    one = got["p1"]
    assert (one["excluded_questions"], one["excluded_evidence"]) == (2, 3)
    assert [q["question_id"] for q in one["p"]["qas"]] == ["q0", "q2", "q3"] and [len(q["answers"]) for q in one["p"]["qas"]] == [1, 1, 1]
    assert [(s["section_name"], s["paragraphs"]) for s in one["p"]["full_text"]] == [("S", ["Body text.", " "]), ("Figures and Tables", ["FLOAT SELECTED: A figure"])]
    assert got["p2"]["p"].asDict() == {"title": "U", "abstract": [], "full_text": [], "qas": []}
    bundle = raw.paper_bundle(convert.papers(spark.createDataFrame([row, bare], PAPER.format(kind))))
    assert {(r["evidence_id"], r["start"], r["section"]) for r in bundle.evidence.collect()} == {("q0:e0", 0, "Abstract"), ("q3:e0", 22, "Figures and Tables")}
    broken = (*row[:3], (["S", "no paragraphs"], [["Body"]]), *row[4:])
    with pytest.raises(Exception, match="parallel arrays differ in length: p1"):
        convert.papers(spark.createDataFrame([broken], PAPER.format(kind))).collect()


def test_paragraphs(spark):
    ask = lambda i, title, context, texts, starts, off=False: (f"q{i}", title, context, "?", (texts, starts), off)
    rows = [
        ask(0, "T", "One. Two three.", ["Two"], [5]),
        ask(1, "T", "One. Two three.", ["One.", " "], [0, 3]),
        ask(2, None, "One. Two three.", ["three"], [9]),  # another title: another document
        ask(3, "T", "Four.", ["Four"], [0], True),
        ask(4, "T", "Five.", [" "], [0]),
        ("q5", "T", "Six.", "?", None, None),
    ]
    documents, asked = convert.paragraphs(spark.createDataFrame(rows, SPAN))
    assert documents.count() == 2 and {r["q"]["id"] for r in asked.collect()} == {"q0", "q1", "q2"}
    bundle = raw.span_bundle(documents, asked)
    got = {r["query_id"]: (r["document_id"], r["text"]) for r in bundle.evidence.collect()}
    assert got["q0"][1] == "Two three." and got["q1"] == (got["q0"][0], "One.") and got["q2"][0] != got["q0"][0]
    with pytest.raises(Exception, match="texts and starts of answers differ in number: q0"):
        convert.paragraphs(spark.createDataFrame([ask(0, "T", "One.", ["One"], [])], SPAN))[1].collect()
