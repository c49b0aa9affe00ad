"""Raw formats, manifests, sinks and contracts, on rows of our own."""

import bz2
import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import validation as V
from textloom.sources import raw, tables


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_papers(spark, tmp_path):
    answer = lambda un, *ev: {"answer": {"unanswerable": un, "evidence": list(ev)}}
    data = {"x": {"title": "T", "abstract": ["Ein Ä.", " "], "full_text": [{"section_name": "One", "paragraphs": ["First part.", "Second."]}], "qas": [{"question_id": "a", "question": "?", "answers": [answer(False, "Second.", "Second.", "gone")]}, {"question_id": "b", "question": "?", "answers": [answer(True)]}]}}
    put(tmp_path / "dev.json", data)
    b = raw.papers(spark, str(tmp_path))
    assert rows(b.documents, "document_id", "text") == [("qasper:x", "Ein Ä.\n\nFirst part.\n\nSecond.")]
    assert rows(b.evidence, "evidence_id", "start", "end", "section", "paragraph") == [("a:e0", 21, 28, "One", 1), ("a:e1", None, None, None, None)]
    assert b.metadata["excluded_unanswerable_count"] == 1 and b.queries.count() == 1
    assert raw.papers(spark, str(tmp_path), unanswerable="mark").queries.count() == 2
    d = V.diagnostics(b).head()
    assert (d.evidence_mapping_failure_count, d.evidence_mapping_rate, d.unanswerable_query_count) == (1, 0.5, 1)
    with pytest.raises(V.ContractError):
        V.check_mapping(b)
    with pytest.raises(FileNotFoundError):
        raw.papers(spark, str(tmp_path), "test")


def test_multi_hop(spark, tmp_path):
    (tmp_path / "c").mkdir()
    lines = [{"title": "New_York  City", "text": [["A b.", "C d."], "E."]}, {"title": "new york city", "text": ["other"]}]
    (tmp_path / "c" / "w.bz2").write_bytes(bz2.compress("\n".join(map(json.dumps, lines)).encode()))
    put(tmp_path / "c" / "x.json", [{"title": "Rome", "text": [["Old."]]}])
    q = put(tmp_path / "q.json", [{"_id": "1", "question": "w", "answer": "y", "supporting_facts": [["New York City", 1], ["Rome", 0], ["New York City", 2]]}])
    b = raw.multi_hop(spark, q, str(tmp_path / "c"))
    assert rows(b.documents, "document_id", "text") == [("hotpotqa:New-York-City", "A b. C d. E."), ("hotpotqa:Rome", "Old.")]
    assert rows(b.evidence, "evidence_id", "text", "start") == [("1:e0", "C d.", 5), ("1:e1", "Old.", 0), ("1:e2", "E.", 10)]
    assert rows(b.queries, "relevant_document_ids", "multi_hop") == [(["hotpotqa:New-York-City", "hotpotqa:Rome"], True)]
    V.check(V.bundle_violations(b))
    put(tmp_path / "q.json", [{"_id": "1", "question": "w", "supporting_facts": [["Paris", 0]]}])
    with pytest.raises(ValueError, match="missing"):
        raw.multi_hop(spark, q, str(tmp_path / "c"))


def test_multi_hop_contexts(spark, tmp_path):
    item = lambda i, ctx, at=0: {"_id": i, "question": "w", "answer": "y", "supporting_facts": [["HÀ nội", at]], "context": ctx}
    p = put(tmp_path / "v.json", [item("1", [["Hà Nội", ["Một.", "Hai."]]], 1), item("2", [["Hà Nội", ["Một.", "Hai."]]])])
    b = raw.multi_hop_contexts(spark, p)
    assert rows(b.documents, "document_id", "text") == [("vimqa:hà-nội", "Một. Hai.")]
    assert rows(b.evidence, "evidence_id", "text", "start") == [("1:e0", "Hai.", 5), ("2:e0", "Một.", 0)]
    with pytest.raises(ValueError, match="out of range"):
        raw.multi_hop_contexts(spark, put(tmp_path / "v.json", [item("1", [["Hà Nội", ["Một."]]], 4)]))
    with pytest.raises(ValueError, match="several contents"):
        raw.multi_hop_contexts(spark, put(tmp_path / "v.json", [item("1", [["Hà Nội", ["Một."]]]), item("2", [["Hà Nội", ["Ba."]]])]))


def test_answer_spans(spark, tmp_path):
    body = "Đây là 3.5 km... xa lắm. Hai! Ba"
    qa = lambda i, *a: {"id": i, "question": "w", "answers": [{"text": t, "answer_start": s} for t, s in a]}
    data = {"data": [{"title": "t", "paragraphs": [{"context": body, "qas": [qa("1", ("3.5", 7), ("xa", 16), ("Ba", 30)), qa("2", ("lắm. Hai", 20)), qa("3")]}]}]}
    b = raw.answer_spans(spark, put(tmp_path / "u.json", data))
    assert rows(b.evidence, "evidence_id", "text", "start", "end") == [("1:e0", "Đây là 3.5 km... xa lắm.", 0, 24), ("1:e1", "Ba", 30, 32), ("2:e0", "Đây là 3.5 km... xa lắm. Hai!", 0, 29)]
    assert rows(b.queries, "query_id", "unanswerable") == [("1", False), ("2", False), ("3", True)]
    data["data"][0]["paragraphs"][0]["qas"] = [qa("1", ("Hai", 3))]
    with pytest.raises(ValueError, match="offset"):
        raw.answer_spans(spark, put(tmp_path / "u.json", data))


@pytest.mark.parametrize("text", ["", "  ", ". a. b", "Wait... no. ?! x", "a?. b .! c", "no end ", "..", "x.y z.\n w"])
def test_sentence_spans(spark, text):
    want, start, i = [], 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in ".!?":
            j += 1
        if j > i and (j == len(text) or text[j].isspace()) and not (text[i] == "." and j - i > 1):
            want.append((start, j))
            start = j
        i = max(j, i + 1)
    want.append((start, len(text)))
    trim = lambda a, b: (a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip()))
    want = [trim(a, b) for a, b in want if text[a:b].strip()]
    got = spark.createDataFrame([(text,)], "t STRING").select(raw.sentence_spans("t").alias("s")).head().s
    assert [tuple(x) for x in got] == want


def test_manifest_and_contract(spark, tmp_path):
    put(tmp_path / "d.csv", "id,title,text\n1,,a\n2,\"x, y\",b\n")
    put(tmp_path / "p.jsonl", "\n".join(json.dumps({"passage_id": i, "document_id": d, "passage_text": "t", "passage_position": 0}) for i, d in ((1, 1), (2, 2))))
    put(tmp_path / "q.csv", "query_id,query_text,dataset,split\n7,w,z,test\n")
    put(tmp_path / "r.json", [{"query_id": 7, "passage_id": 2, "relevance": 2}])
    put(tmp_path / "manifest.json", {"documents": "d.csv", "passages": "p.jsonl", "queries": "q.csv", "qrels": "r.json", "column_maps": {"documents": {"document_id": "id"}}})
    data = tables.from_manifest(spark, str(tmp_path), "z")
    V.check(V.retrieval_violations(data))
    row = V.audit(data).head()
    assert (row.documents, row.missing_title_rate, row.graded_qrels, row.splits) == (2, 0.5, True, "test")
    put(tmp_path / "r.json", [{"query_id": 7, "passage_id": 9, "relevance": -1}])
    with pytest.raises(V.ContractError, match="(?s)unknown passages.*relevance not"):
        V.check(V.retrieval_violations(tables.from_manifest(spark, str(tmp_path), "z")))
    with pytest.raises(ValueError, match="format"):
        tables.read_table(spark, "x.xls")


def test_synthetic_and_cache(spark, tmp_path):
    b = raw.synthetic(spark)
    V.check(V.bundle_violations(b))
    V.check_mapping(b)
    V.check(V.retrieval_violations(tables.synthetic_retrieval(spark)))
    key = tables.fingerprint(b.documents, ("document_id", "text"), "v1")
    assert key == tables.fingerprint(b.documents.orderBy(F.desc("document_id")), ("document_id", "text"), "v1") != tables.fingerprint(b.documents, ("document_id", "text"), "v2")
    made = []
    for _ in range(2):
        got = tables.cached(b.documents, str(tmp_path), key, lambda d: made.append(1) or d.select("document_id"))
    assert made == [1] and got.count() == 3
    events = spark.createDataFrame([("tune", "ms_marco", "dev", True), ("select", "nq_hard", "test", True)], "purpose STRING, dataset STRING, split STRING, uses_labels BOOLEAN")
    assert V.protocol_violations(events).count() == 3


def test_multi_hop_reads_its_corpus_once(spark, tmp_path, monkeypatch):
    (tmp_path / "c").mkdir()
    put(tmp_path / "c" / "w.jsonl", "\n".join(json.dumps({"title": f"T{i}", "text": [["A b.", "C d."]]}) for i in range(3)))
    q = put(tmp_path / "q.json", [{"_id": "1", "question": "w", "answer": "y", "supporting_facts": [["T1", 1]]}])
    n, read = spark.sparkContext.accumulator(0), raw.articles

    def passed(x):
        n.add(1)
        return x

    monkeypatch.setattr(raw, "articles", lambda *a: read(*a).withColumn("title", F.udf(passed).asNondeterministic()("title")))
    assert rows(raw.multi_hop(spark, q, str(tmp_path / "c")).evidence, "evidence_id", "text", "start") == [("1:e0", "C d.", 5)]
    assert n.value == 3
