"""Segments of long documents: what a document costs grows with its segments, not with their square."""

import re

from pyspark.sql import functions as F

from textloom.operators import chunking


def test_no_fold_copies_its_list(spark):
    docs = spark.createDataFrame([(1, "Ein Satz. Noch einer! ")], "doc_id long, text string")
    for made in (chunking.semantic_breakpoint(docs, most=512), chunking.perplexity_chunks(docs, most=512), chunking.pic_chunks(docs, most=512)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"array_intersect|concat\(lambda ", plan)


def test_a_long_document(spark):
    text = "".join(f" Wort{i % 7} ist ä{i}.\n" for i in range(20_000))
    row = chunking.segmented(spark.createDataFrame([(1, text), (2, " \n"), (3, None)], "doc_id long, text string")).select("doc_id", "starts", "n", F.size("sents").alias("size"), F.array_join("pieces", "").alias("whole")).collect()
    assert [r.doc_id for r in row] == [1] and row[0].size == 20_000 and set(row[0].n) == {3}
    assert row[0].starts == [m.start() for m in re.finditer("Wort", text)] and text.startswith(row[0].whole)


def test_merge_and_cap(spark):
    rows = [(1, [4, 3, 5, 1], [True, False, True, False]), (2, [9, 9], [True, False]), (3, [1, 1], [True, False])]
    docs = spark.createDataFrame(rows, "doc_id long, n array<int>, cuts array<boolean>")
    cuts = lambda *how: [r.cuts for r in chunking.merge_and_cap(docs, *how).orderBy("doc_id").collect()]
    assert cuts(5, None) == [[False, False, False, False], [True, False], [False, False]]
    assert cuts(0, 7) == [[True, True, True, False], [True, False], [True, False]]
    assert cuts(0, 8) == [[True, False, True, False], [True, False], [True, False]]
