"""What a run writes and reads again: validation tables, resumption by metric names, runs of chunks only, embedders of chunkers."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textloom import __main__
from textloom.functions import vectors
from textloom.operators import chunking, evaluation
from textloom.plans import matrix

from .test_matrix import experiment


def test_validation_and_resumption(spark, tmp_path):
    e = experiment(tmp_path)
    matrix.run(spark, e)
    row = matrix.tables.read_result(spark, f"{tmp_path}/r/dataset_validation.csv").collect()
    assert [(r["dataset"], r["split"], r["document_count"], r["evidence_mapping_rate"]) for r in row] == [("synthetic", "test", 3, 1.0)]
    said = matrix.tables.read_json(spark, f"{tmp_path}/r/experiment_manifest.json")
    assert said["matrix_size"] == 1 and "commit" in said
    folder, run_id = f"{tmp_path}/r/synthetic/fixed_256", matrix.expand(e)[0]["run_id"]
    assert set(matrix.finished(spark, folder, run_id, e)["metrics"]) == matrix.metric_names(e)
    env = matrix.tables.read_json(spark, f"{folder}/environment.json")
    assert env["packages"]["pyspark"] and "commit" in env
    # a manifest that lacks a metric is no finished run
    got = matrix.tables.read_json(spark, f"{folder}/manifest.json")
    got["metrics"].popitem()
    matrix.write_json(spark, f"{folder}/manifest.json", got)
    assert matrix.finished(spark, folder, run_id, e) is None and matrix.finished(spark, folder, run_id) is not None


def test_chunks_only(spark, tmp_path):
    e = experiment(tmp_path, execution={"only": "chunks", "resume": True}, methods=[{"name": "fixed_256", "chunk_size": 6}, {"name": "late_fixed_256", "overlap": 256}])
    out = matrix.run(spark, e)
    assert (out["completed_count"], out["failed_count"]) == (1, 1) and out["completed"][0]["metrics"] == {} and out["completed"][0]["statistics"]["total_chunks"] == 7
    results = matrix.tables.read_result(spark, f"{tmp_path}/r/chunk_statistics.csv")
    assert [(r["method"], r["datasets"], r["mean"], r["place"]) for r in evaluation.rank_methods(results, "total_chunks").collect()] == [("fixed_256", 1, 7.0, 1)]
    with pytest.raises(KeyError, match="no metric 'hit_3'; there are"):
        evaluation.rank_methods(results, "hit_3")
    assert matrix.run(spark, e)["completed"] == out["completed"]


def test_bags_by_blake2b(spark):
    text = "One red fish. One RED bird!  Two birds."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bucket = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little") % 64
    got = chunking.segmented(df).select(chunking.bags(F.col("sents"), vectors.Blake2bBag(64)).alias("b")).head()["b"]
    assert got == [[bucket(t) for t in s.split()] for s in ("one red fish", "one red bird", "two birds")]
    near = [r["distance"] for r in chunking.adjacent_distances(df, vectors.Blake2bBag(64)).collect()]
    assert near[0] == pytest.approx(1 - 2 / 3) and near[1] == pytest.approx(1.0)


def test_configured_chunkers(spark):
    """Groups under 32 tokens merge by default; minima count from a prominence of 0.05 on, scores have the blake2b jitter."""
    bundle = matrix.raw.synthetic(spark)
    count = lambda **m: matrix.chunk(bundle, m, {"name": "hashing", "dimension": 64}).count()
    assert count(name="semantic_breakpoint") == 3 and count(name="semantic_breakpoint", merge_small_chunks=False) > 3
    text = "aa bb cc dd. aa bb cc ee. aa bb ff gg. hh ii jj kk."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    scores = matrix._scorer(df, "all_previous_segments").head()["scores"]
    jitter = [int.from_bytes(hashlib.blake2b(s.encode(), digest_size=2).digest(), "little") / 65535 / 1000 for s in ("aa bb cc dd.", "aa bb cc ee.", "aa bb ff gg.", "hh ii jj kk.")]
    assert scores == [pytest.approx(x + j, abs=1e-9) for x, j in zip((1.0, 0.25, 0.5, 1.0), jitter, strict=True)]
    one = matrix.raw.Bundle(df.select(F.col("doc_id").cast("string").alias("document_id"), "text"), bundle.queries, bundle.evidence)
    assert [matrix.chunk(one, {"name": "meta_ppl_raw", "prominence": p}).count() for p in (0.05, 0.7, 0.8)] == [2, 2, 1]


def test_command_line(spark, tmp_path, capsys):
    """A smoke run and the check of a data set; a broken one is told by the exit code."""
    assert __main__.main(["--smoke", "--output", str(tmp_path)], spark) == 0
    assert (tmp_path / "smoke" / "summary.json").exists()
    (tmp_path / "d.yaml").write_text("dataset: {name: synthetic, split: test}")
    assert __main__.main(["--validate", str(tmp_path / "d.yaml")], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["evidence_mapping_rate"] == 1.0
    (tmp_path / "papers.json").write_text('{"p": {"title": "T", "abstract": ["A."], "full_text": [], "qas": [{"question_id": "q", "question": "?", "answers": [{"answer": {"unanswerable": false, "evidence": ["not there"]}}]}]}}')
    (tmp_path / "b.yaml").write_text(f"dataset: {{name: qasper, data_path: {tmp_path}/papers.json}}")
    assert __main__.main(["--validate", str(tmp_path / "b.yaml")], spark) == 1
