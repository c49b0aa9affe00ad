"""Registries, configuration and the matrix runner."""

import pytest

from textloom.plans import matrix


def experiment(tmp_path, **more):
    said = {"run_name": "r", "datasets": [{"name": "synthetic", "split": "test"}], "methods": [{"name": "fixed_256", "chunk_size": 6}], "output_dir": str(tmp_path), "evaluation": {"k_values": [1, 3], "retrieval_depth": 5}}
    return matrix.Experiment(**(said | more))


def test_registries():
    r = matrix.Registry("thing")
    r.add("a", int)
    with pytest.raises(ValueError):
        r.add("a", int)
    with pytest.raises(KeyError, match="there are"):
        r["b"]
    assert len(matrix.METHODS.names()) == 12


def test_configuration(tmp_path):
    (tmp_path / "d.yaml").write_text("dataset: {name: synthetic}")
    (tmp_path / "e.yaml").write_text("run_name: x\ndatasets: [d.yaml, {name: synthetic, split: dev}]\nmethods: [fixed_256, {name: fixed_512, _note: 1}]\noutput_dir: o\nsmoke: true\n")
    e = matrix.load(str(tmp_path / "e.yaml"))
    runs = matrix.expand(e)
    assert [r["method"]["name"] for r in runs] == ["fixed_256", "fixed_512"] * 2 and len({r["run_id"] for r in runs}) == 4
    assert matrix.config_hash(e, {"a": 1}, {"b": 2, "_c": 3}) == matrix.config_hash(e, {"a": 1}, {"b": 2})
    with pytest.raises(ValueError, match="retrieval_depth"):
        experiment(tmp_path, evaluation={"k_values": [3], "retrieval_depth": 2})


def test_run_isolates_and_resumes(spark, tmp_path):
    e = experiment(tmp_path, methods=[{"name": "fixed_256", "chunk_size": 6}, {"name": "semantic_single_linkage_paper_exact"}, {"name": "nothing"}])
    out = matrix.run(spark, e)
    assert out["completed_count"] == 2 and [f["method"] for f in out["failed"]] == ["nothing"], out["failed"]
    first = out["completed"][0]
    assert first["statistics"]["total_chunks"] == 7 and first["metrics"]["document_recall_3"] > 0
    root = f"{tmp_path}/r"
    rows = matrix.tables.read_result(spark, f"{root}/benchmark_metrics.csv").collect()
    assert sorted((r["method"], r["status"]) for r in rows) == [("fixed_256", "completed"), ("nothing", "failed"), ("semantic_single_linkage_paper_exact", "completed")]
    assert matrix.tables.read_json(spark, f"{root}/synthetic/fixed_256/runtime.json")["runtime_seconds"] > 0
    assert matrix.error_cases(root, spark, "synthetic", "fixed_256", 3).count() == 0
    assert matrix.error_cases(root, spark, "synthetic", "fixed_256", 3, True).select("query_id").distinct().count() < 2
    again = matrix.run(spark, experiment(tmp_path, execution={"resume": True}))
    assert again["completed"][0]["run_id"] == first["run_id"]
    changed = experiment(tmp_path, execution={"resume": True}, methods=[{"name": "fixed_256", "chunk_size": 7}])
    assert matrix.finished(spark, f"{tmp_path}/r/synthetic/fixed_256", matrix.expand(changed)[0]["run_id"]) is None


def test_late_vectors_know_their_document(spark):
    e = matrix.Experiment("r", [{"name": "synthetic"}], [{"name": "late_fixed_256"}], "o")
    bundle = matrix.raw.synthetic(spark)
    got = {}
    for name in ("fixed_256", "late_fixed_256"):
        m = {"name": name, "chunk_size": 6}
        chunks = matrix.chunk(bundle, m)
        got[name] = {r["item_id"].split(":")[-1] + r["item_id"][:6]: r["vector"] for r in matrix.represent(e, bundle, chunks, m).collect()}
    assert got["fixed_256"].keys() == got["late_fixed_256"].keys() and all(got["fixed_256"][k] != got["late_fixed_256"][k] for k in got["fixed_256"])
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in got["late_fixed_256"].values())


def test_late_limits(spark):
    e = matrix.Experiment("r", [{"name": "synthetic"}], [{"name": "late_fixed_256"}], "o")
    bundle = matrix.raw.synthetic(spark)
    for policy, said in (("error", "over 5 tokens"), ("truncate", "no token inside")):
        m = {"name": "late_fixed_256", "chunk_size": 6, "max_document_tokens": 5, "long_document_policy": policy}
        with pytest.raises(Exception, match=said):
            matrix.represent(e, bundle, matrix.chunk(bundle, m), m).collect()
    m["long_document_policy"] = "window"
    assert matrix.represent(e, bundle, matrix.chunk(bundle, m), m).count() == matrix.chunk(bundle, m).count()


def test_full_runs_refuse_stand_ins(tmp_path):
    with pytest.raises(ValueError, match="stand-ins"):
        matrix.refuse_mocks(experiment(tmp_path, execution={"mode": "full"}, methods=[{"name": "meta_ppl_raw", "backend_type": "mock"}]))


def test_stopped_runs_are_no_results(spark, tmp_path, monkeypatch):
    """A limit of time ends a run (F2, F3, F4); it is no failure of the pair that it struck."""

    def cut(*_):
        raise TimeoutError("time is up")

    monkeypatch.setattr(matrix, "run_pair", cut)
    with pytest.raises(TimeoutError):
        matrix.run(spark, experiment(tmp_path))


def test_results_of_languages(spark, tmp_path, monkeypatch):
    """Documents without a token fail no method, and what breaks from outside is raised, not written as a result (F2, F3, F4)."""
    from textloom.operators import validation
    from textloom.plans import sources_catalog

    rows = [(1, "one two", "en"), (2, " \n ", "en"), (3, "three", None), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.dataset, r.method): (r.status, r.total_chunks) for r in sources_catalog.results(spark, str(tmp_path)).collect()}
    sets, done = ("documents_en", "documents_none"), ("completed", 1)
    assert got == {(d, m): done for d in sets for m in ("fixed_256", "fixed_512")} | {(d, "late_fixed_256"): ("failed", None) for d in sets}

    def broken(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(matrix, "run_pair", broken)
    with pytest.raises(validation.RunError, match="executor lost"):
        sources_catalog.results(spark, f"{tmp_path}/")
    plan = validation.diagnostics(sources_catalog._language(spark, {"path": f"{tmp_path}/documents.parquet", "lang": "en"}))
    assert "first(text" not in plan._jdf.queryExecution().optimizedPlan().toString()
