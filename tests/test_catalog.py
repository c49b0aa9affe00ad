"""Each query with SQL against DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from textloom.plans import catalog, sources_catalog  # noqa: F401  its queries join the catalogue

SF = "/root/testdata/sf0.001"
QUICK = ["chunk_statistics", "fixed_chunks_512_overlap", "sentence_fixed_256", "evidence_coverage", "bm25_passages_restricted", "metrics_23", "interleave_fusion", "semantic_breakpoint", "pic_islands", "matrix_not_run", "streamed_event_counts", "dataset_diagnostics", "perplexity_previous_segment", "dense_passages_restricted", "papers_evidence", "multi_hop_evidence", "bundle_contract", "streamed_chunks"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    said = con.sql(catalog.oracles()[name])
    assert sorted(said.columns) == cols
    key = lambda d: tuple(str(round(d[c], 9) if isinstance(d[c], float) else d[c]) for c in cols)
    assert sorted(key(r.asDict()) for r in df.collect()) == sorted(key(dict(zip(said.columns, r, strict=True))) for r in said.fetchall())
