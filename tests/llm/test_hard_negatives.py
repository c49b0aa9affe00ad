"""Hard negatives against the SQL over made vectors: several blocks and chunks, ties, copies, broken rows."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textloom.llm import hard_negatives

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("row", pa.string()), ("windows", pa.int64())])


def made():
    rng = random.Random(11)
    few = [[rng.choice([-0.5, 0.25, 0.003, 0.0, 1.0]) for _ in range(70)] for _ in range(40)]  # many equal vectors: many ties
    rows = []
    for i in range(700):
        v = list(rng.choice(few)) if rng.random() < 0.5 else [rng.gauss(0.1, 0.3) for _ in range(70)]
        if rng.random() < 0.05:
            v[rng.randrange(70)] = rng.choice([None, float("nan"), float("inf"), -float("inf")])
        rows.append((i if rng.random() < 0.9 else i - i % 100, None if rng.random() < 0.03 else v, rng.choice([None, 0, 0, 0, 0, 1, 2, 9]), "x", 1))
    return rows + rows[:3] + [(None, few[0], 1, "x", 1), (None, few[0], 0, "x", 1), (700, few[1], 77, "x", 1)]  # the last has no positive


def put(rows, path):
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA), path / "embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [made(), made()[:0], [(100, [0.5], 3, "x", 1)]], ids=["rows", "none", "alone"])
def test_sql(spark, tmp_path, rows):
    at = put(rows, tmp_path)
    got = hard_negatives.op13_hard_negatives(spark, at)
    said = duckdb.sql(f"WITH embeddings AS (FROM '{at}/embeddings.parquet') {hard_negatives.oracle().strip().replace('WITH v', ', v', 1)}")
    assert said.columns == got.columns
    found = sorted(map(str, (tuple(r) for r in got.collect())))
    assert found == sorted(map(str, said.fetchall()))
    assert len(rows) < 100 or len(found) > 100


def test_short_vectors_count_as_ending_in_zeros(spark, tmp_path):
    rows = [(100, [1.0, 1.0], 0, "x", 1), (1, [1.0, 1.0, 9.0], 0, "x", 1), (2, [0.75], 1, "x", 1), (3, [], 1, "x", 1)]
    got = [tuple(r) for r in hard_negatives.op13_hard_negatives(spark, put(rows, tmp_path)).collect()]
    assert got == [(100, 1, 1, 2, 2 * 256 * 256, 192 * 256)]


def test_products_are_exact():
    rng = np.random.Generator(np.random.PCG64(1))
    for top in (1 << 10, 1 << 28):
        a, b = (rng.integers(-top, top, (5, 33)) for _ in "ab")
        want = [[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a]
        assert hard_negatives.product(a, b, 33).tolist() == want
    with pytest.raises(OverflowError):
        hard_negatives.product(np.array([[1 << 40]]), np.array([[1 << 40]]), 1)
