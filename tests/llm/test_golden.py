"""Golden records against the SQL over made rows, and a few cases by hand."""

import datetime as dt
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from textloom.llm import golden_record

START = dt.datetime(2024, 1, 1)
SCHEMA = pa.schema([("client_id", pa.int64()), ("master_id", pa.int64()), ("source", pa.string()), ("updated_at", pa.timestamp("us")), ("name", pa.string()), ("email", pa.string()), ("city", pa.string()), ("nation_id", pa.int32()), ("segment", pa.string()), ("balance", pa.float64()), ("level", pa.string()), ("at", pa.int64())])


def made(n=1500, hot=500):
    rng = random.Random(5)
    some = lambda p, *of: None if rng.random() < p else rng.choice(of)
    out = []
    for i in range(n):
        days = rng.choice([0, 1, 59, 60, 61, 150])
        at = None if rng.random() < 0.1 else START + dt.timedelta(days=days, microseconds=rng.choice([0, 0, 1, 86_399_999_999]))
        out.append((i, 7 if i < hot else some(0.3, *range(400)), some(0.1, "crm", "web", "store", "partner", "fax"), at, some(0.2, "", " \t", "Ada", "Eve", "Zoë B", " Bo "), some(0.3, "a@b", "c@d", "\n"), some(0.3, "X", "Y", ""), some(0.3, 1, 2), some(0.3, "retail", "public", "online", "\r"), some(0.3, 1.005, -2.5, 0.125, 7.0), "x", 1))
    return out


def put(rows, path):
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in rows], SCHEMA), path / "clients.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [made(), []], ids=["rows", "none"])
def test_sql(spark, tmp_path, rows):
    at = put(rows, tmp_path)
    got = golden_record.op12_golden_record(spark, at)
    said = duckdb.sql(f"WITH clients AS (FROM '{at}/clients.parquet') {golden_record.oracle().strip().replace('WITH cleaned', ', cleaned', 1)}")
    assert said.columns == got.columns
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, said.fetchall()))


def test_rules(spark, tmp_path):
    day = lambda d, us=0: START + dt.timedelta(days=d, microseconds=us)
    rows = [
        (1, None, "crm", day(0), "Adalbert", "old@crm", "Rome", None, "retail", 1.0, "x", 1),  # stale by a microsecond
        (2, 1, "web", day(60, 1), "Ada", "new@web", " ", 3, "public", None, "x", 1),
        (3, 1, "store", day(0, 1), "Ada", None, "Bonn", 4, "public", -0.125, "x", 1),  # fresh to the microsecond
        (3, 1, "store", day(0, 1), "Ada", None, "Bonn", 4, "public", -0.125, "x", 1),
        (None, None, None, None, None, None, None, None, None, float("nan"), "x", 1),
    ]
    one, none = (r.asDict() for r in golden_record.op12_golden_record(spark, put(rows, tmp_path)).orderBy(golden_record.F.col("cluster_id").desc()).collect())
    assert one == {"cluster_id": 1, "n_records": 4, "n_stale": 1, "name": "Adalbert", "name_from": 1, "email": "new@web", "email_from": 2, "segment": "public", "segment_from": 2, "city": "Bonn", "nation_id": 4, "address_from": 3, "balance_cents": -12, "balance_from": 3}
    assert none["n_records"] == none["n_stale"] == 1 and all(v is None for k, v in none.items() if not k.startswith("n_") or k == "nation_id")


def test_zoned_times(spark):
    """A time with a zone is compared as an instant, also where the session's clock goes back."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        rows = spark.sql("SELECT c AS client_id, 1L AS master_id, 'crm' AS source, timestamp_micros(t) AS updated_at, 'n' AS name, 'e' AS email, 'c' AS city, 1 AS nation_id, 's' AS segment, 1.0D AS balance FROM VALUES (1L, 1711843200000000L), (2L, 1706659200000000L), (3L, 1706659199999999L) AS v(c, t)")
        assert golden_record.golden(rows).head()["n_stale"] == 1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
