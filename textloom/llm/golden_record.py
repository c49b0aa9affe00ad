"""Golden records: one row per cluster, each field from the record that its rule puts first.

Pivot by source. One conditional aggregation per cluster and segment keeps, for every trust level and
field, the level's first candidate; a second one rolls the segments of a cluster up. Within a level the
latest candidate is fresh if any of the level is, so its freshness is tested afterwards, against the
cluster's latest time, and the ladder of levels is walked by coalescing: fresh levels by trust, then
stale ones. Rules that put time or length before trust take the greatest of the levels' candidates.

Both aggregations combine before they shuffle, so that of a cluster with a third of all rows each task
sends one row a segment. Stale records are counted by day: days before the cluster's cut-off are stale
as a whole, and only records of the cut-off's own day are compared with it. Nothing goes through one
task, to the driver or into a broadcast: the joins are merge joins, also where a side looks small.

Edge cases: a string that is empty or white space counts as null; so does a balance that is not finite,
while cents beyond a long are null. A source that is null or not in ``trust`` has the lowest level,
one for all of them. Records without either id make up one cluster, whose id is null. A null client_id
comes after all others; rows that are equal in all that a rule compares are decided by the greater value.
A cluster without any time has only stale records. Repeated rows count each in n_records and n_stale.
An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Sources by falling trust (fixed by the contract).
TRUST = ("crm", "web", "store", "partner")
#: Hours after which a record is stale, counted from its cluster's latest.
FRESH_HOURS = 60 * 24
SPACE = " \t\n\v\f\r"


def said(name: str) -> Column:
    """A string column; null where it holds white space only."""
    col = F.col(name)
    return F.when(F.translate(col, SPACE, "") != "", col)


def cut_off(latest: Column, kind: str, hours: int) -> Column:
    """``hours`` before ``latest``, to the microsecond, whatever the session's zone."""
    if kind == "timestamp_ntz":
        return latest - F.make_dt_interval(hours=F.lit(hours))
    return F.timestamp_micros(F.unix_micros(latest) - F.lit(hours * 3_600_000_000))


def day_of(at: Column, kind: str) -> Column:
    """A number or date that never falls as ``at`` rises."""
    return at.cast("date") if kind == "timestamp_ntz" else F.floor(F.unix_micros(at) / F.lit(86_400_000_000))


def prepared(clients: DataFrame, trust=TRUST) -> DataFrame:
    """cluster_id, level (0 is trusted most), at, order (rises as client_id falls) and the fields."""
    level = reduce(lambda rest, i: F.when(F.col("source") == trust[i], i).otherwise(rest), reversed(range(len(trust))), F.lit(len(trust)))
    finite = F.when(F.abs(F.col("balance")) < float("inf"), F.col("balance"))  # false for NaN too: it is above infinity
    return clients.select(
        F.coalesce("master_id", "client_id").alias("cluster_id"), level.alias("level"), F.col("updated_at").alias("at"), F.bitwise_not("client_id").alias("order"),
        said("name").alias("name"), said("email").alias("email"), said("segment").alias("segment"), said("city").alias("city"), "nation_id", finite.alias("balance"),
    )


def stale_counts(rows: DataFrame, kind: str, hours: int) -> DataFrame:
    """(cluster_id, n_stale) of clusters with stale records; ``rows``: cluster_id, at.

    Rows of a day are counted before they are dealt; a cluster has as many of them as days."""
    days = rows.groupBy("cluster_id", day_of(F.col("at"), kind).alias("day")).agg(F.count("*").alias("n"), F.max("at").alias("last"))
    heads = days.groupBy("cluster_id").agg(cut_off(F.max("last"), kind, hours).alias("cut")).select(F.col("cluster_id").alias("head"), "cut", day_of(F.col("cut"), kind).alias("cut_day"))
    same = F.col("cluster_id").eqNullSafe(F.col("head"))
    past = days.join(heads.hint("merge"), same).where(F.col("day").isNull() | (F.col("day") < F.col("cut_day"))).select("cluster_id", "n")
    # a row of the cut-off's day: dealt by cluster and day
    near = rows.withColumn("day", day_of(F.col("at"), kind)).join(heads.hint("merge"), same & (F.col("day") == F.col("cut_day"))).where("at < cut").groupBy("cluster_id", "day").agg(F.count("*").alias("n")).select("cluster_id", "n")
    return past.unionByName(near).groupBy("cluster_id").agg(F.sum("n").alias("n_stale"))


def golden(clients: DataFrame, trust=TRUST, hours: int = FRESH_HOURS) -> DataFrame:
    """One row per cluster: cluster_id, n_records, n_stale, the fields and where each is from."""
    kind = dict(clients.dtypes)["updated_at"]
    levels = range(len(trust) + 1)
    rows = prepared(clients, trust)
    known = (F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")).alias("known")
    # for each field what a rule compares within a level, then the value; the greatest comes first
    keeps = {
        "email": (F.struct("at", "order", "email"), F.col("email").isNotNull()),
        "name": (F.struct(F.length("name").alias("size"), "at", "order", "name"), F.col("name").isNotNull()),
        "segment": (F.struct("at", "order", "segment"), F.col("segment").isNotNull()),
        "balance": (F.struct("at", "order", "balance"), F.col("balance").isNotNull()),
        "address": (F.struct(known, "at", "order", "city", "nation_id"), F.lit(True)),
    }
    cell = lambda field, i: f"{field}_{i}"
    cells = [F.max(F.when((F.col("level") == i) & there, key)).alias(cell(field, i)) for field, (key, there) in keeps.items() for i in levels]
    parts = rows.groupBy("cluster_id", "segment").agg(F.count("*").alias("n_records"), F.max("at").alias("latest"), *cells)

    def first_of(field: str, by: list[str], rest: list[str]) -> Column:
        """The greatest of the levels' candidates: ``by`` first, then trust, then ``rest``."""
        of = lambda i: F.when(F.col(cell(field, i)).isNotNull(), F.struct(*(F.col(cell(field, i))[c].alias(c) for c in by), F.lit(-i).alias("trust"), *(F.col(cell(field, i))[c].alias(c) for c in rest)))
        return F.greatest(*(of(i) for i in levels))

    # a segment's own first record and first balance, by RECENT: the chosen segment's balance comes first
    parts = parts.withColumn("own", first_of("segment", ["at"], ["order", "segment"])).withColumn("own_balance", first_of("balance", ["at"], ["order", "balance"]))
    whole = parts.groupBy("cluster_id").agg(
        F.sum("n_records").alias("n_records"), F.max("latest").alias("latest"),
        F.max(F.when(F.col("own").isNotNull(), F.struct("own", "own_balance"))).alias("chosen"), F.max("own_balance").alias("any_balance"),
        *(F.max(cell(f, i)).alias(cell(f, i)) for f in ("email", "name", "address") for i in levels),
    )
    cut = cut_off(F.col("latest"), kind, hours)
    fresh = lambda at: F.coalesce(at >= cut, F.lit(False))
    email = [F.col(cell("email", i)) for i in levels]
    ladder = F.coalesce(*(F.when(fresh(c["at"]), c) for c in email), *email)
    # of equal length: fresh before stale, then trust, then RECENT
    name = F.greatest(*(F.when(F.col(cell("name", i)).isNotNull(), F.struct(F.col(cell("name", i))["size"].alias("size"), fresh(F.col(cell("name", i))["at"]).alias("fresh"), F.lit(-i).alias("trust"), *(F.col(cell("name", i))[c].alias(c) for c in ("at", "order", "name")))) for i in levels))
    whole = whole.select(
        "cluster_id", "n_records", "latest", ladder.alias("email"), name.alias("name"), first_of("address", ["known", "at"], ["order", "city", "nation_id"]).alias("address"),
        F.col("chosen.own").alias("segment"), F.coalesce("chosen.own_balance", "any_balance").alias("balance"),
    )
    by = lambda c: F.bitwise_not(F.col(f"{c}.order")).alias(f"{c}_from")
    cents = F.floor(F.lit(100.0) * F.col("balance.balance") + F.lit(0.5))
    stale = stale_counts(rows.select("cluster_id", "at"), kind, hours).withColumnRenamed("cluster_id", "head")
    return whole.join(stale.hint("merge"), F.col("cluster_id").eqNullSafe(F.col("head")), "left").select(
        "cluster_id", "n_records", F.coalesce("n_stale", F.lit(0)).cast("long").alias("n_stale"), F.col("name.name").alias("name"), F.col("email.email").alias("email"), F.col("segment.segment").alias("segment"),
        F.col("address.city").alias("city"), F.col("address.nation_id").alias("nation_id"), F.when(F.abs(F.col("balance.balance")) < 9e16, cents).cast("long").alias("balance_cents"),
        by("name"), by("email"), by("segment"), by("balance"), F.when(F.col("address.known") > 0, F.bitwise_not(F.col("address.order"))).alias("address_from"),
    )


def op12_golden_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden(table(spark, sf_dir, "clients"))


def oracle() -> str:
    blank = lambda c: f"CASE WHEN regexp_matches({c}, '[^\\x20\\x09-\\x0D]') THEN {c} END AS {c}"
    recent = "ts DESC NULLS LAST, level, client_id NULLS LAST"
    trusted = f"stale, level, {recent}"

    def first(value: str, order: str, field: str) -> str:
        return f"first({value} ORDER BY {order}) FILTER (WHERE {field} IS NOT NULL)"

    return f"""
WITH cleaned AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at AS ts, {blank("name")}, {blank("email")}, {blank("segment")}, {blank("city")}, nation_id,
    CASE WHEN isfinite(balance) THEN balance END AS balance, CASE source WHEN 'crm' THEN 0 WHEN 'web' THEN 1 WHEN 'store' THEN 2 WHEN 'partner' THEN 3 ELSE 4 END AS level
  FROM clients
), dated AS (
  SELECT *, max(ts) OVER (PARTITION BY cluster_id) AS latest FROM cleaned
), aged AS (
  SELECT *, (ts IS NULL OR ts < latest - INTERVAL {FRESH_HOURS} HOUR)::INT AS stale, (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS known FROM dated
), chosen AS (
  SELECT *, first(segment) OVER (PARTITION BY cluster_id ORDER BY (segment IS NULL)::INT, {recent} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM aged
)
SELECT cluster_id, count(*) AS n_records, sum(stale)::BIGINT AS n_stale,
  {first("name", f"length(name) DESC, {trusted}", "name")} AS name, {first("email", trusted, "email")} AS email, {first("segment", recent, "segment")} AS segment,
  first(city ORDER BY known DESC, {recent}) AS city, first(nation_id ORDER BY known DESC, {recent}) AS nation_id,
  {first("floor(100.0::DOUBLE * balance + 0.5)::BIGINT", f"coalesce((segment = best)::INT, 0) DESC, {recent}", "balance")} AS balance_cents,
  {first("client_id", f"length(name) DESC, {trusted}", "name")} AS name_from, {first("client_id", trusted, "email")} AS email_from, {first("client_id", recent, "segment")} AS segment_from,
  {first("client_id", f"coalesce((segment = best)::INT, 0) DESC, {recent}", "balance")} AS balance_from,
  CASE WHEN max(known) > 0 THEN first(client_id ORDER BY known DESC, {recent}) END AS address_from
FROM chosen GROUP BY cluster_id"""
