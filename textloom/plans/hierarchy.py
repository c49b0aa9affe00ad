"""Two-stage experiments: document methods by passage methods over normalised retrieval tables.

All queries of a stage run as one plan. Stage one ranks documents, stage two ranks passages of the
selected documents; both are sparse (BM25), dense (signed hashing) or combined. Rankings are written
once and read by the metrics; each table of an export is checked against its columns before it is written.
"""

from __future__ import annotations

import copy
import json
import platform
import subprocess
import sys
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors
from ..operators import evaluation, retrieval, validation
from ..sources import index, raw, tables

#: Names of methods, data sets and modes, and the budgets (document, passage, final) of each mode.
KINDS = ("sparse", "dense", "combined")
DATA_SETS = ("ms_marco", "natural_questions", "miracl", "genomics", "conditional_qa", "nq_hard")
BUDGETS = {"smoke": (3, 5, 5), "baseline": (20, 100, 100), "full": (100, 1000, 100)}
STRATEGIES = ("title_plus_lead", "title_only", "lead_only")
#: Columns of the exported tables.
COLUMNS = {
    "aggregate_metrics": ["dataset", "method", "status", "passage_ndcg@10", "passage_recall@100"],
    "document_metrics": ["dataset", "method", "status", "document_ndcg@10", "document_recall@5", "document_recall@20", "document_recall@100"],
    "passage_metrics": ["dataset", "method", "status", "passage_ndcg@10", "passage_recall@5", "passage_recall@20", "passage_recall@100", "candidate_survival_rate"],
    "latency": ["dataset", "method", "status", "mean_query_latency_ms", "p50_query_latency_ms", "p95_query_latency_ms", "mean_unique_result_count"],
    "categories": ["dataset", "method", "category", "query_count", "passage_ndcg@10", "passage_recall@100", "status"],
}


def pairs_of_methods() -> dict[str, tuple[str, str]]:
    """The nine experiments: name to (document method, passage method)."""
    return {f"{a}_{b}": (a, b) for a in KINDS for b in KINDS}


#: Encoders of the dense methods by name: (items with item_id and text, configuration) to item_id, vector. A model adds itself here.
ENCODERS: dict[str, Callable[[DataFrame, Config], DataFrame]] = {"hashing": lambda items, c: vectors.signed_vectors(items, c.dim, c.native_hash)}


@dataclass(frozen=True)
class Config:
    name: str = "two_stage"
    mode: str = "smoke"
    methods: tuple[str, ...] = tuple(pairs_of_methods())
    document_k: int = 3
    passage_k: int = 5
    final_k: int = 5
    combined: str = "interleave"
    rrf_k: int = 60
    fusion: str = "passage_only"
    document_weight: float = 0.5
    strategy: str = "title_plus_lead"
    lead: int = 2000
    dim: int = 512
    native_hash: bool = False
    sample: int | None = None
    split: str | None = None
    seed: int = 42
    tuned_on: str = "ms_marco"
    tuned_split: str = "dev"
    frozen: bool = True
    output: str = "outputs"
    datasets: tuple[str, ...] = ("synthetic",)
    synthetic: bool = False
    encoder: str = "hashing"
    dense_index: str = "exact"
    sparse_index: str = "bm25"
    #: So many queries are run one by one to measure their time.
    latency_queries: int = 3
    #: Folder of indexes and vectors that runs share; none: both are made anew in every plan.
    cache: str | None = None

    def problems(self) -> list[str]:
        """Every rule that the configuration breaks."""
        rules = {
            f"mode is one of {sorted(BUDGETS)}": self.mode in BUDGETS,
            "the experiment has a name": bool(self.name.strip()),
            f"methods are among {sorted(pairs_of_methods())}": bool(self.methods) and set(self.methods) <= set(pairs_of_methods()),
            f"data sets are among {sorted(DATA_SETS)} or synthetic": bool(self.datasets) and set(self.datasets) <= {*DATA_SETS, "synthetic"},
            "a synthetic run has the synthetic data set alone": not self.synthetic or self.datasets == ("synthetic",),
            f"vectors are made by one of {sorted(ENCODERS)}": self.encoder in ENCODERS,
            "hashed vectors are for smoke runs": self.mode == "smoke" or self.encoder != "hashing",
            "dense results are exact": self.dense_index == "exact",
            "sparse results are bm25": self.sparse_index == "bm25",
            "the number of timed queries is not negative": self.latency_queries >= 0,
            "test labels choose no parameter": self.tuned_split != "test",
            "budgets are positive": min(self.document_k, self.passage_k, self.final_k) > 0,
            "the final budget is at most the passage budget": self.final_k <= self.passage_k,
            "a sample is positive or not asked for": self.sample is None or self.sample > 0,
            f"documents are represented by one of {STRATEGIES}": self.strategy in STRATEGIES,
            "combined results are interleave or rrf": self.combined in ("interleave", "rrf"),
            "rrf_k is positive": self.rrf_k > 0,
            "scores are passage_only or weighted_sum": self.fusion in ("passage_only", "weighted_sum"),
            "the document weight lies in [0, 1]": 0 <= self.document_weight <= 1,
            "parameters were chosen on ms_marco train or dev": self.tuned_on == "ms_marco" and self.tuned_split in ("train", "dev"),
            "parameters are frozen outside smoke runs": self.mode == "smoke" or self.frozen,
        }
        return [rule for rule, kept in rules.items() if not kept]

    def check(self) -> Config:
        if broken := self.problems():
            raise validation.ConfigError("broken rules: " + "; ".join(broken))
        return self


def config_for(mode: str, **more) -> Config:
    """The preset of a mode with changes."""
    if mode not in BUDGETS:
        raise ValueError(f"unknown mode {mode!r}; there are {sorted(BUDGETS)}")
    d, p, f = BUDGETS[mode]
    return replace(Config(mode=mode, document_k=d, passage_k=p, final_k=f), **more).check()


def load_dataset(spark: SparkSession, name: str, root: str) -> tables.Retrieval:
    """One of the six data sets by its manifest below ``root``, or the synthetic one."""
    if name == "synthetic":
        return tables.synthetic_retrieval(spark)
    if name not in DATA_SETS:
        raise KeyError(f"unknown data set {name!r}; there are {sorted(DATA_SETS)}")
    return tables.from_manifest(spark, f"{root.rstrip('/')}/{name}", name)


def sampled(data: tables.Retrieval, size: int | None, seed: int, split: str | None = None) -> tables.Retrieval:
    """Fewer queries: those of a split (refused if it has none), of these ``size`` by seeded hash. Judgements follow; the corpus stays whole."""
    q = data.queries
    if split is not None:
        q = q.where(F.col("split") == split)
        if q.isEmpty():
            raise ValueError(f"{data.name} has no queries of split {split!r}")
    if size is not None:
        q = q.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "query_id")), "query_id").limit(size)
    ids = q.select("query_id")
    kept = lambda df: None if df is None else df.join(ids, "query_id", "left_semi")
    return replace(data, queries=q, qrels=kept(data.qrels), query_metadata=kept(data.query_metadata))


def storage_bytes(items: DataFrame) -> DataFrame:
    """One row: the bytes of a sparse index of ``items`` (item_id, text): eight and the term's per posting, eight per item."""
    post = items.select("item_id", F.explode(F.array_distinct(T.terms(T.text_of()))).alias("t")).agg(F.coalesce(F.sum(F.octet_length("t") + 8), F.lit(0)).alias("p"))
    return post.crossJoin(items.agg(F.count("*").alias("n"))).select((F.col("p") + 8 * F.col("n")).cast("long").alias("storage_bytes"))  # rows of one


class Retrievers:
    """The two stages over one data set; the nine experiments share its tables and vectors."""

    def __init__(self, data: tables.Retrieval, config: Config):
        c = self.config = config
        self.queries = data.queries.select("query_id", F.col("query_text").alias("text"))
        self.documents = data.documents.select(F.col("document_id").alias("item_id"), "text")
        self.passages = data.passages.select(F.col("passage_id").alias("item_id"), "document_id", F.col("passage_text").alias("text"))
        said = data.documents.select(F.col("document_id").alias("item_id"), T.representation(F.col("title"), F.coalesce("text", F.lit("")), c.strategy, c.lead).alias("text"))
        self.indexes = None if c.cache is None else {"documents": index.build(self.documents, c.cache), "passages": index.build(self.passages, c.cache)}
        #: Texts that had to be embedded, with a cache.
        self.embedded = 0

        def encode(items: DataFrame) -> DataFrame:
            if c.cache is None:
                return ENCODERS[c.encoder](items, c)
            made, n = index.cached_vectors(items, c.cache, f"{c.encoder}-{c.dim}-{c.native_hash}", lambda x: ENCODERS[c.encoder](x, c))
            self.embedded += n
            return made

        self.asked = encode(self.queries.withColumnRenamed("query_id", "item_id")).withColumnRenamed("item_id", "query_id")
        self.document_vectors, self.passage_vectors = encode(said), encode(self.passages)

    def one(self, kind: str, k: int, within: DataFrame | None) -> DataFrame:
        items = self.documents if within is None else self.passages
        if kind == "sparse":
            if self.indexes is None:
                got = retrieval.bm25(self.queries, items, k, within=within)
            else:
                got = self.indexes["documents" if within is None else "passages"].search(self.queries, k, within=within)
            return got.withColumn("sparse_rank", F.col("rank")).withColumn("dense_rank", F.lit(None).cast("int")).withColumn("source_method", F.lit("sparse"))
        if kind == "dense":
            if within is None:
                got = retrieval.cosine_top_k(self.asked, self.document_vectors, k)
            else:
                got = retrieval.dense_within(self.asked, self.passage_vectors, self.passages, within, k)
            return got.withColumn("sparse_rank", F.lit(None).cast("int")).withColumn("dense_rank", F.col("rank")).withColumn("source_method", F.lit("dense"))
        if kind != "combined":
            raise KeyError(f"unknown method {kind!r}; there are {KINDS}")
        depth = k if self.config.combined == "interleave" else 2 * k
        sparse, dense = (self.one(x, depth, within).select("query_id", "item_id", "score", "rank") for x in ("sparse", "dense"))
        if self.config.combined == "interleave":
            return retrieval.interleave(sparse, dense, k)
        both = retrieval.reciprocal_rank(sparse, dense, k, self.config.rrf_k)
        return both.withColumn("source_method", F.when(F.col("dense_rank").isNull(), "sparse").when(F.col("sparse_rank").isNull(), "dense").otherwise("sparse+dense"))

    def only(self, query_id: str) -> Retrievers:
        """The same over one query."""
        out = copy.copy(self)
        out.queries, out.asked = (df.where(F.col("query_id") == query_id) for df in (self.queries, self.asked))
        return out

    def documents_by(self, kind: str) -> DataFrame:
        """query_id, document_id, document_rank, document_score, sparse_rank, dense_rank, source_method."""
        got = self.one(kind, self.config.document_k, None)
        return got.select("query_id", F.col("item_id").alias("document_id"), F.col("rank").alias("document_rank"), F.col("score").alias("document_score"), "sparse_rank", "dense_rank", "source_method")

    def passages_by(self, kind: str, selected: DataFrame, reranker=None) -> DataFrame:
        """Passages of the selected documents, fused and cut: query_id, passage_id, document_id, passage_rank, passage_score, ..."""
        c = self.config
        hits = self.one(kind, c.passage_k, selected.select("query_id", "document_id")).join(self.passages.select("item_id", "document_id"), "item_id")
        hits = hits.join(selected.select("query_id", "document_id", "document_rank", "document_score"), ["query_id", "document_id"])
        hits = hits.withColumn("passage_score", F.col("score"))
        if c.fusion == "weighted_sum":
            p, d = retrieval.minmax("passage_score", "query_id"), retrieval.minmax("document_score", "query_id")
            hits = retrieval.ranked(hits.drop("rank").withColumn("score", F.round((1 - c.document_weight) * p + c.document_weight * d, 9)), c.passage_k)
        if reranker is not None:  # rows in, rows with a new rank out
            hits = reranker(self.queries, hits, self.passages)
        place = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "item_id"))
        hits = hits.withColumn("passage_rank", place).where(F.col("passage_rank") <= c.final_k)
        return hits.select("query_id", F.col("item_id").alias("passage_id"), "document_id", "passage_rank", "passage_score", "document_rank", "document_score", "sparse_rank", "dense_rank", "source_method")


def per_query(data: tables.Retrieval, documents: DataFrame, passages: DataFrame) -> DataFrame:
    """A row per judged query: graded metrics of both stages, survival of candidates, unique results. Each part has one row a query."""
    qrels = data.qrels.withColumnRenamed("passage_id", "item_id")
    owned = data.passages.select(F.col("passage_id").alias("item_id"), "document_id")
    doc_qrels = evaluation.document_qrels(qrels, owned)

    def scored(rel: DataFrame, ranks: DataFrame, prefix: str) -> DataFrame:
        out = None
        for k in (10, 5, 20, 100):
            g = evaluation.graded(rel, ranks, k).select("query_id", F.col("ndcg" if k == 10 else "recall").alias(f"{prefix}_ndcg@10" if k == 10 else f"{prefix}_recall@{k}"))
            out = g if out is None else out.join(g, "query_id")
        return out

    p = scored(qrels, passages.select("query_id", F.col("passage_id").alias("item_id"), F.col("passage_rank").alias("rank")), "passage")
    d = scored(doc_qrels.withColumnRenamed("document_id", "item_id"), documents.select("query_id", F.col("document_id").alias("item_id"), F.col("document_rank").alias("rank")), "document")
    alive = evaluation.survival(doc_qrels, documents)
    unique = passages.groupBy("query_id").agg(F.count_distinct("passage_id").alias("unique_result_count"))
    both = evaluation.one_to_one(p, d, "query_id", ("passage metrics", "document metrics"))
    both = both.join(alive, "query_id", "left").join(unique, "query_id", "left")
    return both.withColumn("candidate_survival_rate", F.coalesce("candidate_survival_rate", F.lit(0.0))).withColumn("unique_result_count", F.coalesce("unique_result_count", F.lit(0)))


def averaged(rows: DataFrame) -> DataFrame:
    """One row: the mean of every metric column, those with an @ or that end in _rate; nulls are left out."""
    return rows.agg(*[F.round(F.avg(f"`{c}`"), 6).alias(c) for c in rows.columns if "@" in c or c.endswith("_rate")])


def latencies(rows: DataFrame) -> DataFrame:
    """One row of (latency_ms): mean, median and 95th percentile."""
    return rows.agg(F.round(F.avg("latency_ms"), 6).alias("mean_query_latency_ms"), F.round(F.percentile("latency_ms", 0.5), 6).alias("p50_query_latency_ms"), F.round(F.percentile("latency_ms", 0.95), 6).alias("p95_query_latency_ms"))


def timed(data: tables.Retrieval, stages: Retrievers, kinds: tuple[str, str], reranker=None) -> DataFrame:
    """(query_id, latency_ms) of ``latency_queries`` queries in seeded order: each is run alone through both stages."""
    c = stages.config
    order = F.md5(F.concat(F.lit(f"{c.seed}:"), "query_id"))
    out = []
    for (query_id,) in data.queries.select("query_id").orderBy(order, "query_id").limit(c.latency_queries).collect():
        one = stages.only(query_id)
        began = time.perf_counter()
        documents = one.documents_by(kinds[0])
        selected = documents.sparkSession.createDataFrame(documents.collect(), documents.schema)  # document_k rows
        one.passages_by(kinds[1], selected, reranker).collect()  # final_k rows
        out.append((query_id, 1000 * (time.perf_counter() - began)))
    return data.queries.sparkSession.createDataFrame(out, "query_id string, latency_ms double")


@dataclass(frozen=True)
class Result:
    dataset: str
    method: str
    status: str
    metrics: dict = field(default_factory=dict)
    documents: DataFrame | None = None
    passages: DataFrame | None = None
    queries: DataFrame | None = None
    error: str | None = None


def run(spark: SparkSession, data: tables.Retrieval, method: str, config: Config, folder: str, retrievers: Retrievers | None = None, reranker=None, budgets: tuple | None = None) -> Result:
    """One experiment. Rankings of all queries are written below ``folder`` and read back; of a few queries the time is measured one by one."""
    config.check()
    if budgets is not None and budgets != (config.document_k, config.passage_k):
        raise validation.ConfigError("the experiment's budgets are not those of the run")
    kinds = pairs_of_methods()[method]
    stages = retrievers or Retrievers(data, config)

    def put(df: DataFrame, name: str) -> DataFrame:
        tables.write_table(df, f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    documents = put(stages.documents_by(kinds[0]), "document_rankings")
    passages = put(stages.passages_by(kinds[1], documents, reranker), "passage_rankings")
    took = put(timed(data, stages, kinds, reranker), "latency")
    rows = put(per_query(data, documents, passages).join(took, "query_id", "left"), "per_query_metrics")
    metrics = averaged(rows).head().asDict() | latencies(took).head().asDict()
    metrics["mean_unique_result_count"] = rows.agg(F.avg("unique_result_count")).head()[0]
    sizes = [storage_bytes(x).head()[0] for x in (stages.documents, stages.passages)]
    return Result(data.name, method, "completed", metrics | {"storage_bytes": sum(sizes)}, documents, passages, rows)


def run_matrix(spark: SparkSession, datasets: list[tables.Retrieval], config: Config, reranker=None) -> tuple[list[Result], str]:
    """All methods on all data sets; the results and the run's folder. A pair that fails is a result with its error."""
    folder, out = run_folder(config, commit=commit_of()), []
    for data in datasets:
        shared, broken = None, None
        try:
            data = sampled(data, config.sample, config.seed, config.split)
            validation.check(validation.retrieval_violations(data))
            shared = Retrievers(data, config)
        except Exception as error:  # a broken data set fails with all its methods
            broken = error
        for method in config.methods:
            try:
                if broken is not None:
                    raise broken
                out.append(run(spark, data, method, config, f"{folder}/{data.name}/{method}", shared, reranker))
            except Exception as error:  # the other pairs go on
                out.append(Result(data.name, method, "failed", error=f"{type(error).__name__}: {error}"[:500]))
    return out, folder


def commit_of(folder: str = ".") -> str | None:
    """The commit that ``folder`` stands on; none outside a repository."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def run_folder(config: Config, now: datetime | None = None, commit: str | None = None) -> str:
    """<output>/<name>/<mode>/<run>, a run being named by its commit, else by its UTC time."""
    run = commit[:12] if commit else (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    return f"{config.output.rstrip('/')}/{config.name}/{config.mode}/{run}"


#: Packages whose versions a run notes.
PACKAGES = ("numpy", "pandas", "pyarrow", "pyspark", "PyYAML")


def package_version(name: str) -> str | None:
    try:
        return metadata.version(name)
    except metadata.PackageNotFoundError:
        return None


def environment(spark: SparkSession) -> dict:
    """What a run depends on besides its configuration."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.session.timeZone")
    return {"python": platform.python_version(), "executable": sys.executable, "platform": platform.platform(), "spark": spark.version, "commit": commit_of(), "packages": {name: package_version(name) for name in PACKAGES}, "settings": {k: spark.conf.get(k, None) for k in keys}}


def checked(df: DataFrame, table: str) -> DataFrame:
    """``df`` if its columns are the table's, in order."""
    if df.columns != COLUMNS[table]:
        raise validation.ContractError(f"{table} has {df.columns}, not {COLUMNS[table]}")
    return df


def summary_tables(spark: SparkSession, results: list[Result], expected: list[tuple[str, str]], categories: DataFrame | None = None) -> dict[str, DataFrame]:
    """The summary tables, a row per (dataset, method); pairs of ``expected`` without a result are ``not_run``."""
    done = {(r.dataset, r.method): r for r in results}
    out = {}
    for table, columns in COLUMNS.items():
        if table == "categories":
            continue
        rows = [(d, m, done[d, m].status if (d, m) in done else "not_run", *[done[d, m].metrics.get(c) if (d, m) in done else None for c in columns[3:]]) for d, m in sorted({*expected, *done})]
        rows = [tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows]
        out[table] = checked(spark.createDataFrame(rows, "dataset string, method string, status string, " + ", ".join(f"`{c}` double" for c in columns[3:])), table)
    parts = [r.queries.crossJoin(F.broadcast(spark.createDataFrame([(r.dataset, r.method, r.status)], "dataset string, method string, status string"))) for r in results if r.queries is not None]  # one row
    if categories is not None and parts:
        both = []
        for p, r in zip(parts, [r for r in results if r.queries is not None], strict=True):
            ndcg = evaluation.by_category(r.queries, categories, "`passage_ndcg@10`").withColumnsRenamed({"n": "query_count", "mean": "passage_ndcg@10"})
            recall = evaluation.by_category(r.queries, categories, "`passage_recall@100`").select("category", F.col("mean").alias("passage_recall@100"))
            both.append(ndcg.join(recall, "category").select(F.lit(r.dataset).alias("dataset"), F.lit(r.method).alias("method"), "category", "query_count", "`passage_ndcg@10`", "`passage_recall@100`", F.lit(r.status).alias("status")))
        whole = both[0]
        for b in both[1:]:
            whole = whole.unionByName(b)
        out["categories"] = checked(whole, "categories")
    return out


def export(spark: SparkSession, results: list[Result], config: Config, folder: str, categories: DataFrame | None = None) -> list[str]:
    """Writes the summary tables as CSV, the rankings as Parquet, configuration, environment and manifest as JSON; all must exist then."""
    from .matrix import write_json

    expected = [(d, m) for d in sorted({r.dataset for r in results}) for m in config.methods]
    paths = []
    for name, df in summary_tables(spark, results, expected, categories).items():
        tables.write_table(df, f"{folder}/{name}.csv", "csv")
        paths.append(f"{folder}/{name}.csv/_SUCCESS")
    for name in ("documents", "passages", "queries"):
        parts = [getattr(r, name).withColumn("dataset", F.lit(r.dataset)).withColumn("method", F.lit(r.method)) for r in results if getattr(r, name) is not None]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        tables.write_table(whole, f"{folder}/{name}.parquet", by=("dataset", "method"))
        paths.append(f"{folder}/{name}.parquet/_SUCCESS")
    said = {"config": asdict(config), "environment": environment(spark), "manifest": {"results": [{"dataset": r.dataset, "method": r.method, "status": r.status, "error": r.error} | r.metrics for r in results]}}
    for name, value in said.items():
        write_json(spark, f"{folder}/{name}.json", json.loads(json.dumps(value, default=str)))
        paths.append(f"{folder}/{name}.json")
    if missing := [p for p in paths if not raw._exists(spark, p)]:
        raise validation.RunError(f"not written: {missing}")
    return paths
