"""Paths that the main fixtures do not reach: caps that are gone, hot groups, clashing names, the pipeline."""

import random
import re
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, mixing, ngram_join, repeats, secret_scan, suffix_dedup, toxicity
from textloom.llm.common import clear, settle, unused

from .test_operators import frame


@pytest.mark.parametrize(
    "lengths, counts, budget",
    [
        ([3, 70_000, 90_000, 110_000], [1, 9, 9, 9], 430_000),
        ([1, *range(40_000, 41_000, 2)], [1] * 501, 10_124_751),
        (list(range(100, 20_000, 7)), [1] * len(range(100, 20_000, 7)), 123_457),
        ([0, 5, 5000], [10, 3, 1_000_000], 5000 * 654_321 + 10),
    ],
)
def test_budgets_with_an_exact_fit(lengths, counts, budget):
    taken = mixing.fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts))
    assert sum(n * t for n, t in zip(lengths, taken)) == budget


def test_small_budgets_against_all_sums():
    rng = random.Random(5)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 6))
        counts = [rng.randint(1, 3) for _ in lengths]
        budget = rng.randint(0, 150)
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        taken = mixing.fit(lengths, counts, budget)
        assert sum(n * t for n, t in zip(lengths, taken)) == max(s for s in sums if s <= budget)


def test_removed_rows_pass_at_once():
    def removed(n):
        for i in range(n):
            seen.append(i)
            yield repeats.run_batch(*[np.full(3, i, np.int64) for _ in range(5)], 1)

    seen = []
    out = repeats.grouped(True, True)(removed(200))
    next(out)
    assert len(seen) == 1


def test_pieces_are_bounded():
    parts = ((np.arange(1000) + i, *[np.arange(1000)] * 4) for i in range(2000))
    with mock.patch.object(repeats, "PIECE", 5000):
        assert max(b.num_rows for b in repeats.in_pieces(parts, False)) <= 6000


def _jaccard(a, b):
    return 100 * len(a & b) >= 90 * len(a | b)


def test_all_lists_and_anchors_hot(spark):
    """However rows are dealt, results are the same."""
    rng = random.Random(9)
    base = [rng.choices([f"v{i}" for i in range(400)], k=80) for _ in range(12)]
    texts = []
    for w in base:
        for _ in range(5):
            v = list(w)
            v[rng.randrange(80)] = "other"
            texts.append(" ".join(v))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").cache()
    all_hot = lambda sample, n: sample.select(F.col("key").alias("hot_key")).distinct()
    sets = [{tuple(t.split()[i : i + 3]) for i in range(78)} for t in texts]
    comp = list(range(len(texts)))
    for _ in texts:
        comp = [min(comp[j] for j in range(len(texts)) if _jaccard(sets[i], sets[j])) for i in range(len(texts))]
    with mock.patch.object(ngram_join, "hot_keys", all_hot), mock.patch.object(ngram_join, "BLOCK_ROWS", 2):
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs).collect()}
    assert got == dict(enumerate(comp))
    plain = {r["doc_id"]: r for r in suffix_dedup.cut(docs).collect()}
    with mock.patch.object(repeats, "hot_keys", all_hot):
        assert {r["doc_id"]: r for r in suffix_dedup.cut(docs).collect()} == plain


def test_names_that_clash(spark):
    rows = [(1, "the password: hunter22 is here and here again", "x", "y", "z"), (2, "the password: hunter22 is here and here again", "x", "y", "z"), (None, None, None, None, None)]
    names = "doc_id long, text string, {} string, {} string, {} string"
    bench = spark.createDataFrame([(7, "password hunter22 is here and here")], "item_id long, text string")
    kept = ngram_join.keep_one(spark.createDataFrame(rows, names.format("doc", "component", "sig")), 5, 80)
    assert kept.columns == ["doc_id", "text", "doc", "component", "sig"] and sorted(r[0] or 0 for r in kept.collect()) == [0, 1]
    clean = decontaminate.drop_contaminated(spark.createDataFrame(rows, names.format("found_doc", "item_id", "distance")), bench)
    assert [r[0] for r in clean.collect()] == [None]
    masked = secret_scan.redact(spark.createDataFrame(rows, names.format("own_blob", "found_blob", "found_spans"))).collect()
    assert len(masked) == 3 and {tuple(r)[2:] for r in masked} == {("x", "y", "z"), (None, None, None)}
    assert {r[1] for r in masked} == {"the [secret] is here and here again", None}
    assert unused(clean, "FOUND_DOC") == "FOUND_DOC_"


def test_ledger_entries_that_stand_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token=abcdefgh"), (2, "nothing")], "doc_id long, text string")
    ledger = f"file://{tmp_path}/ledger"
    secret_scan.scan(docs, ledger)
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "2")
    spark.read.parquet(ledger).write.mode("append").parquet(ledger + "2")
    got = secret_scan.scan(docs, ledger + "2").collect()
    assert sorted((r["doc_id"], len(r["spans"])) for r in got) == [(1, 1), (2, 0)]
    more = docs.union(spark.createDataFrame([(3, "secret: zzzzzzzz")], docs.schema))
    assert sorted((r["doc_id"], len(r["spans"])) for r in secret_scan.scan(more, ledger + "2").collect()) == [(1, 1), (2, 0), (3, 1)]


@pytest.mark.parametrize("n", [10, 40, 100])
@pytest.mark.parametrize("kind", decontaminate.KINDS)
def test_recall_at_the_full_distance(n, kind):
    walks = decontaminate.repeats(n)
    assert (decontaminate.first_hits(n, kind, walks, 100, seed=3) <= walks).mean() >= 0.9


def _edits(a, b):
    row = [0] * (len(b) + 1)  # any start in b
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_every_stretch(spark):
    rng = random.Random(2)
    word = lambda k: [f"b{rng.randrange(900)}" for _ in range(k)]
    items = [word(k) for k in (6, 12, 25, 40)]
    docs = []
    for it in items:
        for edits in (0, 1, len(it) // 10, int(len(it) * 0.2)):
            w = list(it)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "q"
            docs += [" ".join(word(30) + w + word(30)), " ".join(w), " ".join(w[:-1] + word(20))]
    docs += [" ".join(word(50)) for _ in range(20)] + ["", "a"]
    got = decontaminate.contaminated(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in got.collect()}
    want = {(d, i): _edits(t, docs[d].split()) for d in range(len(docs)) for i, t in enumerate(items)}
    want = {k: v for k, v in want.items() if v <= int(0.2 * len(items[k[1]]))}
    assert got.keys() <= want.keys() and len(got) >= 0.9 * len(want)
    assert all(want[k] == v for k, v in got.items())


def test_without_labels_nothing_is_toxic(spark):
    docs = frame(spark, [(1, "some words"), (2, None)])
    for marks in ([], [(9, 1), (1, None)]):  # none, or of no document that is there
        model = toxicity.learn(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert {r["predicted"] for r in toxicity.score(docs, *model).collect()} == {0} and toxicity.reject(docs, *model).count() == 2


def test_toxic_weights_against_a_plain_scan():
    lexicon = {"fool": 2.0, "idio*": 3.0, "can": 1.0, "trash": 1.5}
    found = toxicity.automaton(lexicon)

    def plain(text):
        low, total = toxicity.fold(text), 0.0
        spared = [(m.start(), m.end()) for p in toxicity.EXCEPTIONS for m in re.finditer(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", low)]
        for m in re.finditer(r"[^\W_]+", low):
            if not any(a <= m.start() < b for a, b in spared):
                total += max([w for k, w in lexicon.items() if (k == m.group() if k[-1] != "*" else m.group().startswith(k[:-1]) and len(m.group()) >= len(k))], default=0.0)
        return total / np.log(len(low) + 20.0)

    for text in ["you f00l", "an idiot, IDI0T and ідіоt idio", "a trash can and trash. can", "", "class clown fool " * 3000, "foolish fool_s"]:
        assert toxicity.weigh(found, text) == pytest.approx(plain(text)), text[:40]


def test_settled_tables_go(spark):
    df = settle(spark.range(3))
    assert df.count() == 3 and clear(spark) >= 1


@pytest.fixture(scope="module")
def small_corpus(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"n{i}" for i in range(500)]
    rows, labels, bench = [], [], [(i, " ".join(rng.choices(words, k=30))) for i in range(4)]
    for i in range(240):
        w = rng.choices(words, k=rng.randint(30, 90))
        toxic = i % 6 == 0
        if toxic:
            for bad in ("filthy", "moron", "scum"):
                w[rng.randrange(len(w))] = bad
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    for k, i in enumerate((5, 7, 11, 13)):
        rows.append((300 + k, rows[i][1] + " tail"))  # near copies
        rows.append((310 + k, " ".join(rng.choices(words, k=9)) + " " + bench[k][1]))
    rows += [(320, "my password = swordfish9 " + " ".join(rng.choices(words, k=40))), (321, None), (322, ""), (321, None)]
    folder = tmp_path_factory.mktemp("sf")
    docs = [(i, t, "en", "src" + str((i or 0) % 3), None if t is None else len(t)) for i, t in rows]
    for name, data, schema in (("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"file://{folder}/{name}.parquet")
    return f"file://{folder}", rows, bench


def test_pipeline_against_plain_stages(spark, small_corpus):
    sf, rows, bench = small_corpus
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = re.compile(r"\b(?:filthy|moron|scum)\b")
    clean = [(i, t) for i, t in rows if not bad.search(t or "")]
    one = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(i for i, _ in clean)
    sets = {}
    for i, t in clean:
        w = (t or "").split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                comp[i] = min(comp[i], comp[j])
    kept = [(i, t) for i, t in clean if comp[i] == i]
    kept = [(i, t) for i, t in kept if not any(it in (t or "") for _, it in bench)]
    masked = {i: None if t is None else t.replace("password = swordfish9", "[secret]") for i, t in kept}
    stages, at = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = settle(stage(spark, at, sf))
        stages[name] = at
        assert sorted(at.columns) == sorted(docs.columns)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stages["secrets"].collect()}
    assert {i: t for i, (t, _) in got.items()} == masked
    assert all(n == (None if t is None else len(t)) for t, n in got.values())
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(i for i, _ in kept)
    sizes = {i: len((t or "").split()) for i, t in masked.items()}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in out)
    for s in {r["source"] for r in out}:
        mine = [r for r in out if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2


def test_pipeline_of_nothing(spark, small_corpus):
    sf, *_ = small_corpus
    at = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        at = settle(stage(spark, at, sf))
    assert at.count() == 0


def test_long_sets_are_ruled_out_by_wide_sketches():
    """Pairs of long sets that share little are dropped before their sets are moved (F1); linked ones never are."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    one, two = draw(6000), draw(6000)
    near = np.unique(np.concatenate([one[:-500], draw(500)]))
    larger = np.unique(np.concatenate([one, draw(1200)]))  # its sketch is as wide again, when it has over 2^13 shingles
    widest = np.unique(np.concatenate([draw(8000)[:7900], draw(1000)]))
    less = widest[:8000]
    sets = [one, two, near, larger, widest, less]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    names = np.concatenate(sets)
    narrow, wide = ngram_join.sketches(names, at), ngram_join.wide_sketches(names, at)
    assert len(wide[4]) == 2 * len(wide[5])

    def left(a, b):
        cols = [pa.array([x]) for x in (a, b, len(sets[a]), len(sets[b]), narrow[a], narrow[b], wide[a], wide[b])]
        batch = pa.RecordBatch.from_arrays(cols, names=["a", "b", "a_size", "b_size", "a_sketch", "b_sketch", "a_wide", "b_wide"])
        return sum(x.num_rows for x in ngram_join.near_sketches(80)(iter([batch])))

    assert not left(0, 1) and left(0, 2) and left(0, 3) and left(4, 5)
    for a in range(6):
        for b in range(a):
            assert ngram_join.wide_apart(wide[a], wide[b]) <= len(np.setxor1d(sets[a], sets[b]))


def test_lists_in_turns(spark, monkeypatch):
    """The lists of all turns together give the components that one turn gives (F1), and the texts are not shuffled at the end."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i % 7 * 40 : i % 7 * 40 + 60] + ([f"x{i}"] if i % 3 else []))) for i in range(60)] + [(7, "other words here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = sorted(map(tuple, ngram_join.join(docs, 3, 80).select("doc_id", "component_id").collect()), key=str)
    kept = ngram_join.keep_one(docs, 3, 80)
    assert "Exchange hashpartitioning(doc_id" not in kept._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ngram_join, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(ngram_join, "TURNS", 3)
    assert sorted(map(tuple, ngram_join.join(docs, 3, 80).select("doc_id", "component_id").collect()), key=str) == once
    assert {r[0] for r in kept.select("doc_id").collect()} == {d for d, c in once if d == c or d is None}
