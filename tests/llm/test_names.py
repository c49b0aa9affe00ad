"""Texts built to share a polynomial hash modulo a power of two; very long items; budgets that only an exchange meets."""

import hashlib
import random
import tracemalloc

import numpy as np
import pytest

from textloom.llm import bytehash, decontaminate, mixing, ngram_join, substring_dedup, suffix_dedup

from .test_operators import frame


def morse(n, one="a", two="b"):
    """The Thue-Morse sequence and its complement: sums of odd powers modulo 2**64 cannot tell them apart from 1,024 on."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [one if b else two for b in bits], [two if b else one for b in bits]


X, Y = ("".join(w) for w in morse(1024))


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 8192])
def test_names_tell_them_apart(n):
    buf = np.frombuffer("".join(sum(morse(n), [])).encode(), np.uint8)
    one, two = bytehash.names(bytehash.prefix(buf), np.array([0, n]), np.array([n, 2 * n])).tolist()
    assert one != two
    units = bytehash.mix(buf.astype(np.uint64))
    one, two = bytehash.names(bytehash.prefix_of(units), np.array([0, n]), np.array([n, 2 * n])).tolist()
    assert one != two


def test_names_hang_on_the_range_only():
    rng = np.random.Generator(np.random.PCG64(3))
    buf = rng.integers(0, 256, 50_000).astype(np.uint8)
    s = rng.integers(0, 40_000, 300)
    e = s + rng.integers(0, 10_000, 300)
    a = bytehash.names(bytehash.prefix(buf), s, e)
    b = bytehash.names(bytehash.prefix(np.concatenate([buf[::-1][:333], buf])), s + 333, e + 333)
    assert (a == b).all()
    assert len({(x.tobytes()) for x in (buf[i:j] for i, j in zip(s, e, strict=True))}) == len(set(a.tolist()))


def test_shingles(spark):
    rows = [(1, f"one two {X}"), (2, f"one two {Y}"), (3, f"one two {X}")]
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.join(frame(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def brute(rows, width, units, join):
    """Per text: units, units removed, runs removed and the digest of the rest; a window counts from a smaller doc_id or, for bytes, an earlier place."""
    own_too, seen, out = join == b"", {}, {}
    for i, t in rows:
        u, fresh = units(t), []
        gone = np.zeros(len(u), bool)
        for s in range(len(u) - width + 1):
            g = tuple(u[s : s + width])
            if g in seen:
                gone[s : s + width] = True
            (seen.setdefault(g, i) if own_too else fresh.append(g))
        seen.update(dict.fromkeys(fresh))
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[i] = (len(u), int(gone.sum()), runs, hashlib.sha256(join.join(bytes([x]) if own_too else x.encode() for x, g in zip(u, gone, strict=True) if not g)).hexdigest())
    return out


def built():
    same = ["w"] * 12
    one, two = (" ".join(w) for w in morse(1024, "ant", "bee"))
    return [(1, " ".join([*same, X])), (2, " ".join([*same, Y])), (3, one), (4, two), (5, one), (6, f"{Y} {X}"), (7, "lead " * 3000 + two[:4000] + " tail" * 3000)]


def test_windows_of_words(spark):
    want = brute(built(), 13, str.split, b" ")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.cut(frame(spark, built())).collect()}
    assert got == {i: (n, k, sha) for i, (n, k, _, sha) in want.items()}
    assert got[2][1] == 0


def test_windows_of_bytes(spark):
    want = brute(built(), 100, str.encode, b"")
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.cut(frame(spark, built())).collect()} == want


def test_items(spark):
    lead = " ".join(f"q{i}" for i in range(6))
    bench = spark.createDataFrame([(1, f"{lead} {X}"), (2, f"{lead} {Y}")], "item_id long, text string")
    rows = decontaminate.contaminated(frame(spark, [(1, f"x {lead} {X}"), (2, f"x {lead} {Y}")]), bench).collect()
    assert {(r["doc_id"], r["item_id"]): r["distance"] for r in rows} == {(1, 1): 0, (2, 2): 0, (1, 2): 1, (2, 1): 1}


def test_parts_of_long_items():
    for n in (1, 256, 257, 600, 5000):
        parts = decontaminate.parts_of(n)
        assert [a for a, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))] and sum(k for _, k in parts) == n
        assert max(k for _, k in parts) <= decontaminate.PART and sum(decontaminate.most_of(k) for _, k in parts) <= decontaminate.DISTANCE * n
        # whatever edits of the whole are allowed, one part has no more than a part may have
        assert decontaminate.most_of(n) < sum(decontaminate.most_of(k) + 1 for _, k in parts)


def test_long_items_in_bounded_memory(spark):
    """Items of 700 and 5,000 words: whole, edited all over as much as allowed, cut off at a text's end."""
    rng = random.Random(9)
    items = [[f"q{rng.randrange(10**6)}" for _ in range(n)] for n in (700, 5000)]
    rows, want = [], {}
    for i, item in enumerate(items):
        k = len(item) // 5
        at = set(rng.sample(range(len(item)), k))
        near = [f"e{rng.randrange(10**6)}" if x in at else w for x, w in enumerate(item)]
        far = [f"e{rng.randrange(10**6)}" if x in at or x % 9 == 0 else w for x, w in enumerate(item)]
        for words, d in ((item, 0), (near, k), (item[k:], k), (item[: len(item) - k], k), (far, None)):
            if d is not None:
                want[len(rows), i] = d
            rows.append((len(rows), " ".join(["lead"] * 30 + words + ["tail"] * 30)))
        want[len(rows), i] = 0
        rows.append((len(rows), " ".join(item)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["distance"], r["first_word"], r["n_words"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert {k: d for k, (d, _, _) in got.items()} == want
    assert all(n == len(items[i]) for (_, i), (_, _, n) in got.items()) and got[0, 0][1] == got[6, 1][1] == 30
    tracemalloc.start()
    found = decontaminate.Items([0], [" ".join(items[1])])
    text = " ".join(["lead"] * 3000 + items[1] + ["tail"] * 3000).encode()
    buf = np.frombuffer(text, np.uint8)
    _, _, h, at = bytehash.words(buf, np.array([0, len(buf)]), lower=True, alnum=True)
    assert list(found.find([(np.array([4]), h, at)])) == [(4, 0, 3000, 0, 5000)]
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


@pytest.mark.parametrize("lengths, counts, budget", [([7, 1000], [2, 10_000], 6_000_000), ([501, 1000], [3, 10_000], 6_000_000), (range(20_000, 20_100), [20] * 100, 20_000_017), ([3, 10**9], [10**6, 4], 2 * 10**9 + 2_999_997), ([6, 10, 15], [10**9] * 3, 10**10 + 1)])
def test_budgets_that_an_exchange_meets(lengths, counts, budget):
    taken = mixing.fit(list(lengths), list(counts), budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == budget


def test_fits_against_all_sums():
    """Nearest below the budget where the programme's states hold all sums of a source."""
    rng = random.Random(12)
    for _ in range(200):
        lengths = rng.sample(range(1, 90), rng.randint(1, 6))
        counts = [rng.randint(1, 9) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rng.randint(0, max(sums))
        taken = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(s for s in sums if s <= budget)
