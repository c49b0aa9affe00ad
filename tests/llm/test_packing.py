"""Packing against plain tokenising and plain first fit; every id lies in exactly one piece."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a<|endoftext|>b", "é漢字    x", "tab\tand\r\nline \n\n  two  spaces ", "don't it's we'LL 1234 ++--", "z" * 9000, " " * 5000, "�\U0001f600" * 700]


def rows():
    rng = random.Random(2)
    out = [(i, t) for i, t in enumerate(ODD)]
    for i in range(300):
        out.append((100 + i, " ".join(rng.choice(["alpha", "Beta", "gamma,", "δέλτα", "7", "x"]) for _ in range(int(rng.paretovariate(0.9) * 40) % 9000))))
    return out + out[20:24] + [(None, None), (None, "no id")] + [(5, "the same id") for _ in range(20)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, b"") for i, t in rows], "doc_id long, text string, row string, start int, ids binary")


def test_encoder_finds_the_tokenizers_ids():
    found = packing.encoder(PATH)
    assert found.fast is not None
    for text in [*ODD, *(t for _, t in rows()[len(ODD) : 80])]:
        assert found.ids(text).tolist() == found.whole.encode(text, add_special_tokens=False).ids
    other = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))  # word ends and lower case: left to its library
    assert other.fast is None and other.ids("Some Words").tolist() == other.whole.encode("Some Words", add_special_tokens=False).ids


def test_runs_are_cut_where_no_token_reaches_across():
    found, rng = packing.encoder(PATH), random.Random(8)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b ", " ", "\n", " c", "'s", "1", " ", "é"]) for _ in range(200))
        parts = list(packing.runs(text, 7))
        assert "".join(parts) == text
        assert [i for p in parts for i in found.fast.encode_ordinary(p)] == found.fast.encode_ordinary(text)


def test_first_fit_decreasing_against_a_plain_one():
    rng = random.Random(4)
    for n in (0, 1, 2, 50, 400):
        sizes = [rng.choice([rng.randint(1, 100), 50, 34]) for _ in range(n)]
        plain, room = [], []
        for item in sorted(range(n), key=lambda i: -sizes[i]):
            at = next((b for b, r in enumerate(room) if r >= sizes[item]), len(room))
            if at == len(room):
                plain.append([])
                room.append(100)
            plain[at].append(item)
            room[at] -= sizes[item]
        assert packing.first_fit_decreasing(sizes, 100) == plain


@pytest.mark.parametrize("group_bytes", [10**9, 3000], ids=["one group", "groups"])
def test_every_id_in_one_piece_and_nothing_padded(spark, group_bytes):
    given = rows()
    want = Counter()
    for i, t in given:
        ids = [*packing.encoder(PATH).whole.encode(t or "", add_special_tokens=False).ids, 1]
        for at, x in enumerate(ids):
            want[i, len(ids), at, x] += 1
    pieces = packing.pack(frame(spark, given), PATH, group_bytes=group_bytes)
    got, bins = Counter(), defaultdict(list)
    for p in pieces.collect():
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        for k, x in enumerate(ids):
            got[p["doc_id"], p["doc_tokens"], p["start"] + k, x] += 1
        bins[p["sequence_id"]].append((p["offset"], p["length"]))
    assert got == want
    short = 0
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
        short += at < 2048
    assert short <= 11 * max(1, -(-sum(len((t or "").encode()) for _, t in given) // group_bytes))
    if group_bytes == 10**9:
        whole = packing.sequences(pieces).collect()
        assert sum(len(r["ids"]) for r in whole) == 4 * sum(want.values()) and all(sum(r["lengths"]) * 4 == len(r["ids"]) and len(r["doc_ids"]) == len(r["lengths"]) for r in whole)


def test_most_documents_stay_whole(spark):
    pieces = packing.pack(frame(spark, [(i, "word " * (5 + i % 700)) for i in range(800)]), PATH)
    cut = pieces.groupBy("doc_id").count().where("count > 1").count()
    assert cut <= 40


def test_query_and_empty_table(spark, tmp_path):
    given = rows()[:60]
    frame(spark, given).write.parquet(str(tmp_path / "documents.parquet"))
    crc = {}
    for i, t in given:
        crc[i] = np.array([*packing.encoder(PATH).whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    got = packing.op11_packing(spark, str(tmp_path)).collect()
    assert all(r["ids_crc32"] == zlib.crc32(crc[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in got)
    assert packing.pack(frame(spark, []), PATH).collect() == []
