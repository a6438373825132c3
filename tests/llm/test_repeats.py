"""Removed strings against a plain pass over all of them."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quernwork.llm import repeats as module
from quernwork.llm.anchors import SPAN, WINDOW, runs
from quernwork.llm.bwt import Shard, interleave
from quernwork.llm.q04_repeats import run
from quernwork.sources import Tables


def brute(rows):
    order = sorted(
        range(len(rows)),
        key=lambda i: (rows[i][0] is None, rows[i][0] or 0, xxhash.xxh64_intdigest((rows[i][1] or "").encode()) & 0xFFFF),
    )
    seen, out, whole = set(), [], set()
    for i in order:
        id_, text = rows[i]
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        again = (id_, data) in whole
        whole.add((id_, data))
        for at in range(len(data) - 99):
            string = data[at : at + 100]
            if string in seen or again:
                gone[at : at + 100] = True
            seen.add(string)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((id_, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS place", "2 AS kept")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, run(Tables(spark, str(tmp_path))).collect()), key=str)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=100, max_size=700) | st.text("ab", min_size=100, max_size=700).map(str.encode))
def test_equal_windows_have_equal_anchors(data):
    anchor, first, count, several = runs(np.frombuffer(data + data[:150], np.uint8))
    assert count.max() <= SPAN and count.sum() == len(data) + min(150, len(data)) - 99
    data += data[:150]
    at, repeated = {}, {}
    for i, (a, f, c) in enumerate(zip(anchor.tolist(), first.tolist(), count.tolist())):
        for w in range(f, f + c):
            string = data[w : w + WINDOW]
            assert at.setdefault(string, a) == a
            if repeated.setdefault((i, string), w) != w:
                assert several[i]


def test_interleave_is_the_order_of_all_suffixes():
    rnd = random.Random(4)
    pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 60))) for _ in range(30)]
    shards = [Shard(pieces[i : i + 8]) for i in range(0, 30, 8)]
    merged, interval = interleave(shards, 20)
    rings = [s.text.tobytes() for s in shards]
    suffixes = [(ring * 9)[i : i + 20] for ring in rings for i in range(len(ring))]
    ordered = [suffixes[i] for i in merged]
    assert ordered == sorted(suffixes)
    for a, b, x, y in zip(ordered, ordered[1:], interval, interval[1:]):
        assert (a == b) == (x == y)


@pytest.mark.parametrize("large", [20_000, 3])
def test_made_up_texts(spark, monkeypatch, tmp_path, large):
    monkeypatch.setattr(module, "LARGE", large)
    monkeypatch.setattr(module, "MERGED", 5000)
    monkeypatch.setattr(module, "SHARD", 1500)
    monkeypatch.setattr(module, "REMEMBERED", 40)
    monkeypatch.setattr(module, "SMALL_ROWS", 30)
    rnd = random.Random(large)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randrange(15, 60))) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(word() for _ in range(30)) for _ in range(5)]
        rows.append((i * 37 % 151, " ".join(parts)))
    rows += [(900 + i, rows[3][1]) for i in range(5)] + [(905, rows[4][1][50:400] * 3), (906, "ab" * 300), (907, "x" * 99)]
    assert found(spark, rows, tmp_path) == brute(rows)


def test_query_on_all_documents(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in tables.read("documents", "doc_id", "text").collect()]
    assert sorted(map(tuple, run(tables).collect()), key=str) == brute(rows)


def test_odd_rows(spark, tmp_path):
    long = " ".join(map(str, range(20_000)))
    rows = [(5, None), (3, ""), (None, "q" * 150), (None, "q" * 150), (9, "z" * 230), (9, "z" * 230), (9, "y" * 120)]
    rows += [(1, long), (2, long[1000:3000])]
    assert found(spark, rows, tmp_path) == brute(rows)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(Tables(spark, f"{tmp_path}/none")).collect() == []
