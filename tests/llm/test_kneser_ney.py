"""The model against one of plain dictionaries, and its parts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quernwork.llm import kneser_ney as module
from quernwork.llm.kneser_ney import Totals, discounts, pack, summed, unpack
from quernwork.llm.q07_lm import run
from quernwork.sources import Tables


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [None]


def brute(rows):
    counts, pairs = Counter(), Counter()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, text in rows:
        if not held(i):
            found = tokens(text)
            counts.update(found)
            pairs.update(zip(["<s>", *found], found))
    n, v = sum(counts.values()), len(counts)
    follows, first = Counter(w for _, w in pairs), defaultdict(list)
    for (a, _), c in pairs.items():
        first[a].append(c)
    how_many = lambda values: [list(values).count(k) for k in (1, 2, 3, 4)]
    d1, d2 = discounts(how_many(follows.values())), discounts(how_many(pairs.values()))
    total = sum(follows.values())
    freed = sum(d1[min(c, 3)] for c in follows.values()) / total if total else 0

    def likely(a, w):
        c = follows[w]
        p = (c - d1[min(c, 3)]) / total + freed / (v + 1) if total else 1 / (v + 1)
        if a in first:
            s, c = sum(first[a]), pairs[a, w]
            p = (c - d2[min(c, 3)]) / s + sum(d2[min(x, 3)] for x in first[a]) / s * p
        return math.log10(p)

    out = []
    for i, text in rows:
        found = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in found)
        score = sum(likely(a, w) for a, w in zip(["<s>", *found], found))
        out.append((i, held(i), len(found), sum(counts[t] > 0 for t in found), n, base, score))
    return out


def assert_same(found, wanted):
    key = lambda r: (str(r[0]), r[2], round(r[5], 3))
    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    for a, b in zip(found, wanted):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


@pytest.mark.parametrize("hot", [0.002, 2.0])
def test_query_on_all_documents(spark, monkeypatch, hot):
    monkeypatch.setattr(module, "HOT", hot)
    monkeypatch.setattr(module, "PACK", 20_000)
    tables = Tables(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in tables.read("documents", "doc_id", "text").collect()]
    found = run(tables).collect()
    assert_same(found, brute(rows))
    held = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one():
    follows = np.array([3, 1, 2, 1, 0])
    kinds = np.array([2, 1, 1])
    totals = Totals(20, 4, 7, kinds, discounts([2, 1, 1, 1]), discounts([5, 3, 2, 1]))
    lower = totals.lower(follows)
    assert lower.sum() == pytest.approx(1)
    counts, first = np.array([4, 1, 0, 2, 0]), np.tile([7, 1, 1, 1], (5, 1))
    assert totals.upper(counts, first, lower).sum() == pytest.approx(1)


def test_packed_arrays():
    numbers = np.array([0, 1, 70_000, 2**32 - 1])
    a, b = unpack(pack(a=numbers, b=b"xyz"))
    assert module._numbers(a).tolist() == numbers.tolist() and b == b"xyz"
    keys, sums = summed(np.array([5, 1, 5], np.uint64), np.array([[1], [2], [3]]))
    assert keys.tolist() == [1, 5] and sums.tolist() == [[2], [4]]


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a B a"), (3, "w " * 90_000), (4, "a b"), (4, "a b"), (8, "É é"), (9, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS pack")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(run(Tables(spark, str(tmp_path))).collect(), brute(rows))
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(Tables(spark, f"{tmp_path}/none")).collect() == []
