"""Hard negatives against plain products, and intervals against exact scores."""

import numpy as np
import pytest

from quernwork.llm import hard_negatives as module
from quernwork.llm.hard_negatives import Anchors, Candidates, coded, encode, hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, of=5):
    kept = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, label, [int(np.floor(256.0 * x)) for x in v]))
    out = []
    for n, (i, label, q) in enumerate(kept):
        if i % of:
            continue
        scored = [
            (-sum(a * b for a, b in zip(q, v)), j, other == label)
            for m, (j, other, v) in enumerate(kept)
            if m != n
        ]
        scored.sort(key=lambda s: s[:2])
        for ps, pid, _ in [s for s in scored if s[2]][:5]:
            near = [s for s in scored if not s[2] and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:3]
            out += [(i, pid, r, nid, -ps, -ns) for r, (ns, nid, _) in enumerate(near, 1)]
    return sorted(out)


def found(spark, rows, of=5):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS uid", "2 AS length", "3 AS id")
    result = hard_negatives(coded(df, "vec_id", "label", "embedding"), f"id % {of} = 0")
    return sorted(tuple(r) for r in result.collect())


def made(seed, n, dims):
    rng = np.random.default_rng(seed)
    means = rng.normal(size=(4, dims)) + 0.8
    rows = []
    for i in range(n):
        label = 0 if i % 3 == 0 else int(rng.integers(4))
        rows.append((i, label, (means[label] + rng.normal(size=dims)).tolist()))
    return rows


@pytest.mark.parametrize("dims", [24, 70])
def test_matches_plain_code(spark, monkeypatch, dims):
    for name, small in (("ANCHORS", 50), ("CANDIDATES", 90), ("CHUNK", 32), ("PAIRS", 100)):
        monkeypatch.setattr(module, name, small)
    rows = made(1, 500, dims)
    # Copies: ties in scores, on all sides.
    rows += [(1000 + i, rows[i % 4][1], rows[i % 4][2]) for i in range(60)]
    want = brute(rows)
    assert len(want) > 300
    assert found(spark, rows) == want


def test_odd_rows(spark):
    rows = [
        (0, 1, [1.0, 2.0]), (1, 1, [1.0]), (2, 2, [0.5, 1.0]), (3, 2, []), (4, 1, None), (None, 1, [1.0, 1.0]),
        (5, None, [1.0, 1.0]), (6, 1, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (8, 2, [None, 1.0]),
        (9, 2, [0.9, 1.0]), (10, 2, [1e30, -1e30]), (15, 2, [1e30, -0.9e30]), (11, 1, [0.8e30, -1e30]),
        (20, 3, [0.0, 0.0]), (25, 3, [0.0, 0.0]), (30, 4, [-1.0, 0.0]), (35, 4, [1.0, 0.0]),
    ]
    cut = lambda s: max(-(2**63), min(2**63 - 1, s))
    got = found(spark, rows)
    small = [r for r in rows if not r[2] or len(r[2]) < 2 or r[2][0] is None or not abs(r[2][0]) > 1e20]
    assert found(spark, small) == brute(small)
    # A positive's score beyond a long is cut, and its range with it.
    assert all(r[4] == cut(r[4]) and r[5] == cut(r[5]) for r in got)
    assert found(spark, rows[:1]) == []
    assert found(spark, []) == []


def test_rows_of_one_id_are_rows_of_their_own(spark):
    rows = [(0, 1, [1.0, 1.0]), (0, 1, [1.0, 1.0]), (0, 2, [0.9, 0.9]), (1, 2, [0.7, 0.8])]
    assert found(spark, rows) == brute(rows)


def test_intervals_hold_the_score():
    rng = np.random.default_rng(5)
    for dims in (1, 3, 64, 100):
        whole = np.floor(256 * rng.normal(size=(300, dims)) * rng.exponential(size=(300, 1)))
        whole[7] = 0
        codes, alignments, rest = encode(whole)
        lengths = np.sqrt((whole**2).sum(axis=1))
        rows = [
            (i, i, 1, whole[i].tobytes(), lengths[i], codes[i].tobytes(), alignments[i].tobytes(), rest[i])
            for i in range(300)
        ]
        anchors = Anchors([(*r, None) for r in rows[:50]], 5, (0, 0))
        lower, upper = anchors.interval(np.arange(50), Candidates(rows))
        exact = whole[:50] @ whole.T
        assert (lower <= exact).all() and (exact <= upper).all()


def test_most_candidates_are_not_scored():
    rng = np.random.default_rng(6)
    means = rng.normal(size=(10, 64))
    labels = rng.integers(10, size=4000)
    whole = np.floor(64 * (means[labels] + rng.normal(size=(4000, 64))))
    codes, alignments, rest = encode(whole)
    lengths = np.sqrt((whole**2).sum(axis=1))
    rows = [
        (i, i, 1, whole[i].tobytes(), lengths[i], codes[i].tobytes(), alignments[i].tobytes(), rest[i])
        for i in range(4000)
    ]
    anchors = Anchors([(*r, None) for r in rows[:20]], 5, (0, 0))
    scored = sum(anchors.scan(Candidates(rows[i : i + 256]), True) for i in range(0, 4000, 256))
    assert scored < 0.25 * 20 * 4000
