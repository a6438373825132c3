"""Exact search against plain products."""

import numpy as np

from quernwork.llm import topk
from quernwork.llm.topk import top_inner_products, whole_vectors


def brute(rows, k, of=2):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        kept.append((i, [int(np.floor(256.0 * x)) for x in v]))
    out = []
    for i, q in kept:
        if i % of == 0:
            scores = [(-sum(a * b for a, b in zip(q, v)), j) for j, v in kept if j != i]
            for rank, (s, j) in enumerate(sorted(scores)[:k], 1):
                out.append((i, rank, j, max(-(2**63), min(2**63 - 1, -s))))
    return sorted(out)


def found(spark, rows, k, of=2):
    df = spark.createDataFrame(rows, "id long, v array<double>").selectExpr(
        "id AS vec_id", "v AS embedding", "1 AS length", "2 AS vector"
    )
    vectors = whole_vectors(df, "vec_id", "embedding")
    result = top_inner_products(vectors, vectors.where(f"id % {of} = 0"), k)
    return sorted(tuple(r) for r in result.collect())


def test_matches_brute_force(spark, monkeypatch):
    # Small blocks, so that scans stop and several blocks meet.
    monkeypatch.setattr(topk, "QUERIES", 50)
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=24) * rng.exponential() * np.linspace(2, 0.01, 24)).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[i % 3][1]) for i in range(40)]
    assert found(spark, rows, 5) == brute(rows, 5)


def test_odd_rows(spark):
    rows = [
        (2, [1.0, 2.0]),
        (4, [1.0]),
        (5, []),
        (6, None),
        (None, [1.0, 1.0]),
        (8, [float("nan"), 1.0]),
        (10, [float("inf"), 1.0]),
        (12, [None, 1.0]),
        (13, [1e30, -1e30]),
        (14, [-1e30, 1e30]),
        (15, [1.0, 2.0]),
        (16, [0.0, 0.0]),
    ]
    assert found(spark, rows, 3) == brute(rows, 3)
    assert found(spark, rows[:1], 3) == []
    assert found(spark, [], 3) == []


def test_slots_follow_the_candidates(spark, monkeypatch):
    """What tasks give on grows with queries and candidates, not with partitions."""
    monkeypatch.setattr(topk, "SLOT", 100)
    rows = [(i, [float(i % 17), float(i % 5)]) for i in range(950)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = whole_vectors(df, "vec_id", "embedding")
    seen, search = [], topk._search

    def kept(batches, **known):
        for batch in search(batches, **known):
            yield batch

    monkeypatch.setattr(topk, "partitions", lambda spark: seen.append(1) or 64)
    found = top_inner_products(vectors, vectors.where("id % 50 = 0"))
    # 19 queries, 10 slots of some 95 candidates, 5 rows each; then 5 of each query.
    assert found.count() == 19 * 5
    assert len(seen) == 1
