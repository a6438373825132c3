"""Mixing against plain Python, and against its SQL."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quernwork.llm import mixing as module
from quernwork.llm.mixing import mix, random_key
from quernwork.llm.q10_mixing import SQL, run
from quernwork.sources import Tables
from tests.oracle import assert_same


def key(*values):
    parts = ["-" if v is None else f"={v}" for v in values]
    return hashlib.md5(":".join(parts).encode()).hexdigest()


def brute(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), key(i, t)) for i, t, s in rows]
    sources = sorted({r[1] for r in sized}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(r[2] for r in sized if r[1] == s) for s in sources}
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sources)}
    left, open_, target = 1.5 * sum(total.values()), set(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * total[s] <= weight[s] * level}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s], left = 2.0 * total[s], left - 2 * total[s]
        open_ -= full
    out = []
    for s in sources:
        budget = int(target[s] + 0.5)
        whole, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for i, _, n, k in sorted((r for r in sized if r[1] == s), key=lambda r: r[3]):
            part = max(0, min(n, rest))
            rest -= n
            out.append((i, n, total[s], target[s], whole * n + part))
    return out


def assert_mixed(found, rows):
    order = lambda r: (str(r[0]), r[1], r[4])
    found, wanted = sorted(map(tuple, found), key=order), sorted(brute(rows), key=order)
    assert [(*r[:3], r[4]) for r in found] == [(*r[:3], r[4]) for r in wanted]
    assert [r[3] for r in found] == pytest.approx([r[3] for r in wanted])
    assert all(r[4] <= 2 * r[1] for r in found)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, scale):
    folder = f"/root/testdata/{scale}"
    assert_same(run(Tables(spark, folder)), folder, SQL)


def test_budgets_are_met_and_reruns_agree(spark):
    tables = Tables(spark, "/root/testdata/sf0.01")
    found = run(tables)
    by = found.groupBy("source_size", "target").agg(F.sum("taken").alias("n"))
    assert all(abs(r["n"] - r["target"]) <= 0.5 or r["n"] % round(r["target"]) == 0 for r in by.collect())
    assert sorted(found.collect()) == sorted(run(tables).collect())


def test_skewed_sources_and_extra_columns(spark, tmp_path):
    rnd = random.Random(5)
    sources = ["big"] * 200 + ["é", "Z", "a", "b", None, "one", ""] * 3
    rows = [(i, "w " * rnd.randrange(60), s) for i, s in enumerate(sources)] + [(900, "x " * 5000, "lone")]
    rows += [(901, None, "empty"), (None, "a b", None), (None, None, "b"), (7, "same", "big"), (7, "same", "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = df.selectExpr("*", "1 AS taken", "2 AS size", "3 AS key_range", "4 AS weight")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert_mixed(run(Tables(spark, str(tmp_path))).collect(), rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(Tables(spark, f"{tmp_path}/none")).collect() == []


def test_keys_tell_nulls_from_empty_texts(spark):
    rows = [(None, None), (None, ""), (1, ""), (1, None), (1, "-")]
    df = spark.createDataFrame(rows, "a long, b string")
    found = [r[0] for r in df.select(random_key(F.col("a"), F.col("b"))).collect()]
    assert found == [key(*r) for r in rows] and len(set(found)) == 5


def test_columns_called_as_the_helpers(spark):
    df = spark.createDataFrame([("s", 4, "0a", 1, 2)], "source string, size long, key string, source_key int, range_start int")
    assert mix(df, "source", "size", "key").select("source_key", "range_start", "taken").first() == (1, 2, 6)


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "RANGE_ROWS", 5)
    df = spark.range(400).selectExpr("id", "'s' AS source", "1L AS size", "md5(cast(id AS string)) AS key")
    found = mix(df, "source", "size", "key").agg({"taken": "sum"}).first()[0]
    assert found == 600
