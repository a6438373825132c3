"""Fingerprints against a plain parser and plain neighbours."""

import hashlib

import pytest
from pyspark.sql import functions as F

from quernwork.llm.lz_fingerprint import Phrases, compare_neighbours, fingerprint, likeness, signature
from quernwork.llm.q05_fingerprints import run
from quernwork.sources import Tables


def phrases(text):
    """The phrase set by slices."""
    seen, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            start = end
    return seen


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for n, (id_, text) in enumerate(rows):
        following = rows[(n + 1) % len(rows)][1]
        cut = len(text) // 2
        edited = text[: len(text) - cut] + following[:cut]
        one, two, three = signature(text), signature(edited), signature(following)
        out.append(
            (id_, len(text), hashlib.sha256(edited.encode()).hexdigest(), one.hex(), two.hex())
            + (likeness(one, two), likeness(one, three))
        )
    return sorted(out, key=str)


def test_parser_finds_the_phrases():
    text = "abababc aabbc " * 50 + "ééé"
    parser = Phrases()
    parser.feed(text[:100])
    copy = parser.copy()
    parser.feed("other")
    copy.feed(text[100:])
    assert len(copy.hashes) - 1 == len(phrases(text))
    assert copy.signature() == signature(text)


def test_likeness_follows_the_phrase_sets(spark):
    texts = Tables(spark, "/root/testdata/sf0.001").read("documents", "text").limit(60).collect()
    texts = [r[0] for r in texts]
    for one, other in zip(texts, texts[1:]):
        mixed = one[: len(one) // 2] + other
        a, b = phrases(one), phrases(mixed)
        true = len(a & b) / len(a | b)
        assert likeness(signature(one), signature(mixed)) == pytest.approx(true, abs=0.2)
    found = fingerprint_rows(spark, texts[:3] + [None, ""])
    assert found[texts[0]] == signature(texts[0]).hex()
    assert found[None] == found[""] == "f" * 512


def fingerprint_rows(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return dict(map(tuple, df.select("text", fingerprint(df["text"])).collect()))


def test_query_on_all_documents(spark):
    tables = Tables(spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in tables.read("documents", "doc_id", "text").collect()]
    found = sorted(map(tuple, run(tables).collect()), key=str)
    assert found == expected(rows)
    near = [r[5] > r[6] for r in found]
    assert sum(near) / len(near) > 0.97


@pytest.mark.parametrize("n", [0, 1, 2, 7])
def test_odd_rows(spark, tmp_path, n):
    rows = [(5, "abc"), (None, None), (9, ""), (5, "abc"), (5, "b" * 200_000), (None, "z"), (-3, "é😀x")]
    df = spark.createDataFrame(rows[:n], "doc_id long, text string").selectExpr("*", "1 AS part", "2 AS guest")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, run(Tables(spark, str(tmp_path))).collect()), key=str) == expected(rows[:n])


@pytest.mark.parametrize("id_", [7, None])
def test_rows_of_one_id_lie_in_many_tasks(spark, id_):
    rows = [(id_, f"text {i} of many") for i in range(600)] + [(i, "other") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = compare_neighbours(df, "doc_id", "text")
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 620 and max(sizes) < 300
