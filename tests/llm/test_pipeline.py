"""The pipeline: each stage against plain code on its own input."""

import collections

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quernwork.llm.bpe import read_ranks
from quernwork.llm.common import stored
from quernwork.llm.mixing import words
from quernwork.sources import Tables
from tests.llm.test_near_copies import kept_by_brute_force

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What goes into each stage and comes out of the last."""
    docs, seen = Tables(spark, FOLDER).read("documents"), []
    for name, stage in pipeline.STAGES:
        seen.append(docs)
        docs = stored(stage(spark, docs, FOLDER), name)
    return [*seen, docs]


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_names_and_columns(stages):
    assert len(pipeline.STAGES) == 5
    assert all(s.columns == stages[0].columns for s in stages[:5])
    assert stages[5].columns == [*stages[0].columns, "ids", "n_tokens", "decodes"]


def test_quality_keeps_good_documents(spark, stages):
    labels = {r[0]: r[1] for r in Tables(spark, FOLDER).read("labels", "doc_id", "quality").collect()}
    kept = {r["doc_id"] for r in rows(stages[1])}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.97


def test_near_copies_leave_one(stages):
    before, after = rows(stages[1]), rows(stages[2])
    kept = kept_by_brute_force([(r["doc_id"], r["text"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == kept


def test_repeats_go(stages):
    seen = set()
    after = {r["doc_id"]: r for r in rows(stages[3])}
    for row in sorted(rows(stages[2]), key=lambda r: r["doc_id"]):
        data = row["text"].encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        left = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left or not data:
            assert after[row["doc_id"]]["text"] == left
            assert after[row["doc_id"]]["n_chars"] == len(left)
        else:
            assert row["doc_id"] not in after


def test_sources_meet_their_budgets(stages):
    def sizes(df):
        sized = df.select("source", words(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n"))
        return dict(map(tuple, sized.collect()))

    before, after = sizes(stages[3]), sizes(stages[4])
    assert abs(sum(after.values()) - 1.5 * sum(before.values())) <= len(before)
    assert all(after[s] <= 2 * before[s] for s in after)
    texts = collections.defaultdict(list)
    for row in rows(stages[4]):
        texts[row["doc_id"]].append(row["text"])
    whole = {r["doc_id"]: r["text"] for r in rows(stages[3])}
    assert all(whole[i].startswith(t) for i, ts in texts.items() for t in ts)
    assert sum(t != whole[i] for i, ts in texts.items() for t in ts) <= len(before)


def test_tokens_are_the_library_s(stages):
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    for row in rows(stages[5]):
        assert row["ids"] == library.encode_ordinary(row["text"])
        assert row["n_tokens"] == len(row["ids"]) and row["decodes"]


def test_odd_rows(spark, tmp_path):
    good = Tables(spark, FOLDER).read("documents").limit(30).collect()
    odd = [(None, None, None, None, None, "a"), (900, "", None, "s", 0, None), (901, None, "en", None, None, "b")]
    odd += [(902, "one two three", "en", "s", 13, "c")] * 2 + [(902, "other words here", "en", "s", 16, "c")]
    odd += [(903, "word and " * 60_000, "en", "s", 540_000, "d"), (None, "x y z", None, "s", 5, "e")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string"
    df = spark.createDataFrame([(*r, "z") for r in good] + odd, schema)
    df = df.selectExpr("*", "1 AS taken", "2 AS print", "3 AS ids", "4 AS kept", "5 AS digest", "6 AS c0")
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns[: len(before.columns)] == before.columns
        assert docs.count() > 0
    empty = df.limit(0)
    for name, stage in pipeline.STAGES:
        empty = stored(stage(spark, empty, str(tmp_path)), name)
        assert empty.count() == 0
