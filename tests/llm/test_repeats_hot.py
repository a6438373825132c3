"""A passage that most documents have sends few runs to where its anchors meet."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernwork.llm import repeats as module
from quernwork.llm.q04_repeats import run
from quernwork.sources import Tables

from .test_repeats import brute


def texts(n, passage):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    return [" ".join([*(word() for _ in range(20 + i % 40)), passage, *(word() for _ in range(20))]) for i in range(n)]


def scanned(rows):
    """The runs of rows that one task reads in batches of ten."""
    for at in range(0, len(rows), 10):
        ids, own = zip(*rows[at : at + 10])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(own)], ["doc", "text"])


def test_common_run_is_given_on_once_a_task(monkeypatch):
    # Far more different runs than are remembered lie between the first and the last.
    monkeypatch.setattr(module, "REMEMBERED", 150)
    passage = " ".join(f"common{i}" for i in range(60))
    found = pa.Table.from_batches(module._scan(scanned(list(enumerate(texts(400, passage)))))).to_pandas()
    copies = found.groupby("digest").agg(rows=("anchor", "size"), meet=("anchor", lambda a: (a != -1).sum()))
    assert len(copies) > 20 * 150
    assert (copies["rows"] == 400).sum() >= 5
    assert copies.loc[copies["rows"] == 400, "meet"].max() == 1


@pytest.mark.parametrize(
    "digest, doc, mark",
    [("7", "id", "xxhash64(id)"), ("7", "id", "5"), ("7", f"{module._LAST_ID}", "xxhash64(id)"), ("xxhash64(id)", "3", "5")],
)
def test_covered_runs_are_dealt_evenly(spark, digest, doc, mark):
    # One passage in many texts, in copies of a text, in texts without ids; one long text.
    runs = spark.range(8000).selectExpr("-1L anchor", f"{digest} + 0L digest", f"{doc} + 0L doc", f"{mark} + 0L mark")
    dealt = runs.repartition(8, module._meeting()).groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) == 8 and max(n for _, n in dealt) < 1500


def test_runs_of_a_hot_passage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "REMEMBERED", 150)
    passage = " ".join(f"common{i}" for i in range(60))
    rows = list(enumerate(texts(240, passage))) + [(1000 + i, passage) for i in range(80)]
    rows += [(None, f"{passage} {i}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, run(Tables(spark, str(tmp_path))).collect()), key=str) == brute(rows)
