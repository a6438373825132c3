"""Batches for Python stay small whichever operators were built before."""

import pyarrow as pa
from pyspark.sql import functions as F

from quernwork.llm.common import BATCH_BYTES, BATCH_ROWS, bounded_batches
from quernwork.llm.kneser_ney import score


def _sizes(batches):
    for batch in batches:
        data = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_pydict({"n": [len(data)], "bytes": [sum(map(len, data))]})


def _batches(spark, rows, size):
    table = spark.range(rows, numPartitions=1).select(F.repeat(F.lit("x"), size).alias("text"))
    return table.mapInArrow(_sizes, "n long, bytes long").collect()


def test_batches_end_by_rows_or_bytes(spark):
    bounded_batches(spark)
    one = 1_500_000
    long = _batches(spark, 100, one)
    assert sum(b["n"] for b in long) == 100
    assert max(b["bytes"] for b in long) <= BATCH_BYTES + one
    assert [b["n"] for b in _batches(spark, 1200, 10)] == [BATCH_ROWS, BATCH_ROWS, 176]


def test_operators_leave_one_bound(spark):
    names = [f"spark.sql.execution.arrow.max{n}PerBatch" for n in ("Records", "Bytes")]
    bounded_batches(spark)
    before = [spark.conf.get(n) for n in names]
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    score(rows, "doc_id", "text", F.lit(True))
    assert [spark.conf.get(n) for n in names] == before
