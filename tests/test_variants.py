"""JSON of mixed kinds as variants."""

from pyspark.sql import functions as F

from quernwork.functions import field, kind, parsed

ROWS = [
    '{"k": 1}', '{"k": "7"}', '{"k": "x"}', '{"k": null}', "{}", '{"k": [1, {"a": 2}]}', '{"k": {"a": 3}}', '{"k": true}',
    '{"k": 1.5}', "not json", "", None, '{"k": 99999999999999999999}', '[{"k": 4}]', '{"K": 5}',
]


def test_fields_of_mixed_kinds(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "i int, text string")
    v = df.select("i", "text", parsed("text").alias("v"))
    rows = v.select(
        "i", F.col("v").isNull().alias("bad"), kind(F.col("v"), "$.k").alias("kind"),
        field(F.col("v"), "$.k", "bigint").alias("n"), field(F.col("v"), "$.k", "string").alias("s"),
        field(F.col("v"), "$.k[1].a", "int").alias("deep"),
    ).orderBy("i").collect()
    assert [r["bad"] for r in rows] == [i in (9, 10, 11) for i in range(len(ROWS))]
    kinds = [r["kind"] for r in rows]
    assert kinds[:2] == ["BIGINT", "STRING"] and kinds[3:5] == ["VOID", None] and kinds[7] == "BOOLEAN"
    assert kinds[5].startswith("ARRAY") and kinds[6].startswith("OBJECT") and kinds[8].startswith("DECIMAL")
    assert [r["n"] for r in rows[:5]] == [1, 7, None, None, None] and rows[12]["n"] is None and rows[14]["n"] is None
    assert rows[1]["s"] == "7" and rows[5]["deep"] == 2
    assert [r["n"] for r in rows[9:12]] == [None] * 3


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string").select(parsed("text").alias("v"))
    assert df.select(kind(F.col("v")), field(F.col("v"), "$.a", "int")).collect() == []
