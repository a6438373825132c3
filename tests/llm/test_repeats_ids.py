"""Different texts of one id stay what they are."""

import hashlib

from pyspark.sql import functions as F

from quernwork.llm.repeats import remove_repeats


def test_many_null_ids_keep_their_own_texts(spark):
    # 3,000 texts of one id: some 69 pairs agree in 16 bits of any hash.
    texts = [(None, hashlib.sha512(b"%d" % i).hexdigest()[: 110 + i % 18]) for i in range(3000)]
    texts += [(7, hashlib.sha512(b"x%d" % i).hexdigest()[: 60 + i % 60]) for i in range(3000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("own", F.col("text"))
    found = remove_repeats(df, "doc_id", "text").select("own", "repeats.*").collect()
    assert len(found) == len(texts)
    for row in found:
        assert bytes(row["kept"]).decode() == row["own"]
        assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (len(row["own"]), 0, 0)
