"""Counts against the library on whole texts."""

import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quernwork.llm.q08_token_counts import run
from quernwork.llm.token_counts import Counter
from quernwork.sources import Tables

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
SMALL = Counter(PATH, chunk=300, overlap=16)
WORDS = ["the", "whst", "é", "😀😀", "  ", "\n", "<|endoftext|>", "a" * 90, "-" * 40, "'s", "12345", "\t x"]


def truth(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=200), st.sampled_from(["", " ", " \n"]))
def test_spliced_chunks(words, between):
    text = between.join(words)
    assert SMALL.counts([text]) == [truth(text)]


def test_long_texts():
    rnd = random.Random(3)
    for between in ("", " ", "  "):
        text = between.join(rnd.choice(WORDS) for _ in range(5000))
        assert SMALL.counts([text, None, ""]) == [truth(text), 0, 0]


def expected(rows):
    out = []
    for doc_id, text in rows:
        n = truth(text)
        out.append((doc_id, len((text or "").encode()), n, n > 1024))
    return sorted(out, key=str)


def test_query_on_all_documents(spark):
    tables = Tables(spark, "/root/testdata/sf0.01")
    rows = [tuple(r) for r in tables.read("documents", "doc_id", "text").collect()]
    assert sorted(map(tuple, run(tables).collect()), key=str) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x  y " * 50_000), (3, "z" * 90_000), (3, "x"), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, run(Tables(spark, str(tmp_path))).collect()), key=str) == expected(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(Tables(spark, f"{tmp_path}/none")).collect() == []
