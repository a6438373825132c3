"""Fingerprints and classes against plain code over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from quernwork.llm import simhash as module
from quernwork.llm.q09_simhash import run
from quernwork.llm.simhash import classes, components, simhash, visits
from quernwork.sources import Tables


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    if not words:
        return 0
    n = max(1, len(words) - 3)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > n)


def brute(rows):
    prints = np.array([p for _, p in rows], np.uint64)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    members = {}
    for i, (id_, _) in enumerate(rows):
        members.setdefault(find(i), []).append(id_)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return sorted(((id_, p, least[find(i)]) for i, (id_, p) in enumerate(rows)), key=str)


@pytest.mark.parametrize("large", [100_000, 20])
def test_classes_of_made_up_prints(spark, monkeypatch, large):
    monkeypatch.setattr(module.links, "__defaults__", (4, large))
    rnd = random.Random(large)
    prints = [rnd.getrandbits(64) for _ in range(300)] + [0, 0, 2**64 - 1]
    for _ in range(1500):
        p = rnd.choice(prints[:30])
        for b in rnd.sample(range(64), rnd.randrange(7)):
            p ^= 1 << b
        prints.append(p)
    rows = [(i * 7 % 5003, p) for i, p in enumerate(prints)] + [(None, prints[0]), (None, 12345)]
    packed = [(i, p.to_bytes(8, "big")) for i, p in rows]
    df = spark.createDataFrame(packed, "doc_id long, print binary")
    found = classes(df, "doc_id", "print").select("doc_id", "print", "component_id").collect()
    found = [(r[0], int.from_bytes(r[1], "big"), r[2]) for r in found]
    assert sorted(found, key=str) == brute(rows)


def test_tree_finds_all_within_one_bit():
    values = np.array([0, 65535, 1234, 40000], np.uint16)
    at, leaf = visits(values)
    for i, v in enumerate(values.tolist()):
        assert sorted(leaf[at == i].tolist()) == sorted([v] + [v ^ 1 << b for b in range(16)])


def test_long_chain(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(201)}


def test_longer_fingerprints_find_near_copies(spark):
    rnd, rows = random.Random(2), []
    for i in range(120):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        rows.append((2 * i, " ".join(words)))
        for _ in range(6):
            words[rnd.randrange(300)] = "other"
        rows.append((2 * i + 1, " ".join(words)))
    packed = [(i, simhash(t, 5, 2)) for i, t in rows]
    df = spark.createDataFrame(packed, "doc_id long, print binary")
    found = {r[0]: r[1] for r in classes(df, "doc_id", "print", 24).select("doc_id", "component_id").collect()}
    assert all(found[2 * i] == 2 * i for i in range(120))
    assert sum(found[2 * i + 1] == 2 * i for i in range(120)) > 108


def test_fingerprints():
    for text in ("", "One two", "A b C d", "x " * 999, "the quick Brown fox\n jumps É over", "\x0b a\x1cb c d e f"):
        assert simhash(text) == plain(text).to_bytes(8, "big")


def test_query_on_all_documents(spark):
    tables = Tables(spark, "/root/testdata/sf0.01")
    rows = [(r[0], plain(r[1])) for r in tables.read("documents", "doc_id", "text").collect()]
    found = [(r[0], int(r[1], 16), r[2]) for r in run(tables).collect()]
    assert sorted(found, key=str) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rows = [(5, None), (3, ""), (None, " "), (9, "a b c"), (9, "a b c"), (None, "zz"), (7, "w " * 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS print", "2 AS root")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    found = [(r[0], int(r[1], 16), r[2]) for r in run(Tables(spark, str(tmp_path))).collect()]
    assert sorted(found, key=str) == brute([(i, plain(t)) for i, t in rows])
    df.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(Tables(spark, f"{tmp_path}/none")).collect() == []
