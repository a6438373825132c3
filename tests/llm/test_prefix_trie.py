"""The trie against plain code over all prefixes."""

import random
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from quernwork.llm import prefix_trie as module
from quernwork.llm.prefix_trie import Minima, rebuilt, shared_turns, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, (role or "", text or "")))
    own = {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    paths = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []
    for node, convs in members.items():
        below, leaves, saved = [node], 0, 0
        while below:
            at = below.pop()
            below += children.get(at, [])
            leaves += at not in children
            saved += (len(members[at]) - 1) * len(at[-1][1].encode()) if at else 0
        ends = ",".join(map(str, sorted(c for c in convs if paths[c] == node)))
        out.append(
            (min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
             len(children.get(node, [])), leaves, saved, sha256(ends.encode()).hexdigest())
        )
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS depth", "'x' AS node")
    return sorted((tuple(r) for r in trie(rebuilt(df)).collect()), key=str)


def made(seed, convs=400):
    """Conversations with common beginnings, a third of them alike, some very long."""
    rnd, rows = random.Random(seed), []
    for c in range(-20, convs):
        n = rnd.choice([1, 2, 3, 8, 12]) if c % 50 else 90
        alike = rnd.random() < 1 / 3
        for t in range(n):
            text = f"t{t}" if alike else rnd.choice(["a", "é", "bc", None])
            rows.append((c, t, rnd.choice(["user", None]) if t > 3 and not alike else "user", text))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard", [1 << 14, 7])
def test_matches_plain_code(spark, monkeypatch, shard):
    monkeypatch.setattr(module, "SHARD", shard)
    rows = made(1)
    assert found(spark, rows) == brute(rows)


def test_large_group_of_copies_reaches_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARD", 64)
    # Ids that keep their own turns or get those of a base that is alike.
    rows = [(c, t, "user", f"same {t}") for c in range(3000) for t in range(9)]
    rows += [(c, t, "user", f"other {c} {t}") for c in range(3000, 3050) for t in range(9)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert max(r[3] for r in got if r[1] == 9) >= 3000


def test_copies_are_spread_over_partitions(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(4000) for t in range(3)]
    conversations = rebuilt(spark.createDataFrame(rows, SCHEMA))
    sizes = []
    original = module.durable

    def seen(df):
        out = original(df)
        if "pid" in df.columns and "key" in df.columns:
            sizes.extend(r["count"] for r in out.groupBy("pid").count().collect())
        return out

    module.durable = seen
    try:
        trie(conversations)
    finally:
        module.durable = original
    assert sum(sizes) == 4000 and max(sizes) < 4000 / 3


def test_odd_rows(spark):
    rows = [
        (1, None, None, None),
        (1, 0, "user", ""),
        (2, 0, "user", "x" * 200_000),
        (0, 0, "", ""),
        (None, 0, "user", "none"),
        (-7, 0, "user", "a"),
        (-5, 1, "user", "b"),
        (2**40, 0, "user", "only"),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, rows[4:5]) == []


def test_conversations_without_turns_end_at_the_root(spark):
    # An own turn count of h or less, and no base: nothing is left.
    convs = [c for c in range(1, 400) if c % 5 and crc32(str(c).encode()) % 9 > 0][:30]
    rows = [(c, 0, "user", "gone") for c in convs]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[0][1:4] == (0, None, 30) and len(got) == 1


def test_role_and_text_are_kept_apart(spark):
    rows = [(5, 0, "ab", "c"), (10, 0, "a", "bc"), (15, 0, None, "abc")]
    rows = [r for r in rows for _ in range(1)]
    assert found(spark, rows) == brute(rows)


def test_minima():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 2, 7, 64, 100):
        values = rnd.integers(-1, 5, n)
        table = Minima(values)
        for start in range(n):
            for end in range(start + 1, n + 1):
                assert table.of(np.array([start]), np.array([end]))[0] == values[start:end].min()
        for place in range(n + 1):
            for least in range(-1, 6):
                right = place
                while right < n and values[right] >= least:
                    right += 1
                left = place
                while left > 0 and values[left - 1] >= least:
                    left -= 1
                assert table.right(np.array([place]), np.array([least]))[0] == right
                assert table.left(np.array([place]), np.array([least]))[0] == left


def test_shared_turns():
    a, b = b"a" * 16, b"b" * 16
    assert [shared_turns(x, y) for x, y in ((b"", a), (a, a), (a + b, a + a), (a, b))] == [0, 1, 1, 0]
