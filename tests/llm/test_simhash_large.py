"""Large shards of longer fingerprints lose no link."""

import random

import numpy as np
import pytest

from quernwork.llm.simhash import components, links


def quarters(print_):
    return np.frombuffer(print_, ">u2")


def plain(prints, bits):
    """The smallest vertex of each, by all pairs that are near in a quarter."""
    root = list(range(len(prints)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(prints)):
        for j in range(i):
            apart = np.bitwise_count(quarters(prints[i]) ^ quarters(prints[j]))
            if apart.min() <= 1 and apart.sum() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("large", [100_000, 40, 5])
def test_large_changes_no_link(spark, large):
    rnd, prints = random.Random(5), []
    for _ in range(3):
        start, quarter = rnd.getrandbits(128), 16 * rnd.randrange(8)
        # Near in one quarter, and by 22 to 24 bits elsewhere.
        others = [b for b in range(128) if not quarter <= b < quarter + 16]
        for _ in range(60):
            found = start
            for b in rnd.sample(others, rnd.randrange(22, 25)):
                found ^= 1 << b
            prints.append(found ^ (1 << quarter + rnd.randrange(16) if rnd.random() < 0.3 else 0))
        prints.append(start)
    prints = [p.to_bytes(16, "big") for p in prints]
    df = spark.createDataFrame(list(enumerate(prints)), "vertex long, print binary")
    found = {r["vertex"]: r["root"] for r in components(links(df, 24, large)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == plain(prints, 24)
