"""Near copies against the shingles that all pairs share."""

import collections
import random

import pytest

import corpus_pipeline as pipeline
from quernwork.llm import near_copies as module


def shingles(text):
    found = (text or "").encode().lower().split()
    n = min(5, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if found else set()


def kept_by_brute_force(rows):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                root[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i)].append(row[0])
    return sorted(map(min, groups.values()))


def made():
    """A family that shares boilerplate at 0.6 to 0.7, near copies, and repeated lines."""
    rnd, texts = random.Random(7), []
    word = lambda: f"w{rnd.randrange(10**6)}"
    shared = [word() for _ in range(160)]
    texts += [" ".join(shared + [word() for _ in range(38)]) for _ in range(60)]
    for _ in range(40):
        words = [word() for _ in range(200)]
        texts.append(" ".join(words))
        words[rnd.randrange(200)] = "other"
        texts.append(" ".join(words))
    line = "one line that is said again "
    texts += [line * 30 + " ".join(word() for _ in range(40)) for _ in range(10)]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("part", [1 << 18, 2000, 500])
def test_only_texts_that_share_their_shingles_go(spark, monkeypatch, part):
    monkeypatch.setattr(module, "PART", part)
    monkeypatch.setattr(module, "FIRST", 2)
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(r[0] for r in pipeline.near_copies(spark, df, "").collect())
    assert found == kept_by_brute_force(rows)
    assert len(found) == 110


def variants(n, seed=3):
    """A text, and others with one or two of its words changed: near it, but few near each other."""
    rnd = random.Random(seed)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(100)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rnd.sample(range(100), rnd.randrange(1, 3) if i else 0):
            words[at] = f"v{i}"
        out.append((i, " ".join(words)))
    return out


def test_links_grow_with_the_sets_not_with_sets_times_parts(spark, monkeypatch):
    monkeypatch.setattr(module, "PART", 40_000)
    counts = []
    original = module.components

    def counted(links):
        links = module.durable(links)
        counts[-1] += links.count()
        return original(links)

    monkeypatch.setattr(module, "components", counted)
    for n in (500, 1000, 2000):
        counts.append(0)
        rows = variants(n)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        kept = sorted(r[0] for r in pipeline.near_copies(spark, df, "").collect())
        # Fingerprints don't find all there is.
        assert kept_by_brute_force(rows) == [0] and kept[0] == 0 and len(kept) <= 0.05 * n
    # A few links for each text, whatever the parts.
    assert all(count <= 5 * n for count, n in zip(counts, (500, 1000, 2000))), counts


def test_groups_that_touch_in_one_pair_only(spark, monkeypatch):
    """A chain: each text is near the next alone, and the parts hold few of them."""
    monkeypatch.setattr(module, "PART", 600)
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(100)]
    texts = []
    for i in range(60):
        texts.append(" ".join(words))
        words = words[4:] + [f"w{rnd.randrange(10**6)}" for _ in range(4)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in pipeline.near_copies(spark, df, "").collect()] == kept_by_brute_force(rows) == [0]


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "PART", 300)
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " "), (None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None), (7, long), (5, long + " x")]
    rows += [(6, "q r s t u v")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS vertex", "2 AS root", "3 AS digest")
    got = pipeline.near_copies(spark, df, "")
    assert got.columns == df.columns
    # Texts without words are one set.
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, None), (4, "a b c"), (5, long + " x"), (6, "q r s t u v")]
    assert pipeline.near_copies(spark, df.limit(0), "").collect() == []
