"""SimHash fingerprints, and exact links between them by vantage-point trees.

Fingerprints of 64 bits link at 4 or fewer differing bits. Cut into four quarters of
16 bits, two linked fingerprints differ in at most one bit in some quarter; in two
quarters, even. The distance within a quarter obeys the triangle inequality too, and a
quarter has only 65,536 values, so one vantage-point tree over these values serves any
number of fingerprints: its leaves are the shards. A fingerprint lives in the leaf of
its own value, and asks at all leaves that the bounds of the tree cannot rule out
within one bit. Whatever meets in a shard is compared exactly, over all 64 bits.

This goes in two turns. In the first no fingerprint asks at another leaf, and each gets the
name of the smallest it is joined to; in the second those of one name need no link, so that
a large group of near copies gives few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quernwork.llm.common import bounded_batches, durable, partitions

# Differing bits up to which fingerprints link, and words in a shingle.
BITS = 4
SHINGLE = 4
SEED = 42
QUARTERS = 4
VALUES = 1 << 16
# Values of a leaf of the tree.
LEAF = 1
# Fingerprints of one shard above which it is cut again.
LARGE = 100_000
# Fingerprints compared with those of a shard at once.
BLOCK = 256


def simhash(text: str, size: int = SHINGLE, words: int = 1) -> bytes:
    """The fingerprint of a text: bits set in over half the hashes of its shingles.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles
    are ``size`` words joined by spaces, repeats included. A shorter text is one
    shingle; a text without words has all bits 0. Further ``words`` of 64 bits take
    the same hashes, mixed once more.
    """
    return majority(shingle_hashes(text, size), words)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """The hash of every shingle of a text, repeats included."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    size = min(size, len(found))
    starts = np.concatenate([[0], ends[: len(found) - size] + 1]).tolist()
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64
    )


def majority(hashes: np.ndarray, words: int = 1) -> bytes:
    """The bits set in over half the hashes; none of no hashes."""
    out = []
    for word in range(words):
        if word:
            hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            hashes = (hashes ^ (hashes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            hashes ^= hashes >> np.uint64(31)
        set_ = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8)
            set_ += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(set_ * 2 > len(hashes)).tobytes())
    return b"".join(out)


def fingerprint(text: Column, size: int = SHINGLE, words: int = 1) -> Column:
    """The fingerprint of every text as ``words`` times 8 bytes; null texts are empty."""

    @arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t or "", size, words) for t in texts.to_pylist()], pa.binary())

    return run(text)


class Node:
    """A vantage point, the radius of its inner half, and what lies within and beyond."""

    __slots__ = ("vantage", "radius", "inner", "outer", "leaf")

    def __init__(self, values: np.ndarray) -> None:
        self.leaf = values if len(values) <= LEAF else None
        if self.leaf is not None:
            return
        self.vantage = values[0]
        away = np.bitwise_count(values ^ self.vantage)
        order = np.sort(away)
        # A radius that leaves something on both sides, as near the middle as can be.
        self.radius = int(min(order[(len(order) - 1) // 2], order[-1] - 1))
        self.inner = Node(values[away <= self.radius])
        self.outer = Node(values[away > self.radius])


@lru_cache(maxsize=1)
def tree() -> Node:
    """The tree over all values of a quarter."""
    return Node(np.arange(VALUES, dtype=np.uint16))


def visits(values: np.ndarray, reach: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For every value the values of all leaves within ``reach``: positions, and leaf values.

    All values go down the tree together. A branch is left out for those whose distance
    to the vantage point, by the triangle inequality, keeps the whole branch away.
    """
    at, found = [], []
    stack = [(tree(), np.arange(len(values)))]
    while stack:
        node, asking = stack.pop()
        if node.leaf is not None:
            for value in node.leaf:
                near = asking[np.bitwise_count(values[asking] ^ value) <= reach]
                at.append(near)
                found.append(np.full(len(near), value, np.uint16))
            continue
        away = np.bitwise_count(values[asking] ^ node.vantage).astype(np.int16)
        inner, outer = asking[away <= node.radius + reach], asking[away > node.radius - reach]
        if len(inner):
            stack.append((node.inner, inner))
        if len(outer):
            stack.append((node.outer, outer))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint16)
    return np.concatenate(at), np.concatenate(found)


def _matrix(prints: list[bytes]) -> np.ndarray:
    """Fingerprints as rows of words."""
    return np.frombuffer(b"".join(prints), ">u8").astype(np.uint64).reshape(len(prints), -1)


def _quarter(prints: np.ndarray, q: int) -> np.ndarray:
    word = prints[:, q // QUARTERS] >> np.uint64(16 * (q % QUARTERS))
    return (word & np.uint64(VALUES - 1)).astype(np.uint16)


def _mixed(vertices: np.ndarray) -> np.ndarray:
    """Vertices as evenly spread numbers of 32 bits."""
    return (vertices.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)


def _blocks(key, asks, at, dealt_by, hot_keys, hot_parts) -> Iterator[tuple]:
    """The rows of large shards, each to the blocks of its part with every part.

    Rows of two parts meet in the block of these two, and in no other.
    """
    parts = hot_parts[np.searchsorted(hot_keys, key)]
    own = (dealt_by[at] % parts.astype(np.uint64)).astype(np.int64)
    for other in range(int(parts.max())):
        has = other < parts
        low, high = np.minimum(own[has], other), np.maximum(own[has], other)
        yield -1 - (key[has] << 42 | low << 21 | high), asks[has], at[has]


def _deal(
    batches: Iterator[pa.RecordBatch], large: dict[int, int], neighbours, bits: int
) -> Iterator[pa.RecordBatch]:
    """Each fingerprint to the shard it lives in and those it asks at, for each quarter.

    A pair that meets at two different values of a quarter meets once: the larger
    value asks at the smaller. A shard that is large is cut without loss of a pair: if
    linked fingerprints are always near in two quarters, both sides go on by the values
    of another quarter. Else both sides are dealt to as many parts as ``large`` says, and
    go to a block for each two parts.
    """
    starts, targets = neighbours
    hot_keys = np.array(sorted(large), np.int64)
    hot_parts = np.array([large[k] for k in sorted(large)], np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        vertices, raw = batch.column(0), batch.column(1)
        prints = _matrix(raw.to_pylist())
        quarters = QUARTERS * prints.shape[1]
        # Each quarter that is not near takes two of the differing bits.
        second_near = quarters - bits // 2 >= 2
        dealt_by = _mixed(np.asarray(vertices, np.int64)) if large else None
        for q in range(quarters):
            values = _quarter(prints, q).astype(np.int64)
            n = starts[values + 1] - starts[values]
            at = np.repeat(np.arange(len(values)), n)
            inside = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            leaf = targets[np.repeat(starts[values], n) + inside].astype(np.int64)
            keep = leaf <= values[at]
            at, leaf = at[keep], leaf[keep]
            key, asks = q * VALUES + leaf, leaf != values[at]
            hot = np.isin(key, hot_keys) if large else np.zeros(len(key), bool)
            rows = [(key[~hot], asks[~hot], at[~hot])]
            if hot.any() and not second_near:
                rows += _blocks(key[hot], asks[hot], at[hot], dealt_by, hot_keys, hot_parts)
            for other in range(quarters) if hot.any() and second_near else ():
                if other != q:
                    again = _quarter(prints[at[hot]], other)
                    beside, near = visits(again)
                    second = (key[hot][beside] * quarters + other) * VALUES + near
                    asks_too = asks[hot][beside] | (near != again[beside])
                    rows.append((-1 - second, asks_too, at[hot][beside]))
            for keys, asking, owners in rows:
                if len(keys):
                    arrays = [pa.array(keys), pa.array(asking), vertices.take(pa.array(owners))]
                    arrays.append(raw.take(pa.array(owners)))
                    yield pa.RecordBatch.from_arrays(arrays, ["shard", "asks", "vertex", "print"])


def _near(one: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``others`` are within ``bits`` of each of ``one``; both rows of words."""
    away = np.zeros((len(one), len(others)), np.uint16)
    for word in range(one.shape[1]):
        away += np.bitwise_count(one[:, word, None] ^ others[None, :, word])
    return away <= bits


def _spread(prints: np.ndarray, bits: int, groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between groups that hold together all groups with rows that link.

    At most one for each group: from one to all that are near and not yet reached, and
    on from those.
    """
    left = np.arange(len(prints))
    while len(left):
        first = groups[left[0]]
        own = groups[left] == first
        reached, left = left[own].tolist(), left[~own]
        while reached and len(left):
            at = reached.pop()
            near = _near(prints[at : at + 1], prints[left], bits)[0]
            if near.any():
                met = np.unique(groups[left[near]])
                yield from ((int(first), int(other)) for other in met)
                joined = np.isin(groups[left], met)
                reached += left[joined].tolist()
                left = left[~joined]


def _compare(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The links of each shard; those that live there come first, then those that ask."""
    shard, home, asking, out = None, [], [], []

    def links() -> None:
        every = home + asking
        groups = np.array([v for v, _ in every], np.int64)
        prints = _matrix([p for _, p in every])
        here = prints[: len(home)]
        linked = np.zeros(len(every), bool)
        for i in range(0, len(every), BLOCK):
            near = _near(prints[i : i + BLOCK], here, bits)
            if near.any():
                # What is one vertex already needs no link; so those here don't meet themselves.
                near &= groups[i : i + BLOCK, None] != groups[: len(home)]
                linked[i : i + BLOCK] |= near.any(axis=1)
                linked[: len(home)] |= near.any(axis=0)
        rows = np.flatnonzero(linked)
        if len(rows):
            out.extend(_spread(prints[rows], bits, groups[rows]))

    def block() -> pa.RecordBatch:
        arrays = [pa.array(side, pa.int64()) for side in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays(arrays, ["a", "b"])

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for key, asks, vertex, print_ in zip(*columns):
            if key != shard:
                if home and len(home) + len(asking) > 1:
                    links()
                shard, home, asking = key, [], []
            (asking if asks else home).append((vertex, print_))
            if len(asking) >= 1 << 20:
                # Whoever asks is compared with those that live here, a part at a time.
                links()
                asking = []
        if out:
            yield block()
    if home and len(home) + len(asking) > 1:
        links()
    if out:
        yield block()


def links(prints: DataFrame, bits: int = BITS, large: int = LARGE, *, reach: int = 1) -> DataFrame:
    """Links ``a`` - ``b`` of vertices that hold together all fingerprints that link.

    ``prints`` has a row for each distinct fingerprint: ``vertex`` (long) and
    ``print`` (bytes); fingerprints that are known to hold together may have one vertex.
    Fingerprints of 64 bits at 4 or fewer differing bits are all joined by a path of
    the links given, and only those. A shard gives at most one link for each of its
    vertices, whatever the number of pairs. Longer ones link if they are within one bit
    in a quarter; ``large`` changes no link. With a ``reach`` of 0 only fingerprints that
    have a quarter in common link.

    How many fingerprints each of the 65,536 values of a quarter has is counted first;
    these counts, bounded by that number, are all that comes to the driver.
    """
    spark = prints.sparkSession
    last = F.floor(F.length("print") / 2).cast("int") - 1
    digits = F.explode(F.sequence(F.lit(0), last)).alias("i")
    counts = (
        prints.select("print", digits)
        .select("i", F.substring(F.hex("print"), F.col("i") * 4 + 1, F.lit(4)).alias("v"))
        .groupBy("i", "v")
        .count()
        .where(F.col("count") > large)
    )
    # Quarters are numbered from the lowest in each word, hex digits from the highest.
    hot = {
        (int(r["i"]) // QUARTERS * QUARTERS + QUARTERS - 1 - int(r["i"]) % QUARTERS) * VALUES
        + int(r["v"], 16): -(-r["count"] // large)
        for r in counts.collect()
    }
    at, leaf = visits(np.arange(VALUES, dtype=np.uint16), reach)
    order = np.lexsort((leaf, at))
    starts = np.searchsorted(at[order], np.arange(VALUES + 1))
    shared = spark.sparkContext.broadcast((starts, leaf[order]))
    bounded_batches(spark)
    dealt = prints.select("vertex", "print").mapInArrow(
        lambda batches: _deal(batches, hot, shared.value, bits),
        "shard long, asks boolean, vertex long, print binary",
    )
    found = (
        dealt.repartition(partitions(spark), "shard")
        .sortWithinPartitions("shard", "asks", "vertex")
        .mapInArrow(lambda batches: _compare(batches, bits), "a long, b long")
    )
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """The smallest vertex (``root``) of the component of each ``vertex`` of the links a - b.

    By stars in turns (large star, small star), each a minimum per vertex that is
    combined before its shuffle and joined back. Every turn is written to the shared
    folder. It ends when a turn changes no link; then each component is one star.
    """
    stars = durable(edges.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v"))
    before = None
    while True:
        both = stars.unionByName(stars.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        # Links now lead from larger to smaller vertices.
        large = large.where("u <> v")
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.selectExpr("v AS u", "m AS v").where("u <> v").unionByName(
            lower.selectExpr("u", "m AS v")
        )
        stars = durable(small.distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = stars.groupBy("v").agg(F.first("v").alias("root")).selectExpr("v AS vertex", "root")
    return stars.selectExpr("u AS vertex", "v AS root").unionByName(roots)


def joined(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """The ``root`` of each ``vertex`` that is linked to another.

    ``prints`` is as for ``links``, a vertex for each fingerprint. In a first turn each
    vertex is linked to the smallest one that a shard of its own quarters holds it together
    with, if there is one, and goes by its name when neighbouring leaves are asked: so a
    large group gives one link for each fingerprint and few more. An empty table gives no
    rows.
    """
    pairs = links(prints, bits, reach=0).select(F.greatest("a", "b").alias("vertex"), F.least("a", "b").alias("least"))
    named = durable(pairs.groupBy("vertex").agg(F.min("least").alias("name")))
    known = prints.join(named, "vertex", "left").select(F.coalesce("name", "vertex").alias("vertex"), "print")
    return components(links(known, bits).unionByName(named.selectExpr("vertex AS a", "name AS b")))


def classes(rows: DataFrame, id_: str, column: str, bits: int = BITS) -> DataFrame:
    """Every row with its ``component_id``: the smallest id it is linked to.

    ``rows`` has an id and a fingerprint (bytes) and should be a written table, as it
    is read twice. Copies meet once, as one fingerprint. A fingerprint may have any
    share of the rows: the last join leaves the splitting of such keys to Spark. Null
    ids get a class, but name none unless all of it are null. Other columns are kept; one
    that is called ``component_id`` is replaced. An empty table stays empty.
    """
    # A fingerprint of 8 bytes is a number itself, a longer one has a hash.
    number = F.conv(F.hex(column), 16, -10).cast("long")
    vertex = F.when(F.length(column) == 8, number).otherwise(F.xxhash64(column))
    owners = durable(
        rows.groupBy(column)
        .agg(F.min(id_).alias("least"))
        .select("least", F.col(column).alias("print"), vertex.alias("vertex"))
    )
    roots = durable(joined(owners.select("vertex", "print"), bits))
    named = owners.join(roots, "vertex", "left").select(
        "print", "least", F.coalesce("root", "vertex").alias("root")
    )
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(smallest, "root").select(F.col("print").alias(column), "component_id")
    return rows.drop("component_id").join(names, column)
