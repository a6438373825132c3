"""Fingerprints from the phrases a Lempel-Ziv parser finds in a text.

The parser (LZ78, over code points) cuts a text into phrases, each a phrase seen
before and one character more. Texts with common passages share phrases. A phrase is
hashed by what it spells, and a text's set of phrases is kept as a signature of
minimum hashes, of which two agree at a place as often as the sets overlap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quernwork.llm.common import bounded_batches, partitions

# Minimum hashes in a signature; a likeness is a multiple of one part in this many.
HASHES = 128
# Phrases hashed at a time: a block of 2 MB.
# Characters of a text that tell places in the order apart.
HEAD = 64
BLOCK = 4096

_random = np.random.default_rng(20)
_FACTORS = (_random.integers(0, 2**31, HASHES, np.uint32) << np.uint32(1)) | np.uint32(1)
_OFFSETS = _random.integers(0, 2**32, HASHES, np.uint32)


class Phrases:
    """The parser after a part of a text; it may go on, and be copied to go on twice."""

    def __init__(self) -> None:
        # (phrase, next character) as one number -> the longer phrase, shifted.
        self.known: dict[int, int] = {}
        self.hashes = [0]
        self.at = 0
        self.minima = np.full(HASHES, 0xFFFFFFFF, np.uint32)
        self.counted = 1

    def copy(self) -> Phrases:
        other = Phrases()
        other.known, other.hashes = dict(self.known), list(self.hashes)
        other.at, other.minima, other.counted = self.at, self.minima.copy(), self.counted
        return other

    def feed(self, text: str) -> None:
        known, hashes, at = self.known, self.hashes, self.at
        look = known.get
        for char in map(ord, text):
            longer = look(at + char)
            if longer is None:
                known[at + char] = len(hashes) << 21
                hashes.append((hashes[at >> 21] * 1000003 + char + 1) & 0xFFFFFFFFFFFF)
                at = 0
            else:
                at = longer
        self.at = at

    def signature(self) -> bytes:
        """The minimum hashes of all phrases so far, 16 bits of each."""
        new = np.array(self.hashes[self.counted :], np.uint64)
        new ^= new >> np.uint64(23)
        new = ((new * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(new), BLOCK):
            block = new[i : i + BLOCK, None] * _FACTORS + _OFFSETS
            np.minimum(self.minima, block.min(axis=0), out=self.minima)
        self.counted = len(self.hashes)
        return (self.minima >> np.uint32(16)).astype(">u2").tobytes()


def signature(text: str) -> bytes:
    phrases = Phrases()
    phrases.feed(text)
    return phrases.signature()


def likeness(one: bytes, other: bytes) -> float:
    """Which share of the minimum hashes agree."""
    return float(np.mean(np.frombuffer(one, ">u2") == np.frombuffer(other, ">u2")))


def fingerprint(text: Column) -> Column:
    """The signature of every text as hex digits, null as an empty text.

    Equal texts have equal fingerprints. The empty set of phrases has all digits f.
    """

    @arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([signature(t or "").hex() for t in texts.to_pylist()], pa.string())

    return run(text)


def compare_neighbours(rows: DataFrame, id_: str, text: str) -> DataFrame:
    """Every text beside an edited copy of itself and beside the next text.

    Rows go by descending id, null ids last, equal ids by text; after the last comes
    the first. In the edited copy the last half of the characters, rounded down,
    gives way to as many, or all there are, of the first of the next text.

    The order is cut into ranges at rows of the table, each told by its id and the first
    ``HEAD`` characters of its text, so that rows of one id, or without one, lie in many
    ranges. The driver holds one such place for each of four times the shuffle partitions,
    out of a sample of some 16 times as many different ones. The first row of each range is
    known so, and goes to the range before as well; texts are shuffled once. A task holds two
    texts. Null texts are empty. A single row is its own next. An empty table gives no rows.

    Gives ``doc_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    n = 4 * partitions(spark)
    plain = rows.select(
        F.col(id_).cast("long").alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    # Places in the order: rows without an id last, larger ids first, then texts.
    place = F.struct(
        F.col("id").isNull().alias("none"),
        F.coalesce(F.bitwise_not("id"), F.lit(0).cast("long")).alias("down"),
        F.substring("text", 1, HEAD).alias("head"),
    )
    placed = plain.withColumn("place", place)
    found = placed.agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least")).first()
    # Each range begins with one of these, chosen by a hash.
    share = F.lit(max(1, found["n"] // (16 * n)))
    sample = placed.where(F.pmod(F.xxhash64("id", "text"), share) == 0).select("place").distinct()
    places = sorted(tuple(r["place"]) for r in sample.collect())
    least = [tuple(found["least"])] if found["n"] else []
    starts = sorted({*places[:: -(-len(places) // n) or 1], *least}) or [(True, 0, "")]
    step = max(1, int(len(starts) ** 0.5))

    def listed(some: list[tuple]) -> Column:
        fields = [(F.lit(a), F.lit(b).cast("long"), F.lit(c)) for a, b, c in some]
        return F.array(*[F.struct(a.alias("none"), b.alias("down"), c.alias("head")) for a, b, c in fields])

    def up_to(array: Column) -> Column:
        """How many starts are at or before the row's place."""
        return F.size(F.filter(array, lambda s: s <= F.col("place")))

    # First in steps, then within one.
    coarse = (up_to(listed(starts[::step])) - 1) * step
    placed = placed.withColumn("coarse", coarse)
    part = F.col("coarse") + up_to(F.slice(listed(starts), F.col("coarse") + 1, step)) - 1
    placed = placed.withColumn("part", part)
    placed = placed.withColumn("first", F.get(listed(starts), F.col("part")) == F.col("place"))
    home = placed.select("id", "text", "part", F.lit(False).alias("guest"))
    # Of rows at one start the first in order.
    opening = placed.where("first").groupBy("part").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    before = F.when(F.col("part") == 0, F.lit(len(starts) - 1)).otherwise(F.col("part") - 1)
    guests = opening.withColumn("part", before).withColumn("guest", F.lit(True))
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return (
        home.unionByName(guests)
        .repartition(partitions(spark), "part")
        .sortWithinPartitions("part", "guest", F.col("id").desc_nulls_last(), "text")
        .select("part", "guest", "id", "text")
        .mapInArrow(_neighbours, schema)
    )


class _Read:
    """A text, its signature, and the parser as it was before the last half."""

    def __init__(self, id_: int | None, text: str) -> None:
        self.id, self.text = id_, text
        kept = len(text) - len(text) // 2
        phrases = Phrases()
        phrases.feed(text[:kept])
        phrases.signature()
        self.half = phrases.copy()
        phrases.feed(text[kept:])
        self.signature = phrases.signature()

    def beside(self, following: _Read) -> tuple:
        cut = len(self.text) // 2
        added = following.text[:cut]
        edited = self.text[: len(self.text) - cut] + added
        self.half.feed(added)
        signature = self.half.signature()
        return (
            self.id,
            len(self.text),
            hashlib.sha256(edited.encode()).hexdigest(),
            self.signature.hex(),
            signature.hex(),
            likeness(self.signature, signature),
            likeness(self.signature, following.signature),
        )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint"]
    names += ["near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    types += [pa.float64(), pa.float64()]
    range_, held = None, None
    for batch in batches:
        rows = []
        for part, guest, id_, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if part != range_:
                range_, held = part, None
            elif held is None:
                continue
            now = _Read(id_, text)
            if held is not None:
                rows.append(held.beside(now))
            held = None if guest else now
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 7, types)], names
        )
