"""Links between texts that share 0.8 or more of their shingles, proved on the shingles.

Fingerprints only say which texts are compared: those that links of fingerprints hold
together are a family. The shingle sets of a family are brought together and compared
exactly, each with each. A large family is dealt to parts, and settled in three steps:

1. Each set goes to its own part, and becomes a member of a group there.
2. A few members of each group meet those of the other groups of the family. This joins
   what many near copies of one text have become.
3. Groups that are left apart may still touch. Two sets that are near share one of the
   rarest fifth of their shingles, by the frequency in the family. Only sets that share
   such a shingle with a set of another group go on, and are compared exactly, where they
   are many in a block for each two parts. A block gives at most one link for each group.

So links, and the sets that are sent, grow with the sets, not with sets times parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quernwork.llm.common import durable, partitions, stored
from quernwork.llm.simhash import components, joined, majority, shingle_hashes
from quernwork.operators.skew import broadcast_up_to

# Texts link if 5 times the shingles they share are 4 times those of either, or more.
SHARED, OF = 4, 5
# Shingles, and a fixed number for each set, from which a family is cut, and which a part
# has on average; a block of two parts has some 16 MB of hashes.
PART, EACH = 1 << 20, 64
# Members of a group that meet other groups before all of them may.
FIRST = 8
# Sets of which a task remembers that it has given them.
REMEMBERED = 50_000


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, in order."""
    return np.unique(shingle_hashes(text or "", size))


def sketch(text: Column, size: int, words: int) -> Column:
    """For each text its ``vertex``, a hash of its shingle set, the set's size and print.

    Of a text of fewer words than ``size`` the whole sequence is the one shingle; a null
    text or one without words has an empty set. Equal texts have equal sketches.
    """

    @arrow_udf("vertex long, n long, print binary")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t, size) for t in texts.to_pylist()]
        vertex = [xxhash.xxh64_intdigest(s.tobytes()) - 2**63 for s in sets]
        arrays = [pa.array(vertex, pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
        arrays.append(pa.array([majority(s, words) for s in sets], pa.binary()))
        return pa.StructArray.from_arrays(arrays, ["vertex", "n", "print"])

    return run(text)


def set_links(sets: list[np.ndarray], groups: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links between groups that hold together all groups with sets that are near.

    At most one for each group: from one to all that are near and not yet reached, and on
    from those. One set is compared with all that are left in one pass over their hashes.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    left = np.flatnonzero(sizes)
    if len(left) < 2:
        return
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.split(ids, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(every), bool)
    rows, held = None, np.zeros(0, np.int64)
    while len(left):
        first = groups[left[0]]
        own = groups[left] == first
        reached, left = left[own].tolist(), left[~own]
        while reached and len(left):
            at = reached.pop()
            if rows is None or 2 * len(left) < len(rows):
                rows, held = left, np.concatenate([of[i] for i in left])
                starts = np.cumsum(sizes[rows]) - sizes[rows]
            mark[of[at]] = True
            shared = np.add.reduceat(mark[held], starts, dtype=np.int64)[np.searchsorted(rows, left)]
            mark[of[at]] = False
            near = OF * shared >= SHARED * (sizes[at] + sizes[left] - shared)
            if near.any():
                met = np.unique(groups[left[near]])
                yield from ((int(first), int(other)) for other in met)
                joined = np.isin(groups[left], met)
                reached += left[joined].tolist()
                left = left[~joined]


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The shingle set of each text; copies that a task sees again, once."""
    seen: set[int] = set()
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            out = []
            for vertex, family, text in zip(*(c.to_pylist() for c in part.columns)):
                if vertex not in seen:
                    out.append((vertex, family, shingle_set(text, size).tobytes()))
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(vertex)
            if out:
                arrays = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(arrays, ["vertex", "family", "hashes"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, list[np.ndarray]]]:
    """Vertices, groups and sets of each block, of rows in order of block; copies once."""
    current, rows = None, {}

    def block():
        vertices = sorted(rows)
        groups = np.array([rows[v][0] for v in vertices], np.int64)
        return vertices, groups, [np.frombuffer(rows[v][1], np.uint64) for v in vertices]

    for batch in batches:
        for *key, vertex, group, data in zip(*(c.to_pylist() for c in batch.columns)):
            if key != current:
                if rows:
                    yield block()
                current, rows = key, {}
            rows[vertex] = group, data
    if rows:
        yield block()


def _longs(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The group of each set within its part, and its place among those of the group."""
    for vertices, _, sets in _blocks(batches):
        label = np.arange(len(sets))
        for one, other in set_links(sets, np.arange(len(sets))):
            label[other] = label[one]
        place = np.zeros(len(sets), np.int64)
        order = np.argsort(label, kind="stable")
        new = np.flatnonzero(np.diff(label[order], prepend=-1))
        place[order] = np.arange(len(order)) - np.repeat(new, np.diff([*new, len(order)]))
        alone = (np.bincount(label, minlength=len(sets))[label] == 1).astype(np.int64)
        rows = [(v, vertices[l], p, a) for v, l, p, a in zip(vertices, label.tolist(), place.tolist(), alone.tolist())]
        yield _longs(rows, ["vertex", "group", "place", "alone"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the groups of each block."""
    for _, groups, sets in _blocks(batches):
        links_ = list(set_links(sets, groups))
        if links_:
            yield _longs(links_, ["a", "b"])


def _in_part(parts: Column, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("vertex", F.lit(seed)), parts).cast("int")


def _meet(rows: DataFrame, by: list[str], run, schema: str) -> DataFrame:
    """Rows with ``vertex``, ``group`` and ``hashes``, brought together by ``by``."""
    count = partitions(rows.sparkSession)
    met = rows.select(*by, "vertex", "group", "hashes").repartition(count, *by)
    return met.sortWithinPartitions(*by).mapInArrow(run, schema)


def _cut(rows: DataFrame, of: str, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """``rows`` with ``part`` and ``parts`` of their ``of``; those of several parts, and how many.

    Only the names of what is cut are joined, so that a large one is not brought together
    by its name before it is dealt out.
    """
    size = F.sum(F.length("hashes") / 8 + EACH)
    sizes = rows.groupBy(of).agg(F.ceil(size / PART).cast("int").alias("parts"))
    large = durable(sizes.where("parts > 1"))
    n = large.count()
    known = rows.join(broadcast_up_to(large, n), of, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    return known.withColumn("part", _in_part(F.col("parts"), seed)), large.select(of), n


def _renamed(rows: DataFrame, links_: DataFrame) -> DataFrame:
    """``rows`` with the group that links between groups have made of each."""
    names = durable(components(links_)).withColumnRenamed("vertex", "group")
    return rows.join(names, "group", "left").withColumn("group", F.coalesce("root", "group")).drop("root")


def _touching(sets: DataFrame) -> DataFrame:
    """The sets that may be near one of another group, and ``near``, which of them may meet.

    Each set is put in order of the frequency of its shingles within the family; of n
    shingles the first n - 0.8 n + 1 have one in common with those of any set that is
    near. Sets that share such a shingle, with another group among them, get the same
    ``near``, and so do all that these hold together.
    """
    shingle = F.explode(F.expr("transform(sequence(0, length(hashes) div 8 - 1), i -> substring(hashes, 8 * i + 1, 8))"))
    n = F.expr("length(hashes) div 8")
    first = (n - F.ceil(n * SHARED / OF) + 1).alias("first")
    each = sets.where("length(hashes) > 0").select("family", "vertex", "group", first, shingle.alias("shingle"))
    often = each.groupBy("family", "shingle").agg(F.count("*").alias("often"))
    ordered = Window.partitionBy("vertex").orderBy("often", "shingle")
    rare = each.join(often, ["family", "shingle"]).withColumn("at", F.row_number().over(ordered))
    rare = durable(rare.where("at <= first AND often > 1").select("family", "shingle", "vertex", "group"))
    met = rare.groupBy("family", "shingle").agg(
        F.min("vertex").alias("least"), F.min("group").alias("low"), F.max("group").alias("high")
    )
    found = rare.join(met.where("low < high").select("family", "shingle", "least"), ["family", "shingle"])
    star = durable(found.selectExpr("vertex AS a", "least AS b").distinct())
    return sets.join(components(star).withColumnRenamed("root", "near"), "vertex")


def proved_roots(rows: DataFrame, docs: DataFrame, size: int, bits: int) -> DataFrame:
    """The ``root`` of each ``vertex`` that is linked to another by shingles they share.

    ``rows`` has ``doc_id``, ``vertex``, ``n`` and ``print`` as ``sketch`` gives them and a
    ``digest`` of the text, and should be a written table. ``docs`` has ``doc_id``,
    ``digest`` and ``text``. Fingerprints at ``bits`` bits make the families; of a family
    whatever is near is found. Of rows of one set one text is read, of the smallest id,
    null last. Texts without words are one set, and near nothing. An empty table gives no
    rows; rows that are alike in all columns count once.
    """
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    owners = durable(rows.groupBy("vertex").agg(F.min(own).alias("own"), F.min("print").alias("print")))
    families = durable(joined(owners.select("vertex", "print"), bits))
    members = owners.join(families, "vertex").select(
        F.col("own.doc_id").alias("id"), F.col("own.digest").alias("mark"), "vertex", F.col("root").alias("family")
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("mark") == F.col("digest"))
    texts = docs.join(members, same).select("vertex", "family", "text")
    sets = stored(texts.mapInArrow(lambda b: _sets(b, size), "vertex long, family long, hashes binary"), "sets")
    dealt, large, n_large = _cut(sets, "family", 0)
    dealt = dealt.withColumn("group", F.col("vertex"))
    schema = "vertex long, group long, place long, alone long"
    placed = durable(_meet(dealt, ["family", "part"], _grouped, schema))
    if n_large == 0:
        return placed.where("alone = 0").selectExpr("vertex", "group AS root")
    of_large = sets.join(broadcast_up_to(large, n_large), "family")
    apart = of_large.join(placed, "vertex")
    # Copies of a row give one set twice, here as later in its block.
    few = apart.where(f"alone = 0 AND place < {FIRST}")
    few, _, _ = _cut(few, "family", 1)
    grouped = _renamed(placed.select("vertex", "group"), _meet(few, ["family", "part"], _linked, "a long, b long"))
    grouped = durable(grouped)
    open_ = of_large.join(grouped, "vertex").dropDuplicates(["vertex"])
    left = stored(_touching(open_), "touching")
    # Each set goes to the blocks of its part with every part; two parts share one block.
    cut, _, _ = _cut(left, "near", 2)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    grouped = durable(_renamed(grouped, _meet(cut, ["near", "low", "high"], _linked, "a long, b long")))
    held = grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return grouped.join(held, "group", "left_semi").selectExpr("vertex", "group AS root")
