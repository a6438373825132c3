"""Hard negatives: rows of another label that score a little below an anchor's positives.

Every vector is turned by fixed random rotations and kept as signs: the signs of the
rotated vector, then those of what the first signs leave over, turned again, and so on.
With each code goes its alignment, the vector's mean component along the signs. The
anchor's rotated components are cut to a few bits, so its product with a code is a sum
of popcounts over bit planes; alignments make an estimate of the score of it. What codes
leave over is orthogonal to the last one, so by Cauchy-Schwarz its part of the score is
at most its length times that of the anchor's part orthogonal to that code. Together with
the anchor's own rounding this gives an interval that surely holds the score. Only
candidates whose interval reaches into what is wanted are scored, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernwork.llm.common import durable, partitions

# Codes of a vector, and bits of an anchor's components. They decide how many
# candidates are scored, never which are found.
LEVELS, PLANES = 5, 6
SEED = 13
# Anchors and candidates that one task compares, and candidates that it takes at once.
ANCHORS, CANDIDATES, CHUNK = 4096, 4096, 256
# Pairs whose vectors are multiplied at once.
PAIRS = 1 << 16
# Products of lengths below this are exact sums in doubles; others use Python's integers.
EXACT = 2.0**52
LONG = 2**63 - 1
# Relative to the product of lengths, more than rounding adds up to.
ROUNDING = 1e-9

CODED = "id long, label long, vector binary, length double, codes binary, alignments binary, rest double"


@lru_cache(maxsize=4)
def rotations(dims: int) -> np.ndarray:
    """The rotations of all levels, the same in every task."""
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.normal(size=(dims, dims)))[0] for _ in range(LEVELS)])


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of words of 64 bits, the missing bits 0."""
    octets = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*bits.shape[:-1], -(-bits.shape[-1] // 64) * 8), np.uint8)
    out[..., : octets.shape[-1]] = octets
    return out.view(np.uint64)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (vector, level, word), alignments (vector, level), and lengths left over."""
    codes, alignments, rest = [], [], vectors
    for turn in rotations(vectors.shape[1]):
        rest = rest @ turn
        signs = rest >= 0
        along = np.abs(rest).mean(axis=1) if rest.shape[1] else np.zeros(len(rest))
        rest = rest - np.where(signs, along[:, None], -along[:, None])
        codes.append(packed(signs))
        alignments.append(along)
    return np.stack(codes, axis=1), np.stack(alignments, axis=1), np.sqrt((rest * rest).sum(axis=1))


def coded(rows: DataFrame, id_: str, label: str, vector: str, factor: float = 256.0) -> DataFrame:
    """Vectors of the whole numbers floor(``factor`` * x) with their codes.

    Rows with a null id or label, a null vector, or null or non-finite components, also
    after scaling, take no part. Shorter vectors are padded with zeros. Gives ``id``,
    ``label``, ``vector``, ``length``, ``codes``, ``alignments`` and ``rest``.
    """
    plain = rows.select(
        F.col(id_).cast("long").alias("id"),
        F.col(label).cast("long").alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    dims = plain.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                kept, whole = [], np.zeros((part.num_rows, dims))
                for i, v in enumerate(part.column(2)):
                    with np.errstate(over="ignore", invalid="ignore"):
                        found = np.floor(factor * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    if not v.values.null_count and np.isfinite(found).all():
                        whole[len(kept), : len(found)] = found
                        kept.append(i)
                whole = whole[: len(kept)]
                with np.errstate(over="ignore", invalid="ignore"):
                    codes, alignments, rest = encode(whole)
                    lengths = np.sqrt((whole * whole).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(kept, pa.int32())),
                        part.column(1).take(pa.array(kept, pa.int32())),
                        pa.array([v.tobytes() for v in whole], pa.binary()),
                        pa.array(lengths),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array([a.tobytes() for a in alignments], pa.binary()),
                        pa.array(rest),
                    ],
                    [c.split()[0] for c in CODED.split(", ")],
                )

    return plain.mapInArrow(run, CODED)


def rows_of(values: list[bytes], kind: type, *shape: int) -> np.ndarray:
    """Rows of numbers that were kept as bytes."""
    return np.frombuffer(b"".join(values), kind).reshape(len(values), *shape)


class Candidates:
    """Vectors of one label, with their codes."""

    def __init__(self, rows: list[tuple]) -> None:
        uid, ids, labels, vectors, lengths, codes, alignments, rest = zip(*rows)
        self.uid, self.ids, self.label = np.array(uid, np.int64), np.array(ids, np.int64), labels[0]
        self.full = rows_of(vectors, np.float64, len(vectors[0]) // 8)
        self.lengths, self.rest = np.array(lengths), np.array(rest)
        self.codes = rows_of(codes, np.uint64, LEVELS, len(codes[0]) // 8 // LEVELS)
        self.alignments = rows_of(alignments, np.float64, LEVELS)


class Anchors:
    """Anchors, their bit planes, and the ranges of scores they want.

    ``wanted`` has for each anchor the scores it asks about: the ranges that these give
    by ``share`` hundredths, from and to. An anchor that asks about none takes all scores.
    """

    def __init__(self, rows: list[tuple], k: int, share: tuple[int, int]) -> None:
        self.uid = np.array([r[0] for r in rows], np.int64)
        self.labels = np.array([r[2] for r in rows], np.int64)
        vectors = [r[3] for r in rows]
        self.full = rows_of(vectors, np.float64, len(vectors[0]) // 8)
        self.lengths = np.array([r[4] for r in rows])
        wanted = [r[8] for r in rows]
        width = max((len(w) for w in wanted if w is not None), default=1)
        self.low = np.full((len(rows), width), np.inf)
        self.high = np.full((len(rows), width), -np.inf)
        self.ranges: list[list[tuple[int, int] | None]] = []
        for i, scores in enumerate(wanted):
            if scores is None:
                self.low[i, 0], self.high[i, 0] = -np.inf, np.inf
                self.ranges.append([None])
                continue
            self.ranges.append([(-(-share[0] * s // 100), share[1] * s // 100) for s in scores])
            for j, (low, high) in enumerate(self.ranges[-1]):
                self.low[i, j], self.high[i, j] = low, high
        self.k = k
        self.found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._planes()

    def _planes(self) -> None:
        """Rotated components as ``low`` + ``step`` * a number of PLANES bits, by level."""
        n, dims = self.full.shape
        parts, sums, lows, steps, errors = [], [], [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            turned = self.full
            for turn in rotations(dims):
                turned = turned @ turn
                low = turned.min(axis=1) if dims else np.zeros(n)
                step = ((turned.max(axis=1) - low) if dims else np.zeros(n)) / (2**PLANES - 1)
                step = np.where((step > 0) & np.isfinite(step), step, 1.0)
                units = np.nan_to_num(np.rint((turned - low[:, None]) / step[:, None]))
                units = np.clip(units, 0, 2**PLANES - 1).astype(np.int64)
                cut = turned - low[:, None] - units * step[:, None]
                parts.append(np.stack([packed((units >> b & 1).astype(bool)) for b in range(PLANES)], axis=1))
                sums.append(units.sum(axis=1))
                lows.append(low)
                steps.append(step)
                errors.append(np.sqrt((cut * cut).sum(axis=1)) * np.sqrt(dims))
        self.planes = np.stack(parts, axis=1)
        self.sums, self.lows, self.steps, self.errors = map(np.stack, (sums, lows, steps, errors))

    def interval(self, own: np.ndarray, block: Candidates) -> tuple[np.ndarray, np.ndarray]:
        """What the scores of the anchors ``own`` with a block surely lie between."""
        dims = self.full.shape[1]
        estimate = np.zeros((len(own), len(block.ids)))
        slack = np.zeros_like(estimate)
        for level in range(LEVELS):
            codes = block.codes[:, level]
            counts = np.zeros(estimate.shape, np.int32)
            for b in range(PLANES):
                plane = self.planes[own, level, b]
                for word in range(codes.shape[1]):
                    met = np.bitwise_count(plane[:, word, None] & codes[None, :, word])
                    counts += met.astype(np.int32) << b
            ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
            product = self.lows[level, own, None] * (2 * ones - dims)
            product += self.steps[level, own, None] * (2.0 * counts - self.sums[level, own, None])
            error = self.errors[level, own, None]
            estimate += block.alignments[None, :, level] * product
            slack += block.alignments[None, :, level] * error
        along = np.maximum(np.abs(product) - error, 0)
        beside = self.lengths[own, None] ** 2 - along**2 / max(dims, 1)
        slack += block.rest * np.sqrt(np.maximum(beside, 0))
        slack += ROUNDING * np.outer(self.lengths[own], block.lengths) + 1e-6
        return estimate - slack, estimate + slack

    def scan(self, block: Candidates, same: bool) -> int:
        """Take in candidates of the anchors' own label, or else of others. How many were scored."""
        own = np.flatnonzero((self.labels == block.label) == same)
        if not len(own):
            return 0
        with np.errstate(over="ignore", invalid="ignore"):
            reach = self.lengths[own].max() * block.lengths.max()
            if not reach < EXACT:
                return self._scan_large(own, block)
            lower, upper = self.interval(own, block)
        able = np.zeros(lower.shape, bool)
        for j in range(self.low.shape[1]):
            able |= (upper >= self.low[own, j, None]) & (lower <= self.high[own, j, None])
        able &= self.uid[own, None] != block.uid
        at, other = np.nonzero(able)
        scored = len(at)
        scores = np.empty(scored)
        for i in range(0, scored, PAIRS):
            s = slice(i, i + PAIRS)
            scores[s] = np.einsum("ij,ij->i", self.full[own[at[s]]], block.full[other[s]])
        at, ids = own[at], block.ids[other]
        for j in range(self.low.shape[1]):
            hit = np.flatnonzero((scores >= self.low[at, j]) & (scores <= self.high[at, j]))
            hit = hit[np.lexsort((ids[hit], -scores[hit], at[hit]))]
            mine = at[hit]
            new = np.flatnonzero(np.diff(mine, prepend=-1))
            # Beyond its first k of this block none of an anchor counts.
            first = np.arange(len(mine)) - np.repeat(new, np.diff([*new, len(mine)])) < self.k
            hit, mine = hit[first], mine[first]
            new = np.flatnonzero(np.diff(mine, prepend=-1))
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(mine)]):
                pairs = zip(scores[hit[a:b]].astype(np.int64).tolist(), ids[hit[a:b]].tolist())
                self._merge(int(mine[a]), j, list(pairs))
        return scored

    def _scan_large(self, own: np.ndarray, block: Candidates) -> int:
        """The same with Python's integers, for products that doubles do not hold."""
        vectors = [[int(x) for x in v] for v in block.full]
        for a in own.tolist():
            mine = [int(x) for x in self.full[a]]
            pairs = [
                (sum(x * y for x, y in zip(mine, v)), i)
                for v, i, u in zip(vectors, block.ids.tolist(), block.uid.tolist())
                if u != self.uid[a]
            ]
            for j, limits in enumerate(self.ranges[a]):
                self._merge(a, j, [p for p in pairs if limits is None or limits[0] <= p[0] <= limits[1]])
        return len(own) * len(vectors)

    def _merge(self, anchor: int, j: int, pairs: list[tuple[int, int]]) -> None:
        best = self.found.get((anchor, j), []) + pairs
        best.sort(key=lambda p: (-p[0], p[1]))
        self.found[anchor, j] = best = best[: self.k]
        if len(best) == self.k:
            # Rounded down if the score is too large for a double.
            least = np.nextafter(float(best[-1][0]), -np.inf) if abs(best[-1][0]) >= EXACT else best[-1][0]
            self.low[anchor, j] = max(self.low[anchor, j], least)

    def batch(self) -> pa.RecordBatch:
        rows = [
            (int(self.uid[a]), j, id_, max(-LONG - 1, min(LONG, score)))
            for (a, j), best in self.found.items()
            for score, id_ in best
        ]
        columns = zip(*rows) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "wants", "id", "score"])


def _search(batches: Iterator[pa.RecordBatch], k: int, same: bool, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """For each block and slot: the anchors first, then candidates by label."""
    key, anchors, waiting = None, None, []

    def take() -> None:
        if anchors is not None and waiting:
            anchors.scan(Candidates(waiting), same)
        waiting.clear()

    asking: list[tuple] = []
    for batch in batches:
        for block, slot, candidate, *row, wanted in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            if (block, slot) != key:
                take()
                if anchors is not None:
                    yield anchors.batch()
                key, anchors, asking = (block, slot), None, []
            if not candidate:
                asking.append((*row, wanted))
                continue
            if asking:
                anchors, asking = Anchors(asking, k, share), []
            if waiting and (len(waiting) == CHUNK or waiting[0][2] != row[2]):
                take()
            waiting.append(tuple(row))
    take()
    if anchors is not None:
        yield anchors.batch()


def best(
    candidates: DataFrame, anchors: DataFrame, k: int, same: bool, share: tuple[int, int] = (0, 0), wants: int = 1
) -> DataFrame:
    """The first ``k`` candidates for each anchor and each score it asks about.

    Both have ``uid`` and the columns of ``coded``; ``anchors`` also ``wanted``, an array
    of scores or null. Anchors are dealt to blocks and candidates to slots of counted sizes,
    and each block meets each slot in a task. Gives ``anchor`` (its uid), ``wants`` (the
    place of the score, from 0), ``id``, ``score`` and ``rank``.
    """
    spark = candidates.sparkSession
    blocks = max(1, -(-anchors.count() // ANCHORS))
    slots = max(1, -(-candidates.count() // CANDIDATES))
    columns = ["uid", *(c.split()[0] for c in CODED.split(", "))]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    asked = anchors.select(
        dealt(blocks).alias("block"), every(slots).alias("slot"), F.lit(False).alias("candidate"), *columns, "wanted"
    )
    offered = candidates.select(
        every(blocks).alias("block"), dealt(slots).alias("slot"), F.lit(True).alias("candidate"), *columns,
        F.lit(None).cast("array<long>").alias("wanted"),
    )
    found = (
        asked.unionByName(offered)
        .repartition(max(partitions(spark), blocks), "block", "slot")
        .sortWithinPartitions("block", "slot", "candidate", "label", "uid")
        .mapInArrow(lambda b: _search(b, k, same, share), "anchor long, wants long, id long, score long")
    )
    order = Window.partitionBy("anchor", "wants").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)
) -> DataFrame:
    """The hard negatives of each anchor and positive.

    ``vectors`` comes from ``coded``; rows that fulfil the condition ``anchors`` are
    anchors. Positives are an anchor's first ``positives`` other rows of its label by
    inner product, negatives the first ``negatives`` rows of other labels whose score is
    from ``share[0]`` to ``share[1]`` hundredths of the positive's; ties go to smaller
    ids. Rows of one id are rows of their own, on all sides. Scores beyond a long are cut
    to its limits after ranking, and ranges are taken from the cut score. An anchor
    without positives, or a positive without such rows, gives no row; nor does an empty
    table.

    Work grows with anchors times rows, as an exact search must; memory does not. Gives
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and
    ``negative_score``.
    """
    rows = durable(vectors.withColumn("uid", F.monotonically_increasing_id()))
    asking = rows.where(anchors)
    first = best(rows, asking.withColumn("wanted", F.lit(None).cast("array<long>")), positives, same=True)
    first = durable(first.withColumn("wants", F.col("rank").cast("long") - 1))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("wants", "score"))), lambda s: s["score"])
    wanted = first.groupBy(F.col("anchor").alias("uid")).agg(listed.alias("wanted"))
    second = best(rows, durable(asking.join(wanted, "uid")), negatives, same=False, share=share)
    names = asking.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    above = first.select("anchor", "wants", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        second.join(above, ["anchor", "wants"])
        .join(names, "anchor")
        .select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score"),
        )
    )
