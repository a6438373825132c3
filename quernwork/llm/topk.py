"""Exact top-k by inner product: vectors by descending length, pruned by bounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernwork.llm.common import bounded_batches, partitions

# Queries that one task compares with its candidates, how many these are on average, and
# candidates in one product.
QUERIES = 4096
SLOT = 8192
CANDIDATES = 1024
# Rotated dimensions whose products are summed before the bound on the rest is taken.
LEADING = 16
# About how many vectors the rotation is fitted on. It decides how much is pruned,
# never what is found.
SAMPLE = 4096
# Products of lengths below this are exact sums in doubles; others use Python's integers.
EXACT = 2.0**52
LONG = 2**63 - 1


def whole_vectors(rows: DataFrame, id_: str, vector: str, factor: float = 256.0) -> DataFrame:
    """Vectors of the whole numbers floor(``factor`` * x), with their lengths.

    Rows with a null id, a null vector, or a vector with null or non-finite
    components, also after scaling, take no part. Gives ``id``, ``length`` and
    ``vector``, doubles as bytes.
    """
    bounded_batches(rows.sparkSession)
    plain = rows.select(
        F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")
    ).where(F.col("id").isNotNull() & F.col("v").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths, kept = [], [], []
            for id_, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                with np.errstate(over="ignore", invalid="ignore"):
                    values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    whole = np.floor(factor * values)
                    if v.values.null_count or not np.isfinite(whole).all():
                        continue
                    ids.append(id_)
                    lengths.append(float(np.sqrt(whole @ whole)))
                    kept.append(whole.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(lengths, pa.float64()), pa.array(kept, pa.binary())],
                ["id", "length", "vector"],
            )

    return plain.mapInArrow(run, "id long, length double, vector binary")


def rotation(vectors: DataFrame, n: int) -> np.ndarray:
    """Right singular vectors of a sample, the strongest first, for padded vectors.

    The sample is a share of the rows chosen by a hash of the id, so that about
    ``SAMPLE`` come to the driver, and never over twice that.
    """
    per = max(1, n // SAMPLE)
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(per)) == 0).limit(2 * SAMPLE)
    found = [np.frombuffer(r["vector"]) for r in chosen.select("vector").collect()]
    found = [v for v in found if np.abs(v).max(initial=0) < 1e100]
    dims = max([len(v) for v in found], default=0)
    gram = np.zeros((dims, dims))
    for v in found:
        gram[: len(v), : len(v)] += np.outer(v, v)
    _, basis = np.linalg.eigh(gram)
    return basis[:, ::-1]


def _matrix(vectors: list[bytes], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        row = np.frombuffer(v)
        out[i, : len(row)] = row
    return out


class _Side:
    """Vectors with their rotated leading parts and the lengths of what remains."""

    def __init__(self, ids, lengths, vectors: list[bytes], dims: int, basis: np.ndarray) -> None:
        self.ids = np.array(ids, np.int64)
        self.lengths = np.array(lengths)
        self.full = _matrix(vectors, dims)
        with np.errstate(over="ignore", invalid="ignore"):
            lead = self.full[:, : len(basis)] @ basis[:, :LEADING]
            self.lead = lead
            rest = self.lengths**2 - (lead * lead).sum(axis=1)
        # A little longer than it is, against rounding.
        self.rest = np.sqrt(np.maximum(rest, 0)) + 1e-6 * self.lengths


class _Best:
    """The best ``k`` of each query so far: pairs of score and id, best first."""

    def __init__(self, queries: _Side, k: int) -> None:
        self.queries, self.k = queries, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)

    def scan(self, block: _Side) -> bool:
        """Take in a block; False if no later, shorter vector can count for any query."""
        q = self.queries
        with np.errstate(over="ignore", invalid="ignore"):
            reach = q.lengths * block.lengths.max() * (1 + 1e-9)
            active = np.flatnonzero(~(reach < self.least))
            if not len(active):
                return False
            bound = q.lead[active] @ block.lead.T + np.outer(q.rest[active], block.rest)
            # Not less than: what cannot be compared is not pruned.
            able = ~(bound < self.least[active, None] - 1e-6 * reach[active, None])
        able &= q.ids[active, None] != block.ids[None, :]
        columns = np.flatnonzero(able.any(axis=0))
        if not len(columns):
            return True
        able = able[:, columns]
        if reach.max() < EXACT:
            scores = q.full[active] @ block.full[columns].T
            scores[~able] = -np.inf
            for i in np.flatnonzero((scores >= self.least[active, None]).any(axis=1)):
                row = scores[i]
                floor = self.least[active[i]]
                if len(row) > self.k:
                    floor = max(floor, np.partition(row, -self.k)[-self.k])
                hits = np.flatnonzero((row >= floor) & able[i])
                self._merge(active[i], [int(s) for s in row[hits]], block.ids[columns[hits]])
        else:
            whole = [[int(x) for x in v] for v in block.full[columns]]
            for i, a in enumerate(active):
                mine, hits = [int(x) for x in q.full[a]], np.flatnonzero(able[i])
                exact = [sum(x * y for x, y in zip(mine, whole[j])) for j in hits]
                self._merge(a, exact, block.ids[columns[hits]])
        return True

    def _merge(self, query: int, scores: list[int], ids: np.ndarray) -> None:
        both = self.found[query] + list(zip(scores, ids.tolist()))
        both.sort(key=lambda pair: (-pair[0], pair[1]))
        self.found[query] = both[: self.k]
        if len(both) >= self.k:
            # Rounded down if the score is too large for a double.
            self.least[query] = np.nextafter(float(both[self.k - 1][0]), -np.inf)


def _search(
    batches: Iterator[pa.RecordBatch], k: int, dims: int, basis: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """For each (block of queries, slot): the queries first, then candidates by length."""
    names = ["query_row", "query_id", "vec_id", "score"]
    key, best, block, waiting, going = None, None, None, [], True

    def side(rows: list[tuple]) -> _Side:
        ids, lengths, vectors = zip(*rows)
        return _Side(ids, lengths, list(vectors), dims, basis)

    def result() -> pa.RecordBatch:
        rows = [
            (block * 2**32 + i, q, v, max(-LONG - 1, min(LONG, s)))
            for i, (q, found) in enumerate(zip(best.queries.ids.tolist(), best.found))
            for s, v in found
        ]
        arrays = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(6)]
        for b, slot, candidate, id_, length, vector in zip(*columns):
            if (b, slot) != key:
                if best is not None:
                    if waiting and going:
                        best.scan(side(waiting))
                    yield result()
                key, best, block, waiting, going = (b, slot), None, b, [], True
            if candidate and best is None:
                # A slot without queries: an empty block of them.
                if not waiting:
                    going = False
                    continue
                best, waiting = _Best(side(waiting), k), []
            if going:
                waiting.append((id_, length, vector))
                if candidate and len(waiting) == CANDIDATES:
                    going, waiting = best.scan(side(waiting)), []
    if best is not None:
        if waiting and going:
            best.scan(side(waiting))
        yield result()


def top_inner_products(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` candidates of highest inner product for every query, ties to smaller ids.

    Both sides come from ``whole_vectors``. Queries are dealt to blocks and
    candidates to slots by hashes; each block meets each slot in a task that takes
    the candidates in order of their lengths. A candidate is left out for a query
    if the product over the leading rotated dimensions, plus the product of the
    lengths of what remains (Cauchy-Schwarz), is below the query's k-th score so
    far; the scan ends when the same holds for the whole lengths. What is left is
    scored exactly. Each (query, slot) gives at most ``k`` rows, and those of a
    query are ranked in the end.

    Work grows with queries times candidates, as an exact search of vectors of
    equal length must; memory does not: a task holds ``QUERIES`` queries and
    ``CANDIDATES`` candidates, and reads some ``SLOT`` candidates for each slot.

    A candidate with the query's own id is left out. Rows of one id count each as
    a row of its own, on both sides: a repeated query has each rank once per row.
    Shorter vectors are padded with zeros. Scores beyond a long are cut to its
    limits, after ranking. No queries, or no candidates, give no rows.

    Gives ``query_id``, ``rank``, ``vec_id`` and ``score``.
    """
    spark = vectors.sparkSession
    n, dims = vectors.agg(F.count("*"), F.max(F.length("vector"))).first()
    n_queries, dims_too = queries.agg(F.count("*"), F.max(F.length("vector"))).first()
    basis = rotation(vectors, n)
    blocks = max(1, -(-n_queries // QUERIES))
    slots = max(1, -(-n // SLOT))
    asked = queries.select(
        F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
        F.lit(False).alias("candidate"),
        "id",
        "length",
        "vector",
    )
    offered = vectors.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id", "vector"), F.lit(slots)).cast("int").alias("slot"),
        F.lit(True).alias("candidate"),
        "id",
        "length",
        "vector",
    )
    width = max(dims or 0, dims_too or 0) // 8
    found = (
        asked.unionByName(offered)
        .repartition(max(partitions(spark), blocks), "block", "slot")
        .sortWithinPartitions("block", "slot", "candidate", F.desc("length"), "id", "vector")
        .mapInArrow(
            partial(_search, k=k, dims=width, basis=basis),
            "query_row long, query_id long, vec_id long, score long",
        )
    )
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
