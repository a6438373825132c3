"""A trie of conversations: every prefix of turns as an interval of sorted conversations.

Conversations are sorted by the digests of their turns, over all partitions. A prefix of
d turns is then an interval, within which neighbours share d turns or more. A run of
sorted conversations, a shard, has the lengths that neighbours share in a sparse table
of minima; each prefix searches its right end, and the prefix above it its left end, by
halving steps in that table. All prefixes are searched at once, and none needs another.

Everything known of a node is a sum or a minimum over its members, so what a shard knows
of an interval that goes on in the next one is added up by a hash of the prefix. Only the
few prefixes that lie over the edge of a shard take that way.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernwork.llm.common import durable, partitions, stored

# Bytes of the digest of a turn.
WIDTH = 16
# Conversations of a shard, and bytes of their digests, at most (of one more if long).
SHARD, SHARD_BYTES = 1 << 14, 1 << 25
# Turns of a conversation that decide into which partition of the sorted whole it goes.
HEAD = 64
NOTHING = sha256(b"").hexdigest()

NODE = (
    "shard long, node binary, parent binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, open boolean"
)


def turn_digest(role: Column, text: Column) -> Column:
    """A turn's first 16 bytes of SHA-256; the role's length keeps role and text apart."""
    name = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(name.cast("binary"), 256)), 1, WIDTH)


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``digest`` and ``size``, the UTF-8 bytes of the text.

    Null roles and texts are empty. Rows without a conversation (null conv_id) belong to
    none and take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )


def in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(family, conv_id, digests, sizes) of each conversation of rows in its order."""
    key, texts, sizes = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        family, conv = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        raw = batch.column(2).to_pylist()
        size = np.asarray(batch.column(3))
        cuts = np.flatnonzero((np.diff(family) != 0) | (np.diff(conv) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)]):
            here = int(family[a]), int(conv[a])
            if here != key:
                if key:
                    yield *key, b"".join(texts), np.concatenate(sizes)
                key, texts, sizes = here, [], []
            texts.append(b"".join(raw[a:b]))
            sizes.append(size[a:b])
    if key:
        yield *key, b"".join(texts), np.concatenate(sizes)


def rebuilt(turns: DataFrame, every: int = 5, modulus: int = 9) -> DataFrame:
    """Each conversation with the first turns of another put before its own.

    Of conversation c the first h turns are those of c - c % ``every`` (fewer if it has
    fewer, none if it has none), and then come its own after its first h; h is the CRC-32
    of c in decimals, % ``modulus``. The sign of c % ``every`` is that of c. Turns of one
    number come in the order of their digests, a null number first.

    Conversations that share a base lie in one partition, the base first, so this takes
    one shuffle of digests and no text; a task holds one conversation's digests and the
    first turns of its base. Gives ``conv_id``, ``key`` (digests in order) and ``sizes``
    (longs as bytes).
    """
    family = F.col("conv_id") - F.col("conv_id") % every
    ordered = (
        digests(turns)
        .withColumn("family", family)
        .repartition(partitions(turns.sparkSession), "family")
        .sortWithinPartitions("family", F.col("conv_id") != F.col("family"), "conv_id", "turn", "digest")
        .select("family", "conv_id", "digest", "size")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        out, held, base, base_key, base_sizes = [], 0, None, b"", np.zeros(0, np.int64)
        for family, conv, key, sizes in in_runs(batches):
            if family == conv:
                base, base_key, base_sizes = family, key[: modulus * WIDTH], sizes[:modulus]
            h = crc32(str(conv).encode()) % modulus
            if base == family:
                key = base_key[: h * WIDTH] + key[h * WIDTH :]
                sizes = np.concatenate([base_sizes[:h], sizes[h:]])
            else:
                key, sizes = key[h * WIDTH :], sizes[h:]
            out.append((conv, key, sizes.astype("<i8").tobytes()))
            held += len(key)
            if held > 1 << 22 or len(out) >= 10_000:
                yield _batch(out, ["conv_id", "key", "sizes"], [pa.int64(), pa.binary(), pa.binary()])
                out, held = [], 0
        if out:
            yield _batch(out, ["conv_id", "key", "sizes"], [pa.int64(), pa.binary(), pa.binary()])

    return ordered.mapInArrow(run, "conv_id long, key binary, sizes binary")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def shared_turns(one: bytes, other: bytes) -> int:
    """How many first turns two conversations have in common."""
    n = min(len(one), len(other)) // WIDTH
    a = np.frombuffer(one, np.uint64, 2 * n).reshape(n, 2)
    differ = (a != np.frombuffer(other, np.uint64, 2 * n).reshape(n, 2)).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


class Minima:
    """Minima of any stretch of an array, from those of stretches of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 ** len(self.rows) <= len(values):
            last, half = self.rows[-1], 2 ** (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The minimum of each stretch from ``start`` to before ``end``; none is empty."""
        level = np.frexp((end - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), self.rows[0].dtype)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][start[at]], self.rows[k][end[at] - 2**k])
        return out

    def right(self, start: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place from ``start`` on whose value is below ``least``, or the end."""
        at = start.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            row = self.rows[k]
            fits = np.flatnonzero(at < len(row))
            at[fits] += np.where(row[at[fits]] >= least[fits], 2**k, 0)
        return at

    def left(self, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The start of the longest stretch that ends before ``end`` with no value below ``least``."""
        at = end.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            fits = np.flatnonzero(at >= 2**k)
            at[fits] -= np.where(self.rows[k][at[fits] - 2**k] >= least[fits], 2**k, 0)
        return at


def shard_nodes(shard: int, convs: np.ndarray, keys: list[bytes], sizes: list[np.ndarray], before: int, after: int) -> pa.RecordBatch:
    """The nodes of a shard of sorted conversations.

    ``before`` and ``after`` are the turns that its first and last conversation share
    with their neighbours outside; -1 where there is none. Nodes that have members outside,
    and the root, are ``open``: their sums are parts, and they have their hash. A node
    below an open one has the hash of that one as ``parent``.
    """
    n = len(convs)
    length = np.array([len(k) // WIDTH for k in keys], np.int64)
    common = [before, *(shared_turns(a, b) for a, b in zip(keys, keys[1:])), after]
    common = np.array(common, np.int64)
    # Prefixes that begin with each conversation; the first one has all of its own.
    first = common[:-1] + 1
    first[0] = 0
    count = length + 1 - first
    offset = np.concatenate([[0], np.cumsum(count)])
    conv = np.repeat(np.arange(n), count)
    depth = np.arange(offset[-1]) - np.repeat(offset[:-1] - first, count)

    lcp = Minima(common[1:-1])
    # Neighbours share ``depth`` turns up to here.
    end = lcp.right(conv, depth) + 1
    above = np.arange(offset[-1]) - 1
    tops = np.flatnonzero((depth == first[conv]) & (conv > 0))
    left = lcp.left(conv[tops], depth[tops] - 1)
    above[tops] = offset[left] + depth[tops] - 1 - first[left]

    goes_on = (end == n) & (depth <= after)
    began_before = (conv == 0) & (depth <= before)
    is_open = goes_on | began_before | (depth == 0)
    starts = ~began_before
    leaf = np.concatenate([[0], np.cumsum(common[1:] < length)])
    children = np.bincount(above[starts & (depth > 0)], minlength=len(depth))
    last = np.zeros(len(depth), np.int64)
    below_root = np.flatnonzero(depth > 0)
    flat, at = np.concatenate(sizes), np.cumsum(length) - length
    last[below_root] = flat[at[conv[below_root]] + depth[below_root] - 1]
    saved = np.concatenate([[0], np.cumsum((end - conv - starts) * last)])
    least = Minima(convs).of(conv, end)

    # Where the conversations that end at a node are: one after another, from its first.
    same = np.concatenate([[False], (common[1:-1] == length[1:]) & (length[1:] == length[:-1])])
    heads = np.flatnonzero(~same)
    names = convs.tolist()
    ends = np.full(len(depth), None, object)
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), n]):
        node = offset[a] + length[a] - first[a]
        listed = ",".join(map(str, names[a:b]))
        ends[node] = listed if is_open[node] else sha256(listed.encode()).hexdigest()
    ends[~is_open & (ends == None)] = NOTHING  # noqa: E711

    hashed: dict[int, bytes] = {}

    def name(node: int) -> bytes:
        if node not in hashed:
            hashed[node] = sha256(keys[conv[node]][: depth[node] * WIDTH]).digest()
        return hashed[node]

    by_open = np.where(depth > 0, is_open[above], False)
    own = [name(i) if o else None for i, o in enumerate(is_open.tolist())]
    parent = [name(p) if o else None for p, o in zip(above.tolist(), by_open.tolist())]
    known = pa.array(least[above], mask=by_open | (depth == 0))
    columns = [
        pa.array(np.full(len(depth), shard)), pa.array(own, pa.binary()), pa.array(parent, pa.binary()),
        pa.array(depth), pa.array(least), known, pa.array(end - conv), pa.array(children.astype(np.int64)),
        pa.array(leaf[end] - leaf[conv]), pa.array(saved[offset[end]] - saved[:-1]), pa.array(ends, pa.string()),
        pa.array(is_open),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NODE.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch], edges: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """The nodes of a partition of sorted conversations, a shard at a time."""
    rows, held, number, part, before = [], 0, 0, None, -1

    def done(after: int) -> pa.RecordBatch:
        convs, keys, sizes = zip(*rows)
        lists = [np.frombuffer(s, "<i8") for s in sizes]
        return shard_nodes((part << 32) + number, np.array(convs, np.int64), list(keys), lists, before, after)

    for batch in batches:
        for pid, conv, key, sizes in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if part is None:
                part, before = pid, edges[pid][0]
            if len(rows) >= SHARD or held >= SHARD_BYTES:
                after = shared_turns(rows[-1][1], key)
                yield done(after)
                rows, held, number, before = [], 0, number + 1, after
            rows.append((conv, key, sizes))
            held += len(key)
    if rows:
        yield done(edges[part][1])


def _edges(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition that has rows, the turns its edges share with the neighbours'.

    First and last key of each partition meet in Spark; two numbers of each partition
    come to the driver.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, first, last = None, None, None
        for batch in batches:
            if batch.num_rows:
                last = batch.column(1)[batch.num_rows - 1].as_py()
                if pid is None:
                    pid, first = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
        if pid is not None:
            yield _batch([(pid, first, last)], ["pid", "first", "last"], [pa.int64(), pa.binary(), pa.binary()])

    shared = F.udf(lambda one, other: shared_turns(bytes(one), bytes(other)), "long", useArrow=False)
    found = durable(ordered.select("pid", "key").mapInArrow(ends, "pid long, first binary, last binary"))
    pids = sorted(r["pid"] for r in found.select("pid").collect())
    spark = ordered.sparkSession
    pairs = spark.createDataFrame([*zip(pids, pids[1:])], "pid long, following long")
    others = found.select(F.col("pid").alias("following"), F.col("first").alias("other"))
    met = found.join(pairs, "pid").join(others, "following").select("pid", shared("last", "other").alias("n"))
    after = {r["pid"]: r["n"] for r in met.collect()}
    return {p: (after.get(q, -1), after.get(p, -1)) for q, p in zip([None, *pids], pids)}


def _whole_ends(chunks: DataFrame, count: int) -> DataFrame:
    """The digest of each node's list of ids, which reaches over shards.

    A list is hashed from its chunks in order, one chunk at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for name, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != node:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = name, sha256(listed.encode())
                else:
                    state.update(b"," + listed.encode())
            if out:
                yield _batch(out, ["node", "ends"], [pa.binary(), pa.string()])
                out = []
        if node is not None:
            yield _batch([(node, state.hexdigest())], ["node", "ends"], [pa.binary(), pa.string()])

    ordered = chunks.repartition(count, "node").sortWithinPartitions("node", "shard").select("node", "ends")
    return ordered.mapInArrow(run, "node binary, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """Every distinct prefix of conversations, with what holds of those that begin with it.

    ``conversations`` has a row for each ``conv_id`` with ``key`` and ``sizes`` as
    ``rebuilt`` gives them. Gives for each node ``conv_id`` (the smallest member),
    ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``. Conversations without turns are
    members of the root and end there. No conversations give no nodes, not even a root.
    Turns are alike if the 128 bits of their digests are.

    A conversation's digests travel in one row, 16 bytes a turn. The whole is sorted
    by ranges; a group of copies of any size is spread over ranges by its ids, up to
    ``HEAD`` turns long. The join that gives children their parent goes by shard and
    parent, so it stays even however many children a node has.
    """
    spark = conversations.sparkSession
    count = partitions(spark)
    head, is_long = F.substring("key", 1, HEAD * WIDTH), F.length("key") > HEAD * WIDTH
    spread = F.when(~is_long, F.col("conv_id"))
    ordered = durable(
        conversations.repartitionByRange(count, head, is_long, spread)
        .sortWithinPartitions("key", "conv_id")
        .select(F.spark_partition_id().cast("long").alias("pid"), "key", "conv_id", "sizes")
    )
    edges = _edges(ordered)
    nodes = stored(
        ordered.select("pid", "conv_id", "key", "sizes").mapInArrow(lambda b: _shards(b, edges), NODE), "trie"
    )
    parts = nodes.where("open")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    kept = [F.min(c).alias(c) for c in ("depth", "parent", "conv_id")]
    merged = durable(parts.groupBy("node").agg(*kept, *sums))
    found = _whole_ends(parts.where("ends IS NOT NULL").select("node", "shard", "ends"), count)
    names = merged.select("node", F.col("conv_id").alias("parent_conv_id"))
    # What the parents of nodes within a shard are called, for each shard once.
    of_shard = parts.select("shard", "node").join(names, "node").withColumnRenamed("node", "parent")
    closed = nodes.where("NOT open")
    inner = closed.where("parent IS NULL")
    outer = closed.where("parent IS NOT NULL").drop("parent_conv_id").join(of_shard, ["shard", "parent"])
    above = names.withColumnRenamed("node", "parent")
    over = (
        merged.join(above, "parent", "left").join(found, "node", "left").fillna({"ends": NOTHING})
    )
    columns = [
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.col("ends").alias("ends_sha256"),
    ]
    return inner.select(*columns).unionByName(outer.select(*columns)).unionByName(over.select(*columns))
