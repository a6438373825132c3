"""Removing what a corpus has said before: repeated strings of 100 bytes.

Where the windows of all texts that could be equal meet, they are sorted as suffixes:
Burrows-Wheeler transforms of shards are merged, and an interval of suffixes that share
100 bytes is a repeated string. What could be equal is found by anchors (``anchors``).

1. Each text gives its runs: anchor, a digest of the run's bytes, document, mark of the
   text, and place.
2. Runs meet by anchor. Of runs with equal bytes all but the first are covered. An
   anchor that is left with one run, in which nothing can repeat, is done.
3. The bytes of the other runs are fetched and merged, anchor by anchor; of equal
   windows all but the first are covered.
4. Covered windows meet their text, and the bytes they cover are removed.

Only 5 longs of a run go through a shuffle, and texts, compressed, twice.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from quernwork.llm.anchors import SPAN, WINDOW, runs
from quernwork.llm.bwt import Shard, interleave
from quernwork.llm.common import BATCH_ROWS, bounded_batches, durable, free_name, partitions
from quernwork.operators.skew import broadcast_up_to, heavy_list

# Bytes of runs that are merged at once, and of one shard; what a merge looks at then
# stays in the cache of a core.
MERGED = 1 << 17
SHARD = 1 << 16
# Distinct runs of one anchor above which they are dealt anew, window by window.
LARGE = 20_000
# New runs after which a task forgets those that it has not met since as many before.
REMEMBERED = 50_000
# Rows of runs that are looked at together.
SMALL_ROWS = 20_000
# Bits of an anchor that decide where runs meet. Others than equal windows may meet.
ANCHOR_BITS = 40

# A place is one long: 32 bits of the first window, 8 of the number of windows, of which
# the top one says that they may be equal. The text is told by its id and its mark.
_FIRST, _SEVERAL = 8, 128
_LAST_ID = np.iinfo(np.int64).max


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some ``SMALL_ROWS`` rows."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= SMALL_ROWS:
            yield pa.concat_batches(waiting)
            waiting = []
    if waiting:
        yield pa.concat_batches(waiting)


def _mark(text: bytes) -> int:
    """64 bits of a hash that tell texts of one id apart; its lowest 16 order first."""
    found = xxhash.xxh64_intdigest(text)
    return ((found & 0xFFFF) << 48 | found >> 16) - 2**63


def _rows(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names)


_RUN = ["anchor", "digest", "doc", "mark", "place"]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of all texts; anchor -1 marks one that an earlier one covers for sure.

    What comes again and again is remembered for as long as it does, so of a common
    passage a task gives on one run that has to meet others, however often it has it.
    """
    lately: dict[int, tuple[int, int, int]] = {}
    before: dict[int, tuple[int, int, int]] = {}
    for batch in batches:
        out: list[list[np.ndarray]] = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            data = (text or "").encode()
            if len(data) < WINDOW:
                continue
            doc = _LAST_ID if doc is None else doc
            anchor, first, count, several = runs(np.frombuffer(data, np.uint8))
            ends = (first + count + WINDOW - 1).tolist()
            digest = [xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(first.tolist(), ends)]
            mark = _mark(data)
            place = (first << _FIRST) | count | (several * _SEVERAL)
            anchor = (anchor >> np.uint64(64 - ANCHOR_BITS)).astype(np.int64)
            for i, (d, p) in enumerate(zip(digest, place.tolist())):
                own = (doc, mark, p)
                least = lately.get(d) or before.get(d)
                if least is None or own < least:
                    least = own
                elif own > least:
                    anchor[i] = -1
                lately[d] = least
            if len(lately) > REMEMBERED:
                lately, before = {}, lately
            digest = np.array(digest, np.uint64).view(np.int64)
            out.append([anchor, digest, np.full(len(first), doc), np.full(len(first), mark), place])
        if out:
            yield _rows(_RUN, [np.concatenate(c) for c in zip(*out)])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of anchor, digest, document, mark and place: covered ones, and open ones.

    A run like one before it is covered (anchor -1). The first of its kind is open if
    its anchor has others, or it may repeat itself. The rest is dropped. Only the last
    run of a batch is kept, to be judged with the next.
    """
    held: list[np.ndarray] | None = None
    last: tuple[int, ...] | None = None  # anchor, digest, and first of its kind
    for batch in itertools.chain(_gathered(batches), [None]):
        if batch is None:
            now = held or [np.zeros(0, np.int64)] * 5
            following = None
        else:
            columns = [np.asarray(batch.column(i)) for i in range(5)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            if not len(columns[0]):
                continue
            now, held = [c[:-1] for c in columns], [c[-1:] for c in columns]
            following = int(held[0][0])
        anchor, digest, doc, mark, place = now
        n = len(anchor)
        if not n:
            continue
        given = anchor == -1
        before_a = np.concatenate([[-2 if last is None else last[0]], anchor[:-1]])
        before_d = np.concatenate([[0 if last is None else last[1]], digest[:-1]])
        same = (anchor == before_a) & (digest == before_d) & ~given
        # The first of the kind that each run belongs to.
        kind = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        first_doc, first_mark, first_place = doc[kind], mark[kind], place[kind]
        if last is not None and kind[0] < 0:
            carried = kind < 0
            first_doc[carried], first_mark[carried], first_place[carried] = last[2:]
        covered = given | (same & ((doc != first_doc) | (mark != first_mark) | (place != first_place)))
        # Whether an anchor has several kinds; one that goes on beyond the batch may have.
        edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        kinds = np.add.reduceat((~same).astype(np.int64), edge)
        more = np.repeat(kinds > 1, np.diff(np.concatenate([edge, [n]])))
        more |= (anchor == before_a[0]) | (anchor == (-2 if following is None else following))
        open_ = ~same & ~given & (more | ((place & _SEVERAL) > 0))
        out = covered | open_
        if out.any():
            given_on = [np.where(covered, -1, anchor), digest, doc, mark, place]
            yield _rows(_RUN, [c[out] for c in given_on])
        last = tuple(int(c[-1]) for c in (anchor, digest, first_doc, first_mark, first_place))


class _Beside:
    """Texts in a sorted stream, each followed by the rows that belong to it."""

    def __init__(self, kept: int) -> None:
        self.kept = kept

    def __call__(self, batches) -> Iterator[tuple[list[tuple], bytes, list[tuple[int, int]]]]:
        """(rows with this text, the text, [(place, anchor)]) for each text."""
        key, texts, data, items = None, [], b"", []
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4 + self.kept)]
            for doc, mark, place, anchor, *rest in zip(*columns):
                if (doc, mark) != key:
                    if texts:
                        yield texts, data, items
                    key, texts, data, items = (doc, mark), [], b"", []
                if place < 0:
                    if not texts:
                        data = unpack(rest[0]) if rest[0] else b""
                    texts.append(tuple(rest[1:]))
                else:
                    items.append((place, anchor))
        if texts:
            yield texts, data, items


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of open runs; of a large anchor, below -1, each window as a run of its own."""
    names = [*_RUN, "data"]
    out: list[tuple] = []

    def block() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        types = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    for texts, data, items in _Beside(3)(batches):
        for place, anchor in items:
            first, count = (place >> _FIRST) & 0xFFFFFFFF, place & (_SEVERAL - 1)
            if anchor < -1:
                for at in range(first, first + count):
                    window = data[at : at + WINDOW]
                    digest = xxhash.xxh64_intdigest(window) - 2**63
                    again = xxhash.xxh64_intdigest(window, 1) >> (64 - ANCHOR_BITS)
                    out.append((again, digest, *texts[0], at << _FIRST | 1, None))
            else:
                piece = data[first : first + count + WINDOW - 1]
                out.append((anchor, 0, *texts[0], place, piece))
        if len(out) >= 4 * BATCH_ROWS:
            yield block()
    if out:
        yield block()


def covered_windows(
    pieces: list[bytes], docs: np.ndarray, marks: np.ndarray, places: np.ndarray
) -> tuple:
    """Of the windows of all pieces, those equal to one of an earlier document or place.

    Gives documents, marks and places, a row for windows in a row.
    """
    shards, group, size = [], [], 0
    for piece in pieces:
        group.append(piece)
        size += len(piece) + 1
        if size >= SHARD:
            shards.append(Shard(group))
            group, size = [], 0
    if group:
        shards.append(Shard(group))
    merged, interval = interleave(shards, WINDOW)
    lengths = np.array([len(p) + 1 for p in pieces])
    starts = np.cumsum(lengths) - lengths
    count = places & (_SEVERAL - 1)
    piece = np.repeat(np.arange(len(pieces)), lengths)
    inside = np.arange(len(piece)) - starts[piece]
    window = (inside < count[piece])[merged]
    suffix, interval = merged[window], interval[window]
    # Only intervals of two or more windows matter.
    again = np.zeros(len(interval), bool)
    again[1:] = interval[1:] == interval[:-1]
    again[:-1] |= again[1:]
    suffix, interval = suffix[again], interval[again]
    owner = piece[suffix]
    where = (places[owner] >> _FIRST) + inside[suffix]
    order = np.lexsort((where, marks[owner], docs[owner], interval))
    owner, where, interval = owner[order], where[order], interval[order]
    late = np.zeros(len(order), bool)
    late[1:] = interval[1:] == interval[:-1]
    owner, where = owner[late], where[late]
    order = np.lexsort((where, owner))
    owner, where = owner[order], where[order]
    if not len(owner):
        return (np.zeros(0, np.int64),) * 3
    edge = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (where[1:] != where[:-1] + 1)]))
    n = np.diff(np.concatenate([edge, [len(owner)]]))
    return docs[owner[edge]], marks[owner[edge]], (where[edge] << _FIRST) | n


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Open runs in order of anchor: whole anchors are merged, several at once."""
    pieces, docs, marks, places, size, current = [], [], [], [], 0, None

    def found() -> pa.RecordBatch:
        found = covered_windows(pieces, np.array(docs), np.array(marks), np.array(places))
        return _rows(["doc", "mark", "place"], list(found))

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(5)]
        for anchor, doc, mark, place, data in zip(*columns):
            if anchor != current and size >= MERGED:
                yield found()
                pieces, docs, marks, places, size = [], [], [], [], 0
            current = anchor
            pieces.append(data)
            docs.append(doc)
            marks.append(mark)
            places.append(place)
            size += len(data) + 1
    if pieces:
        yield found()


def _remove(batches: Iterator[pa.RecordBatch], kept: int) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes that covered windows cover."""
    head = next(batches, None)
    if head is None:
        return
    batches = itertools.chain([head], batches)
    counts = [pa.field(name, pa.int64()) for name in ("n_bytes", "n_removed", "n_spans")]
    schema = pa.schema([*list(head.schema)[7:], *counts, pa.field("kept", pa.binary())])
    out: list[tuple] = []

    def block() -> pa.RecordBatch:
        columns = list(zip(*out))
        out.clear()
        arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    size = 0
    for texts, data, items in _Beside(kept)(batches):
        change = np.zeros(len(data) + 1, np.int32)
        for place, _ in items:
            first, count = (place >> _FIRST) & 0xFFFFFFFF, place & (_SEVERAL - 1)
            change[first] += 1
            change[first + count + WINDOW - 1] -= 1
        gone = np.cumsum(change[:-1]) > 0
        begun = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) and gone[0])
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        for i, row in enumerate(texts):
            # Of rows alike in id and text, the first says it all.
            whole = i > 0 and len(data) >= WINDOW
            removed, spans = (len(data), 1) if whole else (int(gone.sum()), begun)
            out.append((*row[2:], len(data), removed, spans, b"" if whole else rest))
        size += len(rest)
        if len(out) >= BATCH_ROWS or size > 1 << 24:
            yield block()
            size = 0
    if out:
        yield block()


def _meeting() -> Column:
    """What runs meet by: the anchor, but covered ones need not and go apart.

    Neither the runs of one passage in many texts share it, nor those of one text.
    """
    apart = F.col("digest").bitwiseXOR(F.col("doc")).bitwiseXOR(F.col("mark"))
    return F.when(F.col("anchor") == -1, apart).otherwise(F.col("anchor"))


def remove_repeats(rows: DataFrame, id_: str, text: str, into: str = "repeats") -> DataFrame:
    """Every row with the bytes of its text that no earlier text has said.

    A byte goes if a string of 100 bytes covers it that also starts earlier: in a row
    of smaller id, or in the same text before. Strings are judged on the texts as
    given, UTF-8; overlaps count; they never cross texts. Null texts are empty. Null
    ids come last. Rows of one id go by a hash of 64 bits of their text; rows of one id and text
    are one row and its copies, which are removed whole if they have 100 bytes. Other
    columns are kept, whatever their names.

    In place of the text stands the struct ``into``: ``n_bytes``, ``n_removed``,
    ``n_spans`` (runs of removed bytes) and ``kept``, the bytes that remain.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    names = rows.columns
    doc = free_name(names, "doc")
    plain = rows.withColumn(doc, F.coalesce(F.col(id_).cast("long"), F.lit(int(_LAST_ID))))
    source = plain.select(F.col(doc).alias("doc"), F.col(text).cast("string").alias("text"))
    run_schema = "anchor long, digest long, doc long, mark long, place long"
    bounded_batches(spark)
    scanned = source.mapInArrow(_scan, run_schema)
    met = scanned.withColumn("spread", _meeting()).repartition(n, "spread").drop("spread")
    settled = durable(met.sortWithinPartitions(*_RUN).mapInArrow(_settle, run_schema))
    large, n_large = heavy_list(settled.where("anchor >= 0"), ["anchor"], LARGE)
    pack = _packed()

    def beside(items: DataFrame, carried: list[str]) -> DataFrame:
        """Texts and the rows of ``items`` that belong to them, the texts first."""
        empty = [F.lit(None).cast(plain.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(carried)]
        texts = plain.select(
            F.col(doc).alias("doc"),
            pack(F.col(text)).alias("packed"),
            *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)],
        )
        texts = texts.select(
            "doc",
            F.col("packed.mark").alias("mark"),
            F.lit(-1).cast("long").alias("place"),
            F.lit(-1).cast("long").alias("anchor"),
            F.col("packed.data").alias("data"),
            F.col("doc").alias("own"),
            F.col("packed.mark").alias("own_mark"),
            *[f"c{i}" for i in range(len(carried))],
        )
        others = items.select(
            "doc",
            "mark",
            "place",
            "anchor",
            F.lit(None).cast("binary").alias("data"),
            "doc",
            "mark",
            *empty,
        )
        return (
            texts.union(others)
            .repartition(n, "doc", "mark")
            .sortWithinPartitions("doc", "mark", "place")
        )

    covered = settled.where("anchor < 0").select("doc", "mark", "place", "anchor")
    opened = settled.where("anchor >= 0")
    if n_large:
        marked = broadcast_up_to(large.withColumn("large", F.lit(True)), n_large)
        turned = F.when(F.col("large"), -2 - F.col("anchor")).otherwise(F.col("anchor"))
        opened = opened.join(marked, "anchor", "left").withColumn("anchor", turned)
    fetched = beside(opened, []).mapInArrow(_fetch, f"{run_schema}, data binary")
    if n_large:
        fetched = durable(fetched)
    met = fetched.where("data IS NOT NULL").select("anchor", "doc", "mark", "place", "data")
    met = met.repartition(n, "anchor").sortWithinPartitions("anchor", "doc", "mark", "place")
    merged = met.mapInArrow(_merge, "doc long, mark long, place long")
    if n_large:
        # Windows that meet by their own digest: equal ones are runs of one kind.
        windows = fetched.where("data IS NULL").drop("data").repartition(n, "anchor")
        found = windows.sortWithinPartitions(*_RUN).mapInArrow(_settle, run_schema)
        merged = merged.union(found.where("anchor < 0").select("doc", "mark", "place"))
    none = F.lit(-1).cast("long").alias("anchor")
    covered = covered.union(durable(merged).select("doc", "mark", "place", none))
    added = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
    others = [c for c in names if c != text]
    fields = [T.StructField(f"c{i}", plain.schema[c].dataType) for i, c in enumerate(others)]
    schema = T.StructType(fields + added)
    width = 3 + len(others)
    removed = beside(covered, others).mapInArrow(lambda b: _remove(b, width), schema)
    kept = [F.col(f"c{i}").alias(c) for i, c in enumerate(others)]
    return removed.select(*kept, F.struct(*[f.name for f in added]).alias(into))


def _packed():
    """Texts as compressed bytes, with the hash that tells texts of one id apart."""
    @arrow_udf("mark long, data binary")
    def run(texts: pa.Array) -> pa.Array:
        pack = zstandard.ZstdCompressor(level=1).compress
        data = [(t or "").encode() for t in texts.to_pylist()]
        marks = pa.array([_mark(d) for d in data], pa.int64())
        return pa.StructArray.from_arrays([marks, pa.array([pack(d) for d in data], pa.binary())], ["mark", "data"])

    return run


def readable(data: Column) -> Column:
    """Bytes as text, without what is left of characters that were cut."""

    @arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([v.decode("utf-8", "ignore") for v in values.to_pylist()], pa.string())

    return run(data)
