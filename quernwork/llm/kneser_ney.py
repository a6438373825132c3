"""A bigram model with interpolated modified Kneser-Ney smoothing, counted in Spark.

Words are hashes. Texts are read into packs: their distinct words, and the texts as
places in that list. Packs send their distinct bigrams to shards by the first word, and
their distinct words to shards of words. A shard merges what it is sent into sorted
hash arrays, writes them to a file of its task and answers every pack from the mapped
file. What it has counted for a word goes on to the shards of words. Packs, brought
together with their answers, give the scores of their texts.

So the model is never whole anywhere: it grows with the corpus, and so do its shards.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernwork.llm.common import bounded_batches, partitions, stored

# Tokens of a pack, about.
PACK = 600_000
# Hashes of what stands before a text and what ends it.
BEGIN, END = 1, 2
# A first word that begins more than this share of all bigrams is dealt out by the
# second word too. Estimated on about so many texts.
HOT = 0.002
SAMPLED = 2000
# Words whose hashes a worker remembers.
REMEMBERED = 250_000

_WORD_BYTES, _NEXT_BYTES = 6, 6


class _Hashes(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = max(xxhash.xxh64_intdigest(word), 3)
        return found


_hashes = _Hashes()


def hashed(text: str | None) -> list[int]:
    """The hashes of a text's tokens: words, A-Z in lower case, then one end."""
    return [_hashes[w] for w in (text or "").encode().lower().split()] + [END]


def _cut(hashes: np.ndarray, size: int) -> bytes:
    """The upper bytes of each hash."""
    return hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _whole(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def pack(**arrays: np.ndarray | bytes) -> bytes:
    """Arrays of whole numbers, or bytes, as one compressed string."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    parts = []
    for data in arrays.values():
        if not isinstance(data, bytes):
            # Bytes of one weight together: small numbers leave long runs of zeros.
            raw = np.ascontiguousarray(data, np.int64).view(np.uint8).reshape(-1, 8)
            data = raw.T.tobytes()
        part = squeeze(data)
        parts += [len(part).to_bytes(8, "little"), part]
    return b"".join(parts)


def unpack(data: bytes) -> list[bytes]:
    out, at, spread = [], 0, zstandard.ZstdDecompressor().decompress
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        out.append(spread(data[at + 8 : at + 8 + size]))
        at += 8 + size
    return out


def _numbers(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.ascontiguousarray(raw).view(np.int64).reshape(-1)


@dataclass(frozen=True)
class Deal:
    """Which shard a word or a bigram belongs to."""

    shards: int
    hot: frozenset[int]

    def word(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(40)) * np.uint64(self.shards) >> np.uint64(24)).astype(np.int64)

    def bigram(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        found = self.word(first)
        if self.hot:
            hot = np.isin(first, np.array(list(self.hot), np.uint64))
            mixed = second[hot] * np.uint64(0x9E3779B97F4A7C15)
            found[hot] = self.word(mixed)
        return found


class Pack:
    """Texts as places in the sorted list of their words, and their distinct bigrams."""

    def __init__(self, words: np.ndarray, texts: np.ndarray, lengths: np.ndarray, learn: np.ndarray, deal: Deal):
        self.words, self.lengths = words, lengths
        starts = np.cumsum(lengths) - lengths
        begin = len(words)
        first = np.empty(len(texts), np.int64)
        first[1:] = texts[:-1]
        first[starts] = begin
        code = first * (begin + 1) + texts
        found, self.of = np.unique(code, return_inverse=True)
        learned = np.repeat(learn, lengths)
        self.counts = np.bincount(self.of[learned], minlength=len(found))
        self.word_counts = np.bincount(texts[learned], minlength=len(words))
        self.first, self.second = found // (begin + 1), found % (begin + 1)
        every = np.append(words, np.uint64(BEGIN))
        self.first_hash, self.second_hash = every[self.first], words[self.second]
        shard = deal.bigram(self.first_hash, self.second_hash)
        # Bigrams in the order of their shards, where answers come in the same order.
        self.order = np.argsort(shard, kind="stable")
        self.shards = shard[self.order]


def _row(kind: str, shard: int, number: int, data: bytes) -> tuple:
    return kind, shard, number, data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
    return pa.RecordBatch.from_arrays(arrays, ["kind", "shard", "pack", "data"])


_SCHEMA = "kind string, shard long, pack long, data binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts into packs: ids, what is learned from, and texts as places in words."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    ids, nulls, learn, lengths, tokens = [], [], [], [], []

    def block() -> pa.RecordBatch:
        words, texts = np.unique(np.array(tokens, np.uint64), return_inverse=True)
        data = pack(
            ids=np.array(ids, np.int64).tobytes(),
            nulls=np.array(nulls, np.uint8).tobytes(),
            learn=np.array(learn, np.uint8).tobytes(),
            lengths=np.array(lengths),
            words=words.tobytes(),
            texts=texts,
        )
        for held in (ids, nulls, learn, lengths, tokens):
            held.clear()
        return _batch([_row("pack", 0, number, data)])

    for batch in batches:
        for id_, text, learned in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            found = hashed(text)
            ids.append(id_ or 0)
            nulls.append(id_ is None)
            learn.append(learned)
            lengths.append(len(found))
            tokens += found
            if len(tokens) >= PACK:
                yield block()
                number += 1
    if ids:
        yield block()


def _unread(data: bytes, deal: Deal) -> tuple[np.ndarray, np.ndarray, np.ndarray, Pack]:
    ids, nulls, learn, lengths, words, texts = unpack(data)
    learned = np.frombuffer(learn, np.uint8) > 0
    found = Pack(np.frombuffer(words, np.uint64), _numbers(texts), _numbers(lengths), learned, deal)
    return np.frombuffer(ids, np.int64), np.frombuffer(nulls, np.uint8) > 0, learned, found


def _send_bigrams(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """The distinct bigrams of each pack, to their shards."""
    for batch in batches:
        for number, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found = _unread(data, deal)[3]
            first, second = found.first_hash[found.order], found.second_hash[found.order]
            counts = found.counts[found.order]
            edges = np.searchsorted(found.shards, np.arange(deal.shards + 1))
            for shard in range(deal.shards):
                a, b = edges[shard], edges[shard + 1]
                if a < b:
                    # First words come in runs.
                    run = np.flatnonzero(np.append(True, first[a + 1 : b] != first[a : b - 1]))
                    payload = pack(
                        first=_cut(first[a:b][run], _WORD_BYTES),
                        runs=np.diff(np.append(run, b - a)),
                        second=_cut(second[a:b], _NEXT_BYTES),
                        counts=counts[a:b],
                    )
                    yield _batch([_row("bigrams", shard, number, payload)])


def _send_words(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """The distinct words of each pack and how often it has them, to their shards."""
    for batch in batches:
        for number, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            found = _unread(data, deal)[3]
            edges = np.searchsorted(deal.word(found.words), np.arange(deal.shards + 1))
            for shard in range(deal.shards):
                a, b = edges[shard], edges[shard + 1]
                if a < b:
                    payload = pack(words=found.words[a:b].tobytes(), counts=found.word_counts[a:b])
                    yield _batch([_row("words", shard, number, payload)])


class _Mapped:
    """Sorted hashes with numbers beside them, in a mapped file."""

    def __init__(self, folder: Path, keys: np.ndarray, numbers: np.ndarray) -> None:
        np.save(folder / "keys.npy", keys)
        np.save(folder / "numbers.npy", numbers)
        self.keys = np.load(folder / "keys.npy", mmap_mode="r")
        self.numbers = np.load(folder / "numbers.npy", mmap_mode="r")

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of ``keys``; zeros for those that are not here."""
        out = np.zeros((len(keys), self.numbers.shape[1]), np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            here = self.keys[at] == keys
            out[here] = self.numbers[at[here]]
        return out


def summed(keys: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their rows of numbers."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[edge], np.add.reduceat(numbers[order], edge, axis=0) if len(keys) else numbers


class _Merge:
    """Sums by key over many arrays, merged whenever what waits outgrows what is merged."""

    def __init__(self, width: int) -> None:
        self.keys, self.numbers = np.zeros(0, np.uint64), np.zeros((0, width), np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        self.waiting.append((keys, numbers))
        self.size += len(keys)
        if self.size > max(1_000_000, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        both = [(self.keys, self.numbers), *self.waiting]
        self.keys, self.numbers = summed(*(np.concatenate(c) for c in zip(*both)))
        self.waiting, self.size = [], 0


def _bigram_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    key = (first * np.uint64(0x9E3779B97F4A7C15)) ^ second
    key ^= key >> np.uint64(32)
    return key * np.uint64(0xD6E8FEB86659FD93)


def _kinds(counts: np.ndarray) -> np.ndarray:
    """Columns that say whether a count is 1, 2, or more."""
    return np.stack([counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(counts == n) for n in (1, 2, 3, 4)])


def _shards(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    """Payloads in order of shard, each shard's kept in a file and given to ``answer``."""
    shard, file, sizes = None, None, []

    def replay() -> Iterator[tuple[str, int, bytes]]:
        file.seek(0)
        for kind, number, size in sizes:
            yield kind, number, file.read(size)

    def finish() -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            yield from answer(shard, replay, Path(folder))

    for batch in batches:
        for kind, at, number, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if at != shard:
                if file is not None:
                    yield from finish()
                    file.close()
                shard, file, sizes = at, tempfile.TemporaryFile(), []
            file.write(data)
            sizes.append((kind, number, len(data)))
    if file is not None:
        yield from finish()
        file.close()


def _bigrams(payload: bytes) -> tuple[np.ndarray, ...]:
    first, run, second, counts = unpack(payload)
    first = np.repeat(_whole(first, _WORD_BYTES), _numbers(run))
    return first, _whole(second, _NEXT_BYTES), _numbers(counts)


def _answer_bigrams(shard: int, replay, folder: Path, deal: Deal) -> Iterator[pa.RecordBatch]:
    """Counts of each pack's bigrams, and what they say of their words.

    Of a first word: how often it comes, and how many words follow it once, twice and
    more. Of a second word: how many words it follows.
    """
    merge = _Merge(1)
    firsts, seconds = _Merge(0), _Merge(0)
    for _, _, payload in replay():
        first, second, counts = _bigrams(payload)
        known = counts > 0
        merge.add(_bigram_key(first, second)[known], counts[known, None])
        firsts.add(first[known], np.zeros((int(known.sum()), 0), np.int64))
        seconds.add(second[known], np.zeros((int(known.sum()), 0), np.int64))
    for each in (merge, firsts, seconds):
        each.settle()
    model = _Mapped(folder, merge.keys, merge.numbers)
    seen = np.zeros(len(merge.keys), bool)
    of_first = np.zeros((len(firsts.keys), 5), np.int64)
    of_second = np.zeros(len(seconds.keys), np.int64)
    for _, number, payload in replay():
        first, second, _ = _bigrams(payload)
        key = _bigram_key(first, second)
        counts = model.get(key)[:, 0]
        yield _batch([_row("counts", shard, number, pack(counts=counts))])
        # Each bigram counts once for its words: where it is first met.
        known = np.flatnonzero(counts > 0)
        at = np.searchsorted(merge.keys, key[known])
        new = ~seen[at]
        seen[at] = True
        known = known[new]
        a, b = np.searchsorted(firsts.keys, first[known]), np.searchsorted(seconds.keys, second[known])
        np.add.at(of_first, a, np.column_stack([counts[known], _kinds(counts[known]), np.ones(len(known), int)]))
        np.add.at(of_second, b, 1)
    stats = _counts_of_counts(merge.numbers[:, 0])
    yield _batch([_row("stats", 2, shard, stats.astype(np.int64).tobytes())])
    for kind, keys, numbers in (("first", firsts.keys, of_first[:, :4]), ("second", seconds.keys, of_second[:, None])):
        to = deal.word(keys)
        for target in np.unique(to).tolist():
            mine = to == target
            size = _WORD_BYTES if kind == "first" else _NEXT_BYTES
            payload = pack(keys=_cut(keys[mine], size), **{f"n{i}": n for i, n in enumerate(numbers[mine].T)})
            yield _batch([_row(kind, target, shard, payload)])


def _upper(hashes: np.ndarray, size: int) -> np.ndarray:
    return hashes & np.uint64((1 << 64) - (1 << 8 * (8 - size)))


def _answer_words(shard: int, replay, folder: Path) -> Iterator[pa.RecordBatch]:
    """What each pack needs to know of its words, and sums over all words of the shard.

    How often a word comes in what is learned, how many words it follows; as a first
    word: how often, and how many words follow it once, twice and more.
    """
    merges = {"words": _Merge(1), "second": _Merge(1), "first": _Merge(4)}
    for kind, _, payload in replay():
        parts = unpack(payload)
        if kind == "words":
            keys = np.frombuffer(parts[0], np.uint64)
        else:
            keys = _whole(parts[0], _NEXT_BYTES if kind == "second" else _WORD_BYTES)
        merges[kind].add(keys, np.column_stack([_numbers(p) for p in parts[1:]]))
    models = {}
    for kind, merge in merges.items():
        merge.settle()
        (folder / kind).mkdir()
        models[kind] = _Mapped(folder / kind, merge.keys, merge.numbers)
    counts, follows = merges["words"].numbers[:, 0], merges["second"].numbers[:, 0]
    sums = [counts.sum(), np.count_nonzero(counts), follows.sum(), *_kinds(follows).sum(axis=0)]
    stats = np.concatenate([sums, _counts_of_counts(follows)])
    yield _batch([_row("stats", 1, shard, stats.astype(np.int64).tobytes())])
    begin = np.array([BEGIN], np.uint64)
    for kind, number, payload in replay():
        if kind != "words":
            continue
        words = np.frombuffer(unpack(payload)[0], np.uint64)
        if shard == 0:
            # What begins a text is no word of it, but a first word.
            words = np.append(words, begin)
        found = np.hstack(
            [
                models["words"].get(words),
                models["second"].get(_upper(words, _NEXT_BYTES)),
                models["first"].get(_upper(words, _WORD_BYTES)),
            ]
        )
        yield _batch([_row("of words", shard, number, pack(**{f"n{i}": n for i, n in enumerate(found.T)}))])


def discounts(n: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from counts of 0, 1, 2, and 3 or more.

    ``n`` says how many counts are 1, 2, 3 and 4. Where these are too few to tell, a
    count of c gives up half of 1, 1 and 1.5 instead.
    """
    n1, n2, n3, n4 = (float(x) for x in n)
    usual = np.array([0, 0.5, 1, 1.5])
    if min(n1, n2, n3, n4) <= 0:
        return usual
    y = n1 / (n1 + 2 * n2)
    found = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.where((found >= 0) & (found <= [0, 1, 2, 3]), found, usual)


@dataclass(frozen=True)
class Totals:
    """Sums over the whole model, and its discounts."""

    tokens: int
    words: int
    follows: int
    kinds: np.ndarray
    unigram: np.ndarray
    bigram: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + 1 * (self.words + 1)))

    def lower(self, follows: np.ndarray) -> np.ndarray:
        """How likely each word is wherever it stands; what is unknown shares one part."""
        if not self.follows:
            return np.full(len(follows), 1 / (self.words + 1))
        kept = (follows - self.unigram[np.minimum(follows, 3)]) / self.follows
        freed = float(self.kinds @ self.unigram[1:]) / self.follows
        return kept + freed / (self.words + 1)

    def upper(self, counts: np.ndarray, first: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """How likely each word is after another; ``first`` has a row for that one."""
        total = np.maximum(first[:, 0], 1)
        kept = (counts - self.bigram[np.minimum(counts, 3)]) / total
        freed = (first[:, 1:] @ self.bigram[1:]) / total
        return np.where(first[:, 0] > 0, kept + freed * lower, lower)


_OUT = "doc_id long, learned boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(batches: Iterator[pa.RecordBatch], deal: Deal, totals: Totals) -> Iterator[pa.RecordBatch]:
    """Packs in order, each behind its answers; the answers in the order of shards."""
    counts, words, begin = [], [], np.zeros(6, np.int64)
    names = [field.split()[0] for field in _OUT.split(", ")]
    for batch in batches:
        for kind, shard, _, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if kind == "counts":
                counts.append(_numbers(unpack(data)[0]))
                continue
            if kind == "of words":
                words.append(np.column_stack([_numbers(p) for p in unpack(data)]))
                if shard == 0:
                    begin, words[-1] = words[-1][-1], words[-1][:-1]
                continue
            ids, nulls, learned, found = _unread(data, deal)
            ordered = np.concatenate(counts)
            of_bigram = np.empty(len(ordered), np.int64)
            of_bigram[found.order] = ordered
            of_word = np.vstack([*words, begin])
            counts, words, begin = [], [], np.zeros(6, np.int64)
            lower = totals.lower(of_word[:, 1])
            likely = totals.upper(of_bigram, of_word[found.first, 2:], lower[found.second])
            texts = found.second[found.of]
            starts = np.cumsum(found.lengths) - found.lengths
            known = np.add.reduceat((of_word[texts, 0] > 0).astype(np.int64), starts)
            base = np.add.reduceat(totals.base(of_word[texts, 0]), starts)
            score = np.add.reduceat(np.log10(likely)[found.of], starts)
            columns = [
                pa.array(ids, mask=nulls),
                pa.array(learned),
                pa.array(found.lengths),
                pa.array(known),
                pa.array(np.full(len(ids), totals.tokens, np.int64)),
                pa.array(base),
                pa.array(score),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)


def score(rows: DataFrame, id_: str, text: str, learn: Column) -> DataFrame:
    """The log10 probability of every text under a model of those where ``learn`` holds.

    Tokens are runs of anything but ASCII white space, A-Z in lower case, and one end
    for each text. Null texts are empty: one token, the end. Null ids are kept, ids may
    repeat. If nothing is learned from, all tokens are equally unlikely. An empty table
    gives no rows.

    ``base_score`` sums log10((c + 1) / (N + 1 * (V + 1))) over the tokens; c is how
    often a token comes in what is learned from, N the number of those, V how many
    different ones. ``score`` is the model's. Also gives ``learned``, ``n_tokens``,
    ``n_known`` (c > 0) and ``train_tokens`` (N).

    Packs, and what shards answer, are written to the shared folder. Of them only sums
    over shards come to the driver.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    n = partitions(spark)
    plain = rows.select(
        F.col(id_).cast("long").alias("id"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    deal = Deal(2 * n, _hot_words(plain))
    packs = stored(plain.mapInArrow(_read, _SCHEMA), "packs")

    def meet(sent: DataFrame, answer) -> DataFrame:
        gathered = sent.repartition(n, "shard").sortWithinPartitions("shard")
        return gathered.mapInArrow(lambda b: _shards(b, answer), _SCHEMA)

    sent = packs.mapInArrow(lambda b: _send_bigrams(b, deal), _SCHEMA)
    bigrams = stored(meet(sent, lambda s, r, f: _answer_bigrams(s, r, f, deal)), "bigrams")
    sent = packs.mapInArrow(lambda b: _send_words(b, deal), _SCHEMA)
    words = stored(meet(sent.union(bigrams.where("kind IN ('first', 'second')")), _answer_words), "words")
    totals = _totals(bigrams.union(words).where("kind = 'stats'"))
    answers = bigrams.where("kind = 'counts'").union(words.where("kind = 'of words'"))
    return (
        answers.union(packs)
        .repartition(n, "pack")
        # By kind: counts, of words, pack.
        .sortWithinPartitions("pack", "kind", "shard")
        .mapInArrow(lambda b: _score(b, deal, totals), _OUT)
    )


def _hot_words(plain: DataFrame) -> frozenset[int]:
    """First words of a large share of all bigrams, in about ``SAMPLED`` texts."""
    share = max(1, plain.count() // SAMPLED)
    sample = plain.where(F.pmod(F.xxhash64("id", "text"), F.lit(share)) == 0).limit(2 * SAMPLED)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [h for t in batch.column(1).to_pylist() for h in [BEGIN, *hashed(t)[:-1]]]
            keys, numbers = np.unique(np.array(found, np.uint64), return_counts=True)
            arrays = [pa.array(keys.view(np.int64)), pa.array(numbers.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, ["word", "n"])

    counted = sample.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    rows = counted.where(F.col("n") > HOT * total).collect()
    return frozenset(r["word"] % 2**64 for r in rows)


def _totals(stats: DataFrame) -> Totals:
    of_words, of_bigrams = np.zeros(10, np.int64), np.zeros(4, np.int64)
    for row in stats.select("shard", "data").collect():
        found = np.frombuffer(row["data"], np.int64)
        if row["shard"] == 1:
            of_words = of_words + found
        else:
            of_bigrams = of_bigrams + found
    return Totals(
        tokens=int(of_words[0]),
        words=int(of_words[1]),
        follows=int(of_words[2]),
        kinds=of_words[3:6],
        unigram=discounts(of_words[6:]),
        bigram=discounts(of_bigrams),
    )
