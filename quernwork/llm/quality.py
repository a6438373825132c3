"""A quality classifier: nearest labelled neighbours in a latent space vote."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quernwork.llm.common import bounded_batches

# Labelled rows that are fitted on and broadcast, at most: with DIMENSIONS and BUCKETS
# this bounds the broadcast to some 1 MB and what the driver holds to some 150 MB.
LABELLED = 4096
# Buckets of words and of runs of so many characters, and dimensions of the latent space.
BUCKETS = 2048
GRAM = 3
DIMENSIONS = 32
# Words whose buckets a worker remembers.
WORDS = 50_000
# Neighbours that vote, each with its cosine to this power.
NEIGHBOURS = 8
POWER = 4
# A score from which label 1 is predicted.
THRESHOLD = 0.3
# Texts compared with all labelled vectors at once: 2 MB of products.
BLOCK = 128

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class _Forms(dict):
    """Buckets of a word: one of the word, and one of each three characters in a row of it."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > WORDS:
            self.clear()
        edged = f" {word} "
        parts = [f"={word}", *(edged[i : i + GRAM] for i in range(len(edged) + 1 - GRAM))]
        # The same objects for equal numbers, which take no room of their own.
        found = self[word] = tuple(_NUMBERS[zlib.crc32(p.encode()) % BUCKETS] for p in parts)
        return found


_NUMBERS = list(range(BUCKETS))
_forms = _Forms()


def features(text: str) -> np.ndarray:
    """Counts of all words and their characters, then the share of words like the one before."""
    words = _WORD.findall(text)
    out = np.zeros(BUCKETS + 1, np.float32)
    if words:
        found = np.fromiter(chain.from_iterable(map(_forms.__getitem__, words)), np.int64)
        out[:BUCKETS] = np.bincount(found, minlength=BUCKETS)
        out[BUCKETS] = sum(map(eq, words, words[1:])) / len(words)
    return out


@dataclass(frozen=True)
class Model:
    """Weights of the forms, a projection, and the labelled vectors with their labels."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Weighted forms of unit length, and the root of the last column."""
        rows = np.empty_like(counts)
        forms = rows[:, :-1]
        np.log1p(counts[:, :-1], out=forms)
        forms *= self.weights
        forms /= np.sqrt(np.einsum("ij,ij->i", forms, forms))[:, None] + np.float32(1e-9)
        np.sqrt(counts[:, -1], out=rows[:, -1])
        return rows

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Latent-semantic vectors of unit length; zero for a text without words."""
        rows = self.weighted(counts) @ self.basis
        return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The share of label 1 in the weights of the nearest labelled vectors.

        What is as near as the last of these votes too. Where nothing is near, as for a text without words, the share among all
        labelled rows; 0.5 if there are none.
        """
        n = len(self.labels)
        if n == 0:
            return np.full(len(counts), 0.5)
        k = min(NEIGHBOURS, n)
        cosines = self.latent(counts) @ self.vectors.T
        least = np.partition(cosines, n - k, axis=1)[:, n - k, None]
        row, nearest = np.nonzero(cosines >= least)
        weights = np.maximum(cosines[row, nearest], 0).astype(float) ** POWER
        total = np.bincount(row, weights, len(counts))
        votes = np.bincount(row, weights * self.labels[nearest], len(counts))
        prior = float(self.labels.mean())
        return np.where(total > 1e-9, votes / np.maximum(total, 1e-9), prior)


def fit_features(rows: Iterable[tuple[np.ndarray, int]]) -> Model:
    """The model of the counts and labels of a bounded sample."""
    pairs = list(rows)
    labels = np.array([label for _, label in pairs], float)
    if not pairs:
        none = np.zeros((BUCKETS + 1, DIMENSIONS), np.float32)
        return Model(np.ones(BUCKETS, np.float32), none, none[:0, :DIMENSIONS], labels)
    counts = np.empty((len(pairs), BUCKETS + 1), np.float32)
    for i, (row, _) in enumerate(pairs):
        counts[i], pairs[i] = row, None
    share = (counts[:, :-1] > 0).mean(axis=0)
    weights = np.maximum(np.log(2 / (share + 1e-2)), 0).astype(np.float32)
    start = Model(weights, np.zeros((0, 0), np.float32), counts[:0], labels)
    rows_ = start.weighted(counts)
    rows_ /= np.sqrt(np.einsum("ij,ij->i", rows_, rows_))[:, None] + np.float32(1e-9)
    # Right singular vectors of the sample: eigenvectors of its Gram matrix, found by
    # repeated products with a block that is kept orthogonal.
    basis = np.random.default_rng(6).normal(size=(BUCKETS + 1, DIMENSIONS)).astype(np.float32)
    for _ in range(12):
        basis, _ = np.linalg.qr(rows_.T @ (rows_ @ basis))
    model = Model(weights, basis.astype(np.float32), counts[:0], labels)
    return Model(weights, model.basis, model.latent(counts).astype(np.float32), labels)


def fit(
    documents: DataFrame, labels: DataFrame, id_: str, text: str, label: str, most: int = LABELLED
) -> Model:
    """A model of at most ``most`` labelled texts, chosen by a hash of their ids.

    Null ids, null texts and null labels take no part, nor do labels without a text. If an
    id has several texts or labels, each different pair counts once, still at most ``most``
    in all. Order and copies of rows change nothing.
    """
    texts = documents.where(F.col(text).isNotNull() & F.col(id_).isNotNull())
    texts = texts.select(F.col(id_).alias("id"), F.col(text).alias("text"))
    chosen = (
        labels.where(F.col(id_).isNotNull() & F.col(label).isNotNull())
        .select(F.col(id_).alias("id"), F.col(label).cast("int").alias("label"))
        .distinct()
        .join(texts.select("id").distinct(), "id", "left_semi")
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(most)
    )
    bounded_batches(documents.sparkSession)

    @arrow_udf("binary")
    def counted(texts: pa.Array) -> pa.Array:
        found = (features(t).astype(np.float32) for t in texts.to_pylist())
        return pa.array([zlib.compress(f.tobytes(), 1) for f in found], pa.binary())

    # The labelled ids are at most ``most``, so they may be broadcast. Copies are one row
    # before the order is taken.
    pairs = texts.join(F.broadcast(chosen), "id").groupBy("id", "label", F.xxhash64("text").alias("mark"))
    first = pairs.agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id", "label", "mark").limit(most)
    found = first.select("id", "label", "mark", counted("text").alias("counts")).collect()
    found = sorted((r["id"], r["label"], r["mark"], bytes(r["counts"])) for r in found)
    return fit_features((np.frombuffer(zlib.decompress(c), np.float32), y) for _, y, _, c in found)


def score(documents: DataFrame, model: Model, text: str) -> Column:
    """How likely label 1 is for every text, from 0 to 1; null texts as empty ones.

    The model is broadcast; its size is bounded by the sample it was fitted on.
    Cosines with all labelled vectors are exact, taken in blocks of texts.
    """
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        rows, out = texts.to_pylist(), []
        for i in range(0, len(rows), BLOCK):
            counts = np.stack([features(t or "") for t in rows[i : i + BLOCK]])
            out.append(shared.value.scores(counts))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return run(F.col(text))
