"""The main text of pages, by a graphical model over the tree of their elements.

Each element is main text or not. How likely that is hangs on its own features and, through
potentials between parent and child, on its parent and children. Messages go from the
leaves up and back down (sum-product), which gives every element its exact marginal. The
weights of features and potentials are fitted to labelled pages by the gradient of their
likelihood, for which the same messages give the expectations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernwork.llm.dom import KINDS, Forest, Tree, blocks
from quernwork.llm.labelled_pages import composed, nameless, self_labelled

# Pages of the table that are learned from, and characters of one, at most; this bounds
# what comes to the driver.
LABELLED, LABELLED_CHARS = 128, 1 << 16
# Steps of the fit, their size, and the weight of small weights.
STEPS, RATE, SHRINK = 400, 0.1, 2e-5
# Pages, and their characters, whose messages are passed at once.
PAGES, CHARS = 64, 1 << 21
LEAST = 0.5


@dataclass(frozen=True)
class Model:
    """Weights of features for main text, and potentials [kind, parent's label, child's]."""

    weights: np.ndarray
    edges: np.ndarray

    def messages(self, forest: Forest, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log beliefs of each node, and what each has heard from below and from above."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = features @ self.weights
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        heard = own.copy()
        for level in forest.levels[:0:-1]:
            both = self.edges[forest.kind[level]] + heard[level][:, None, :]
            up[level] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            up[level] -= up[level].max(axis=1, keepdims=True)
            np.add.at(heard, forest.parent[level], up[level])
        belief = heard.copy()
        for level in forest.levels[1:]:
            rest = belief[forest.parent[level]] - up[level]
            both = self.edges[forest.kind[level]] + rest[:, :, None]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            down[level] -= down[level].max(axis=1, keepdims=True)
            belief[level] = heard[level] + down[level]
        return belief, heard, up

    def marginals(self, forest: Forest, features: np.ndarray) -> np.ndarray:
        """How likely each element is main text."""
        belief, _, _ = self.messages(forest, features)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def fit(trees: list[Tree]) -> Model:
    """The model of labelled trees: likelihood climbed by steps of Adam, the same each time."""
    forest = Forest(trees)
    features = forest.features()
    child = np.flatnonzero(forest.parent >= 0)
    above, kind, label = forest.parent[child], forest.kind[child], forest.label
    n = max(1, len(label))
    wanted = features.T @ label
    seen = np.zeros((len(KINDS), 2, 2))
    np.add.at(seen, (kind, label[above], label[child]), 1)
    flat = np.zeros(features.shape[1] + seen.size)
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, STEPS + 1):
        model = Model(flat[: features.shape[1]], flat[features.shape[1] :].reshape(seen.shape))
        belief, heard, up = model.messages(forest, features)
        likely = np.exp(belief - np.logaddexp(belief[:, 0], belief[:, 1])[:, None])
        pairs = (belief[above] - up[child])[:, :, None] + model.edges[kind] + heard[child][:, None, :]
        pairs = np.exp(pairs - pairs.max(axis=(1, 2), keepdims=True))
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        expected = np.zeros_like(seen)
        np.add.at(expected, kind, pairs)
        slope = np.concatenate([wanted - features.T @ likely[:, 1], (seen - expected).ravel()]) / n - SHRINK * flat
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        flat = flat + RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(flat[: features.shape[1]], flat[features.shape[1] :].reshape(seen.shape))


def labelled(pages: list[str]) -> list[Tree]:
    """Trees to learn from: pages that label themselves, and those put together here.

    Some of the former lose the names of their sections, so that text counts too.
    """
    trees = [t for page in pages if (t := self_labelled(page))]
    trees = [nameless(t) if i % 4 == 3 else t for i, t in enumerate(trees)]
    return trees + [Tree(p) for p in composed()]


def learned(pages: DataFrame, html: str, most: int = LABELLED, chars: int = LABELLED_CHARS) -> Model:
    """A model of at most ``most`` pages of the table, each of at most ``chars`` characters.

    They are chosen by a hash of their text, so the choice does not hang on order, and copies
    count once. Pages that do not label themselves, null and longer ones are not learned
    from; with none at all the pages put together in the library remain. The hashes are
    chosen first, so no more than ``most`` pages are sent anywhere.
    """
    short = pages.select(F.col(html).alias("page"), F.xxhash64(html).alias("by")).where(F.length("page") <= chars)
    hashes = [r["by"] for r in short.select("by").distinct().orderBy("by").limit(most).collect()]
    chosen = short.where(F.col("by").isin(hashes)).groupBy("by").agg(F.min("page").alias("page"))
    found = sorted((r["by"], r["page"]) for r in chosen.collect())
    return fit(labelled([page for _, page in found]))


def texts_of(pages: list[str], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [Tree(p) for p in pages]
    forest = Forest(trees)
    keep = (model.marginals(forest, forest.features()) >= LEAST).tolist()
    starts = forest.start.tolist()
    return [blocks(t.texts, keep[a:b]) for t, a, b in zip(trees, starts, starts[1:])]


def main_text(pages: DataFrame, html: str, model: Model, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of each page and its length in code points.

    The page itself is left out. Null pages are empty ones and have an empty text, as has
    a page without main text. References are decoded, white space within a block is one
    space, blocks are lines; nothing else is left out and no page is cut. Other columns are
    kept, whatever their names; those called ``text`` or ``n_chars`` are replaced.

    A task holds the trees of ``PAGES`` pages, or of one page if it is long. The model is
    some hundred numbers.
    """
    kept = [c for c in pages.columns if c not in (html, text, n_chars)]
    numbered = pages.select(*[F.col(f"`{c}`") for c in [*kept, html]]).toDF(*[f"c{i}" for i in range(len(kept))], "page")
    fields = numbered.drop("page").schema
    schema = fields.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            start = 0
            while start < batch.num_rows:
                end, held = start, 0
                group: list[str] = []
                while end < batch.num_rows and len(group) < PAGES and held < CHARS:
                    group.append(column[end].as_py() or "")
                    held += len(group[-1])
                    end += 1
                found = texts_of(group, model)
                rest = batch.slice(start, end - start).columns[:-1]
                added = [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*rest, *added], [f.name for f in schema.fields])
                start = end

    done = numbered.mapInArrow(run, schema)
    return done.toDF(*kept, text, n_chars)
