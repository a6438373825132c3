"""The classifier on labels it has not learned, and its votes against plain ones."""

import zlib

import numpy as np

from quernwork.llm.q06_quality import fitted, run
from quernwork.llm.quality import NEIGHBOURS, POWER, features, fit, fit_features
from quernwork.sources import Tables


def test_held_out_labels(spark):
    tables = Tables(spark, "/root/testdata/sf0.1")
    truth = {r[0]: r[1] for r in tables.read("labels", "doc_id", "quality").collect()}
    rows = run(tables).collect()
    assert len(rows) == tables.read("documents", "doc_id").count()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.3)
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p == y for p, y in judged) / len(judged) > 0.97


def test_votes_are_the_nearest(spark):
    tables = Tables(spark, "/root/testdata/sf0.001")
    documents = tables.read("documents", "doc_id", "text")
    model = fitted(documents, tables)
    texts = [r["text"] for r in documents.limit(20).collect()]
    counts = np.stack([features(t) for t in texts])
    vectors = model.latent(counts)
    for vector, found in zip(vectors, model.scores(counts)):
        cosines = [(float(np.dot(vector, v)), y) for v, y in zip(model.vectors, model.labels)]
        best = sorted(cosines, reverse=True)[:NEIGHBOURS]
        weights = [max(c, 0) ** POWER for c, _ in best]
        assert abs(found - sum(w * y for w, (_, y) in zip(weights, best)) / sum(weights)) < 1e-3


def test_projection_is_the_strongest_directions():
    """The latent space against numpy's own singular vectors."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words[40 * (i % 10) : 40 * (i % 10) + 60], 80)) for i in range(300)]
    counts = np.stack([features(t) for t in texts])
    model = fit_features((c, i % 2) for i, c in enumerate(counts))
    forms = np.log1p(counts[:, :-1]) * model.weights
    forms /= np.linalg.norm(forms, axis=1, keepdims=True) + 1e-9
    rows = np.hstack([forms, np.sqrt(counts[:, -1:])])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True) + 1e-9
    strongest = np.linalg.svd(rows, full_matrices=False)[1][: model.basis.shape[1]]
    kept = np.linalg.norm(rows @ model.basis)
    assert np.allclose(model.basis.T @ model.basis, np.eye(model.basis.shape[1]), atol=1e-3)
    assert kept >= 0.99 * np.sqrt((strongest**2).sum())


def test_votes_that_tie_all_count():
    counts = np.stack([features("same text here")] * 20 + [features("another one")] * 5)
    model = fit_features((c, int(i < 10)) for i, c in enumerate(counts))
    assert abs(model.scores(counts[:1])[0] - 0.5) < 1e-6


def test_the_sample_does_not_hang_on_order_or_copies(spark):
    texts = [(i % 40, f"text {i % 40} of {i % 40 % 7}") for i in range(400)] + [(7, "other"), (50, None)]
    marks = [(i, i % 2) for i in range(60)] * 3 + [(None, 1), (3, None)]
    found = []
    for n in (1, 5):
        documents = spark.createDataFrame(texts[::n] + texts, "doc_id long, text string").repartition(n)
        labels = spark.createDataFrame(marks[::-1], "doc_id long, quality int").repartition(n)
        found.append(fit(documents, labels, "doc_id", "text", "quality", 16))
    assert len(found[0].labels) == 16
    assert (found[0].labels == found[1].labels).all() and np.allclose(found[0].vectors, found[1].vectors, atol=1e-4)


def test_without_labels():
    model = fit_features([])
    assert model.scores(np.stack([features("a b"), features("")])).tolist() == [0.5, 0.5]


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, "word " * 100_000), (None, "x"), (4, "one two"), (4, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS id")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(3, 0), (4, 1), (4, 1), (None, 1), (2, None), (99, 1)]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = run(Tables(spark, str(tmp_path))).collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "4", "4", "None"]
    assert len({r["score"] for r in found if r["doc_id"] in (1, 2)}) == 1
    for name, frame in (("documents", df), ("labels", spark.read.parquet(f"{tmp_path}/labels.parquet"))):
        frame.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert run(Tables(spark, f"{tmp_path}/none")).collect() == []
