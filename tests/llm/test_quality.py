"""Quality voting: held-out accuracy, exact neighbours, edge cases."""

import zlib

import numpy as np

from nnfield.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = labels.select("doc_id", "quality").join(quality.scored(docs, labels), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    accuracy = np.mean([r.predicted == r.quality for r in held])
    print("accuracy", accuracy, "auc", auc, "kept good", np.mean([g >= 0.7 for g in good]), "kept bad", np.mean([b >= 0.7 for b in bad]))
    assert accuracy > 0.95 and auc > 0.95


def test_votes_equal_plain_cosines():
    rng = np.random.default_rng(1)
    x = quality.terms([bytes(rng.integers(32, 127, 80).tolist()) for _ in range(90)])
    y = rng.integers(0, 2, 90)
    voters = quality.Voters(x[:60], y[:60], float(y[:60].mean()))
    for row, score in zip(x[60:], voters.scores(x[60:])):
        v = (row * voters.rarity) @ voters.space
        near = [(float(v @ u / np.linalg.norm(v)), w, q) for u, w, q in zip(voters.vectors, voters.weights, voters.labels)]
        near = sorted(near, key=lambda t: -t[0])[: quality.NEIGHBOURS]
        votes = [(max(s, 1e-3) ** quality.POWER * w, q) for s, w, q in near]
        assert abs(sum(w * q for w, q in votes) / sum(w for w, _ in votes) - score) < 1e-3


def test_edge_cases(spark, docs_of):
    rows = [(i, "A fine sentence of words." if i % 2 else "!!! ### $$$") for i in range(80)] + [(100, None), (101, ""), (None, "x"), (1, "again"), (102, "word " * 60_000)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(None, 1, 0), (5, None, 1), (1, 1, 0)], "doc_id long, quality int, score int")
    found = quality.scored(docs_of(rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found if r.doc_id != 1}
    assert by[3].predicted == 1 and by[2].predicted == 0
    assert quality.scored(docs_of([]), labels).collect() == []
    assert quality.scored(docs_of([(1, "x")]), labels.where("1 = 0")).first().score == 0.5
