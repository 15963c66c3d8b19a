"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are the three-character patterns of its character classes (log counts) and soft bins of a few measures of
its words and lines (distinct words, most frequent word, word length, capitals, signs, repeated lines, length), all over
the whole text. Terms are weighted by their rarity, and a truncated SVD of the labelled sample's terms gives the latent
space. The sample's vectors, at most ``SAMPLE`` x ``DIMENSIONS`` numbers, go to every task; each block of documents takes
its exact cosine with all of them in one product, and the ``NEIGHBOURS`` nearest vote with the power of their similarity,
each class weighted back to its share of all labels. The score is the weight of label 1.

The sample: up to SAMPLE / 2 rows of each label, drawn by a hash of doc_id from rows that are not held out. A doc_id with
several labels counts as 0 if any is 0. Nulls: a null or empty text has no patterns, but its measures have bins, so it is
scored like other texts; null labels and null doc_ids teach nothing. With no label to learn from every score is 0.5.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import held_out, keyed

SAMPLE = 2048
DIMENSIONS = 48
NEIGHBOURS = 25
POWER = 8.0
THRESHOLD = 0.7
BLOCK = 256

_CLASSES = 13
_TABLE = bytearray([12] * 256)
for _code, _members in enumerate((b" \t", b"\n\r", b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789",
                                  b".", b",;:'\"-", b"!?", b"#$%&*@", b"|<>{}[]()/\\=+_~^`", bytes(range(128, 256)))):
    for _b in _members:
        _TABLE[_b] = _code
_TABLE = bytes(_TABLE)
PATTERNS = _CLASSES**3
BINS, MEASURES = 12, 7
TERMS = PATTERNS + BINS * MEASURES


def _measures(text: bytes, classes: np.ndarray) -> np.ndarray:
    """Seven measures between 0 and 1."""
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    tally = np.bincount(classes, minlength=_CLASSES)
    size = max(1, len(classes))
    counts = Counter(words)
    return np.array([
        np.log1p(len(counts)) / np.log1p(n) if words else 0,
        max(counts.values(), default=0) / n,
        min(1.0, size / n / 24),
        tally[4] / max(1, tally[2] + tally[3] + tally[4]),
        min(1.0, 3 * tally[8:11].sum() / size),
        1 - len(set(lines)) / len(lines),
        min(1.0, np.log1p(len(words)) / 12),
    ])


def terms(texts: list[bytes | None]) -> np.ndarray:
    """One row of unweighted terms per text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for row, text in zip(out, texts):
        text = text or b""
        classes = np.frombuffer(text.translate(_TABLE), np.uint8)
        if len(classes) > 2:
            c = classes.astype(np.int16)
            pattern = np.log1p(np.bincount((c[:-2] * _CLASSES + c[1:-1]) * _CLASSES + c[2:], minlength=PATTERNS))
            row[:PATTERNS] = pattern / np.linalg.norm(pattern)
        at = _measures(text, classes) * (BINS - 1)
        low = np.minimum(at.astype(int), BINS - 2)
        place = PATTERNS + np.arange(MEASURES) * BINS + low
        row[place], row[place + 1] = (1 - (at - low)) / 2, (at - low) / 2
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


class Voters:
    """The labelled vectors and the way into their space."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, share: float, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.rarity = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.3).astype(np.float32)
        x = x * self.rarity
        basis = rng.normal(size=(x.shape[1], DIMENSIONS + 12)).astype(np.float32)
        for _ in range(4):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        self.space = (basis @ turn[:DIMENSIONS].T).astype(np.float32)
        self.vectors, self.labels = _unit(x @ self.space).astype(np.float32), labels.astype(np.float32)
        drawn = float(labels.mean())
        self.weights = np.where(labels == 1, share / max(drawn, 1e-9), (1 - share) / max(1 - drawn, 1e-9)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        near = _unit((x * self.rarity) @ self.space) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-3) ** POWER * self.weights[top]
        return np.clip((weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1), 0, 1)


def learn(documents: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Voters | None:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return None
    draw = F.xxhash64("doc_id", F.lit("quality"))
    drawn = [known.where(F.col("quality") == q).orderBy(draw, "doc_id").limit(size // 2).collect() for q in sorted(counts)]
    quality = {r.doc_id: r.quality for rows in drawn for r in rows}

    # At most ``size`` ids: the filter is a list in the plan, and each id is met once.
    docs = keyed(documents).where(F.col("doc_id").isin(list(quality)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, BLOCK):
                few = part.slice(at, BLOCK)
                x = terms(few.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "terms"])

    rows = docs.mapInArrow(run, "doc_id long, terms binary").groupBy("doc_id").agg(F.min("terms").alias("terms")).toArrow()
    if not rows.num_rows:
        return None
    ids = rows.column("doc_id").to_pylist()
    order = np.argsort(ids)
    x = np.stack([np.frombuffer(t, np.float32) for t in rows.column("terms").to_pylist()])[order]
    y = np.array([quality[i] for i in ids])[order]
    return Voters(x, y, counts.get(1, 0) / sum(counts.values()))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    voters = learn(documents, labels)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, BLOCK):
                few = part.slice(at, BLOCK)
                score = voters.scores(terms(few.column(1).to_pylist())).astype(np.float64) if voters else np.full(few.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(score)], ["doc_id", "score"])

    found = keyed(documents).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
