"""SimHash near-dedup by the generalised pigeonhole principle.

Fingerprints that differ in at most ``distance`` of 64 bits are linked; documents with linked fingerprints form groups.
Equal fingerprints are one node, so copies cost one row. The bits are grouped into parts by their correlation over all
fingerprints. Each fingerprint gets its own thresholds, one per part, whose (threshold + 1) sum to distance + 1: then a
fingerprint within the distance agrees with it in some part up to that part's threshold, and none is lost. A dynamic
program picks the thresholds of least estimated cost from histograms of the parts; -1 leaves a part out, so that a value
that very many fingerprints share is probed only where nothing else is cheaper. Probes meet the part values in a join, and
the join itself verifies all 64 bits, so that only links come out of it. The number of parts is the one of least estimated
total cost, which moves with the number of fingerprints.

Nulls: a null text has no words and fingerprint 0; a null doc_id is never a group's smallest. An empty table gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import keyed, same_row
from nnfield.llm.components import components
from nnfield.session import cut_lineage

SHINGLE = 4
SEED = 42
DISTANCE = 4
BITS = 64
PARTS = (2, 3, 4, 5)
# Bits of a histogram; a wider part is the product of several.
HISTOGRAM_BITS = 11
# A probe is a row that is shuffled and sorted; a candidate is one comparison in the join.
PROBE_COST = 20.0
ROWS_OUT = 500_000

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_POSITIONS = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the shingles of a text, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist()[shingle - 1 :], len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends)], np.uint64)
    n = len(hashes)
    tally = np.bincount((hashes.view(np.uint8).reshape(n, 8) + _POSITIONS).ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits((2 * tally.ravel() > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's 64 bits as a long) of each document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in part.column(1)), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return keyed(documents).mapInArrow(run, "doc_id long, text_hash long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(bits: np.ndarray, places: list[int]) -> np.ndarray:
    return bits[:, places].astype(np.int64) @ (1 << np.arange(len(places), dtype=np.int64))


def _tally(fps: DataFrame, of, length: int) -> np.ndarray:
    """Sum over all fingerprints of the vector that ``of`` makes from a batch; its length is fixed."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length)
        for part in parts:
            if part.num_rows:
                total += of(np.asarray(part.column(0)).astype(np.int64).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "x"])

    rows = fps.mapInArrow(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(length)
    out[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
    return out


def correlated_parts(together: np.ndarray, n: float, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of near equal size, each grown by the bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    linked = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(linked, 0)
    free, out = set(range(BITS)), []
    for size in [BITS // parts + (k < BITS % parts) for k in range(parts)]:
        left = sorted(free)
        group = [max(left, key=lambda b: linked[b, left].sum())]
        free.discard(group[0])
        while len(group) < size:
            group.append(max(sorted(free), key=lambda b: linked[b, group].sum()))
            free.discard(group[-1])
        out.append(sorted(group))
    return out


class Allocation:
    """Parts, and from their histograms each fingerprint's thresholds."""

    def __init__(self, places: list[list[int]], distance: int) -> None:
        self.places, self.distance = places, distance
        self.pieces = [[p[i : i + HISTOGRAM_BITS] for i in range(0, len(p), HISTOGRAM_BITS)] for p in places]
        self.length = sum(1 << len(x) for p in self.pieces for x in p)

    def histogram(self, fp: np.ndarray) -> np.ndarray:
        bits = _bits(fp)
        return np.concatenate([np.bincount(_values(bits, x), minlength=1 << len(x)) for p in self.pieces for x in p])

    def learn(self, counts: np.ndarray) -> None:
        """Shares of all fingerprints at distance 0, 1, ... from each value of each piece."""
        self.shells, at = [], 0
        self.total = max(counts[: 1 << len(self.pieces[0][0])].sum(), 1.0)
        for p in self.pieces:
            own = []
            for x in p:
                shell = np.zeros((self.distance + 1, 1 << len(x)))
                shell[0] = counts[at : at + (1 << len(x))] / self.total
                at += 1 << len(x)
                for b in range(len(x)):
                    turned = shell[:, np.arange(1 << len(x)) ^ (1 << b)]
                    shell[1:] += turned[:-1]
                own.append(shell)
            self.shells.append(own)
        self.masks = [[self._ball(len(p), t) for t in range(self.distance + 1)] if len(p) < 30 else
                      [self._ball(len(p), t) if t < 3 else None for t in range(self.distance + 1)] for p in self.places]

    @staticmethod
    def _ball(size: int, radius: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for k in range(radius + 1) for c in itertools.combinations(range(size), k)], np.int64)

    def costs(self, bits: np.ndarray) -> np.ndarray:
        """(fingerprint, part, threshold + 1): estimated cost; 0 leaves the part out."""
        out = np.zeros((len(bits), len(self.places), self.distance + 2))
        for i, own in enumerate(self.shells):
            near = None
            for x, shell in zip(self.pieces[i], own):
                here = shell[:, _values(bits, x)]
                near = here if near is None else np.stack([sum(near[k] * here[d - k] for k in range(d + 1)) for d in range(len(here))])
            within = np.cumsum(near, axis=0) * self.total
            for t in range(self.distance + 1):
                masks = self.masks[i][t]
                out[:, i, t + 1] = np.inf if masks is None else PROBE_COST * len(masks) + within[t]
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least cost of each fingerprint and its (threshold + 1) per part, by dynamic programming over the parts."""
        cost = self.costs(bits)
        n, parts, width = cost.shape
        best = np.full((n, width), np.inf)
        best[:, 0] = 0
        chosen = []
        for i in range(parts):
            options = np.full((n, width, width), np.inf)
            for t in range(width):
                options[:, t:, t] = best[:, : width - t] + cost[:, i, t : t + 1]
            chosen.append(options.argmin(axis=2))
            best = options.min(axis=2)
        taken, left = np.zeros((n, parts), np.int64), np.full(n, width - 1)
        for i in range(parts - 1, -1, -1):
            taken[:, i] = chosen[i][np.arange(n), left]
            left -= taken[:, i]
        return best[:, -1], taken

    def keys(self, bits: np.ndarray, i: int) -> np.ndarray:
        return _values(bits, self.places[i]) | (i << 33)

    def indexed(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fp = np.asarray(part.column(0)).astype(np.int64)
            bits = _bits(fp.view(np.uint64))
            keys = np.concatenate([self.keys(bits, i) for i in range(len(self.places))])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fp, len(self.places)))], ["part_value", "x"])

    def probed(self, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fp = np.asarray(part.column(0)).astype(np.int64)
            bits = _bits(fp.view(np.uint64))
            _, taken = self.thresholds(bits)
            for i in range(len(self.places)):
                keys = self.keys(bits, i)
                for t in range(1, self.distance + 2):
                    rows = np.flatnonzero(taken[:, i] == t)
                    step = max(1, ROWS_OUT // max(1, len(self.masks[i][t - 1]) if self.masks[i][t - 1] is not None else 1))
                    for at in range(0, len(rows), step):
                        few = rows[at : at + step]
                        probes = keys[few][:, None] ^ self.masks[i][t - 1][None, :]
                        yield pa.RecordBatch.from_arrays([pa.array(probes.ravel()), pa.array(np.repeat(fp[few], probes.shape[1]))], ["part_value", "q"])


def allocate(nodes: DataFrame, distance: int, parts: tuple[int, ...] = PARTS) -> Allocation:
    """The division into parts of least estimated cost over all fingerprints (column fp, distinct)."""
    def pairs(fp: np.ndarray) -> np.ndarray:
        bits = _bits(fp).astype(np.float64)
        return np.append((bits.T @ bits).ravel(), len(fp))

    seen = _tally(nodes, pairs, BITS * BITS + 1)
    options = [Allocation(correlated_parts(seen[:-1].reshape(BITS, BITS), seen[-1], m), distance) for m in parts]
    counts = _tally(nodes, lambda fp: np.concatenate([o.histogram(fp) for o in options]), sum(o.length for o in options))
    at = 0
    for o in options:
        o.learn(counts[at : at + o.length])
        at += o.length
    if len(options) == 1:
        return options[0]
    total = _tally(nodes, lambda fp: np.array([o.thresholds(_bits(fp))[0].sum() for o in options]), len(options))
    return options[int(total.argmin())]


def links(nodes: DataFrame, distance: int = DISTANCE, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """Every pair a < b of distinct fingerprints that differ in at most ``distance`` bits."""
    plan = allocate(nodes, distance, parts)
    probes = nodes.mapInArrow(plan.probed, "part_value long, q long")
    index = nodes.mapInArrow(plan.indexed, "part_value long, x long")
    near = F.bit_count(F.col("q").bitwiseXOR(F.col("x"))) <= distance
    found = probes.join(index, (probes.part_value == index.part_value) & (F.col("q") < F.col("x")) & near)
    return found.select(F.col("q").alias("a"), F.col("x").alias("b")).distinct()


def groups(documents: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """doc_id, text_hash, fp, component_id of each document."""
    fps = cut_lineage(fingerprints(documents, shingle))
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = cut_lineage(components(links(classes.select("fp"), distance, parts)))
    members = classes.join(linked, classes.fp == linked.node)
    smallest = cut_lineage(members.groupBy("component").agg(F.min("least").alias("component_id")))
    joined = linked.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    labels = classes.join(cut_lineage(joined), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(cut_lineage(labels), "fp", "left").select("doc_id", "text_hash", "fp", "component_id")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    return groups(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(documents: DataFrame) -> DataFrame:
    """The document of smallest doc_id of each group, once, with its columns. Rows without doc_id go if their group has one with."""
    found = groups(documents)
    kept = cut_lineage(
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "fp")
        .agg(F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("times"))
    ).toDF("_id", "_fp", "_hash", "_times")
    match = documents["doc_id"].cast("long").eqNullSafe(kept["_id"]) & (F.xxhash64(documents["text"].cast("binary")) == kept["_hash"])
    out = documents.join(kept, match)
    if kept.where("_times > 1").isEmpty():
        return out.select(*[documents[c] for c in documents.columns])
    single = out.dropDuplicates(["_id", "_hash"])
    return single.select(*documents.columns)
