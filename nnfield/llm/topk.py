"""Exact top-k inner products over vectors sorted by length.

Components become floor(256 * x). Vectors are dealt by descending length, ties by vec_id, into blocks; a block is one row
of packed numbers. All vectors are turned by the eigenvectors of their summed outer products (the right singular vectors
of the table), so that the first coordinates hold most of a product. The longest vectors of all give every query a first
k-th score. Then each block of queries meets each block of vectors in turn from long to short: a vector can only matter if
the partial product over the first coordinates plus the product of the remaining lengths (Cauchy-Schwarz) reaches the
query's k-th score so far, and a block that cannot reach it by lengths alone is skipped whole. What is left is scored in
whole numbers. Each pair of blocks leaves at most k rows per query, and the last ranking is a window per query.

Queries are a stated set, ``vec_id`` divisible by ``every``; they and the vectors are both cut into blocks of bounded
size, nothing is broadcast whole. Vectors that are null, empty or hold null or non-finite components take no part; vectors
of different length meet only their own kind. Rows without vec_id take no part as queries and count as candidates after
all others in ties. Products that could pass 2**53 are summed
in whole numbers; a score beyond 64 bits is held at their end, a component beyond 2**62 (times 256) at that. Equal query rows
are one query; the different vectors of one vec_id share one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnfield.llm.common import widest_partitions
from nnfield.session import cut_lineage

K = 5
EVERY = 50
BLOCK = 2048
QUERY_BLOCK = 512
# Blocks of vectors that one task goes through with a running k-th score.
BLOCKS_A_TASK = 16
LEAD = 16
NO_ID = (1 << 63) - 1
EXACT = 2.0**53
LARGEST = 2.0**62

# Packed numbers take 2 or 8 bytes.
_KINDS = {2: np.int16, 8: np.int64}

_PACKED = "dim int, ids binary, numbers binary, longest double"
_FOUND = "query_id long, vec_id long, score long"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of long), dim, length; only vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(F.greatest(F.least(e * 256.0, F.lit(LARGEST)), F.lit(-LARGEST))).cast("long"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    return (embeddings.where(fine).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"))
            .withColumn("dim", F.size("v")).withColumn("length", length))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _pack(rows_a_block: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dim: int, ids: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
            small = np.abs(numbers).max() < 1 << 15
            longest = float(np.sqrt((numbers.astype(np.float64) ** 2).sum(axis=1).max()))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([numbers.astype(np.int16 if small else np.int64).tobytes()], pa.binary()), pa.array([longest])],
                                              ["dim", "ids", "numbers", "longest"])

        for part in parts:
            dims = part.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                rows = part.filter(pa.array(dims == dim))
                held.setdefault(dim, []).append((rows.column(0).to_numpy().astype(np.int64), _matrix(rows.column(1))))
                if sum(len(i) for i, _ in held[dim]) >= rows_a_block:
                    ids, numbers = (np.concatenate(x) for x in zip(*held[dim]))
                    for at in range(0, len(ids), rows_a_block):
                        yield block(dim, ids[at : at + rows_a_block], numbers[at : at + rows_a_block])
                    held[dim] = []
        for dim, own in held.items():
            if own:
                ids, numbers = (np.concatenate(x) for x in zip(*own))
                for at in range(0, len(ids), rows_a_block):
                    yield block(dim, ids[at : at + rows_a_block], numbers[at : at + rows_a_block])

    return run


def _unpack(ids: bytes, numbers: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    kind = _KINDS[len(numbers) // (len(ids) * dim)]
    return ids, np.frombuffer(numbers, kind).reshape(-1, dim).astype(np.int64)


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per dimension the eigenvectors of the summed outer products, largest first. The sums are dim x dim numbers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            dims = part.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                x = _matrix(part.filter(pa.array(dims == dim)).column(0)).astype(np.float64)
                sums[dim] = sums.get(dim, 0) + x.T @ x
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim * dim, dim, np.int32)), pa.array(np.arange(dim * dim)), pa.array(s.ravel())], ["dim", "i", "x"])

    rows = vectors.select("v", "dim").mapInArrow(run, "dim int, i long, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).collect()
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums.setdefault(r.dim, np.zeros(r.dim * r.dim))[r.i] = r.x
    return {dim: np.linalg.eigh(s.reshape(dim, dim))[1][:, ::-1] for dim, s in sums.items()}


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < EXACT:
        return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
    return np.array([[_long(u, w) for w in x] for u in q], np.int64).reshape(len(q), len(x))


def _long(u: np.ndarray, w: np.ndarray) -> int:
    return max(-(1 << 63) + 1, min((1 << 63) - 1, sum(a * b for a, b in zip(u.tolist(), w.tolist()))))


class _Best:
    """The k best of each query of a block, ties to the smaller vec_id."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray) -> None:
        self.ids, self.k = ids, k
        self.scores, self.found = np.full((len(ids), k), np.iinfo(np.int64).min), np.full((len(ids), k), NO_ID)
        self.count = np.zeros(len(ids), np.int64)
        self.floor = floor.copy()  # a k-th score that is known to be reached

    def offer(self, q: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        """Candidates (query row, vec_id, score), any number per query, none of them met before."""
        have = np.repeat(np.arange(len(self.ids)), self.count)
        old = np.arange(self.k)[None, :] < self.count[:, None]
        q, vec, score = np.concatenate((have, q)), np.concatenate((self.found[old], vec)), np.concatenate((self.scores[old], score))
        order = np.lexsort((vec, -score, q))
        q, vec, score = q[order], vec[order], score[order]
        start = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - start[q]
        top = rank < self.k
        self.found[q[top], rank[top]], self.scores[q[top], rank[top]] = vec[top], score[top]
        self.count = np.minimum(self.k, np.diff(np.append(start, len(q))))
        full = self.count == self.k
        self.floor[full] = np.maximum(self.floor[full], self.scores[full, -1])

    def rows(self) -> pa.RecordBatch:
        old = np.arange(self.k)[None, :] < self.count[:, None]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, self.count)), pa.array(self.found[old]), pa.array(self.scores[old])], ["query_id", "vec_id", "score"])


def _scan(best: _Best, queries: np.ndarray, ids: np.ndarray, numbers: np.ndarray, turn: np.ndarray) -> None:
    """One block of vectors against one block of queries."""
    lead = min(LEAD, turn.shape[1])
    q, x = queries.astype(np.float64) @ turn, numbers.astype(np.float64) @ turn
    length_q, length_x = np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1)
    slack = 1e-9 * (length_q.max(initial=0) * length_x.max(initial=0) + 1)
    # A score at the low end of 64 bits may stand for a lower one.
    floor = np.where(best.floor <= -(1 << 63) + 1, -np.inf, best.floor.astype(np.float64))
    alive = np.flatnonzero(length_q * length_x.max(initial=0) + slack >= floor)
    if not len(alive):
        return
    bound = q[alive, :lead] @ x[:, :lead].T + np.outer(np.linalg.norm(q[alive, lead:], axis=1), np.linalg.norm(x[:, lead:], axis=1))
    rows, columns = np.nonzero(bound + slack >= floor[alive][:, None])
    rows = alive[rows]
    other = ids[columns] != best.ids[rows]
    rows, columns = rows[other], columns[other]
    if not len(rows):
        return
    if len(rows) * 8 > len(alive) * len(ids):
        score = _products(queries[alive], numbers)[np.searchsorted(alive, rows), columns]
    else:
        score = np.concatenate([_pairwise(queries[rows[a : a + 65536]], numbers[columns[a : a + 65536]]) for a in range(0, len(rows), 65536)])
    keep = score >= best.floor[rows]
    best.offer(rows[keep], ids[columns[keep]], score[keep])


def _pairwise(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    if float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1] < EXACT:
        return np.einsum("ij,ij->i", q, x)
    return np.array([_long(u, w) for u, w in zip(q, x)], np.int64)


def _search(turns: dict[int, np.ndarray], k: int):
    """Rows: qdim, qids, qnumbers, floors, blocks (array of ids, numbers from long to short)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for dim, qids, qnumbers, floors, blocks in zip(*(part.column(i).to_pylist() for i in range(5))):
                ids, queries = _unpack(qids, qnumbers, dim)
                best = _Best(ids, k, np.frombuffer(floors, np.int64) if floors else np.full(len(ids), np.iinfo(np.int64).min))
                for b in sorted(blocks, key=lambda b: -b["longest"]):
                    _scan(best, queries, *_unpack(b["ids"], b["numbers"], dim), turns[dim])
                yield best.rows()

    return run


def search(embeddings: DataFrame, every: int = EVERY, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query."""
    spark = embeddings.sparkSession
    vectors = cut_lineage(whole_vectors(embeddings))
    turns = rotations(vectors)
    width = widest_partitions(spark)
    queries = vectors.where((F.col("vec_id") % every == 0) & (F.col("vec_id") != NO_ID)).dropDuplicates(["vec_id", "v"])
    slices = vectors.repartitionByRange(max(width, -(-vectors.count() // (block * BLOCKS_A_TASK))), "dim", F.desc("length"), "vec_id").sortWithinPartitions("dim", F.desc("length"), "vec_id")
    blocks = cut_lineage(slices.select("vec_id", "v", "dim").mapInArrow(_pack(block), _PACKED))
    asked = cut_lineage(queries.select("vec_id", "v", "dim").repartition(max(1, -(-queries.count() // query_block)), "vec_id").mapInArrow(_pack(query_block), _PACKED))
    asked = asked.select("dim", F.col("ids").alias("qids"), F.col("numbers").alias("qnumbers"), F.xxhash64("ids").alias("asked"), F.col("longest").alias("far"))

    # The longest block of each dimension gives first k-th scores; each query block takes them along.
    first = blocks.groupBy("dim").agg(F.max_by(F.struct("ids", "numbers", "longest"), "longest").alias("b"))
    seeded = asked.join(first, "dim").select("dim", "qids", "qnumbers", F.lit(None).cast("binary").alias("floors"), F.array("b").alias("blocks"), "asked", "far")

    def seeds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for dim, qids, qnumbers, blocks_ in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4))):
                ids, rows = _unpack(qids, qnumbers, dim)
                best = _Best(ids, k, np.full(len(ids), np.iinfo(np.int64).min))
                for b in blocks_:
                    _scan(best, rows, *_unpack(b["ids"], b["numbers"], dim), turns[dim])
                length = np.linalg.norm(rows.astype(np.float64), axis=1)
                # A vector shorter than this can't reach any query's k-th score.
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.where((length > 0) & (best.floor > -(1 << 63) + 1), best.floor / length, -np.inf)
                out.append((best.floor.tobytes(), float(least.min(initial=np.inf)) * (1 - 1e-9)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out]), part.column(5)],
                                             ["dim", "qids", "qnumbers", "floors", "least", "asked"])

    ready = cut_lineage(seeded.mapInArrow(seeds, "dim int, qids binary, qnumbers binary, floors binary, least double, asked long"))

    # Blocks of neighbouring length form runs; a run that no query of a block can need isn't sent to it. Only the names
    # and lengths of blocks are ranked.
    named = blocks.withColumn("name", F.xxhash64("ids", "numbers"))
    ranked = named.select("dim", "name", "longest").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("longest"), "name")) - 1)
    ranked = cut_lineage(ranked.select("dim", "name", F.floor(F.col("nth") / BLOCKS_A_TASK).alias("run")))
    runs = named.join(ranked, ["dim", "name"]).groupBy("dim", "run").agg(F.collect_list(F.struct("ids", "numbers", "longest")).alias("blocks"))
    reach = named.join(ranked, ["dim", "name"]).groupBy("dim", "run").agg(F.max("longest").alias("reach"))
    last = (ranked.agg(F.max("run")).first()[0] or 0) + 1
    wanted = ready.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(int(last) - 1)))).withColumn("run", F.col("run").cast("long"))
    wanted = wanted.join(reach, ["dim", "run"]).where((F.col("reach") >= F.col("least")) | (F.col("least") <= 0))
    pairs = wanted.join(runs, ["dim", "run"]).select("dim", "qids", "qnumbers", "floors", "blocks")
    found = pairs.repartition(width).mapInArrow(_search(turns, k), _FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"),
                         F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")
