"""Top-k inner products against all pairs."""

import math

import numpy as np
import pytest

from nnfield.llm import topk


def brute(rows, every, k):
    whole = []
    for i, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(256 * x) for x in v]))
    out = []
    for at, (i, q) in enumerate(whole):
        if i is None or i % every:
            continue
        own = [(-sum(a * b for a, b in zip(q, x)), j if j is not None else math.inf) for j, x in whole if j != i and len(x) == len(q)]
        out += [(i, r + 1, None if j == math.inf else j, -s) for r, (s, j) in enumerate(sorted(own)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,query_block", [(2048, 512), (16, 3)])
def test_equals_brute_force(spark, block, query_block):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=20) * rng.choice([0.1, 1, 3])).astype(np.float32).tolist()) for i in range(400)]
    rows += [(500 + i, rows[0][1]) for i in range(20)] + [(600, [0.0] * 20), (610, [0.0] * 20)]
    rows += [(700, None), (701, []), (702, [1.0, None]), (703, [float("nan")] * 20), (704, [float("inf")] * 20), (710, [1.0, -2.0]), (711, [0.5, 1.0]), (None, rows[5][1])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, length double").repartition(4)
    found = topk.search(table, 10, 5, block, query_block)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == brute(rows, 10, 5)


def test_large_numbers_and_empty_table(spark):
    rows = [(i, [1e5 * (i + 1), -3e5 * i]) for i in range(8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.search(table, 4, 3).collect()) == brute(rows, 4, 3)
    beyond = spark.createDataFrame([(0, [1e14]), (1, [1e14]), (3, [-1e14])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(beyond, 50).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, -(2**63) + 1)]
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_repeated_queries_and_large_components(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0])] + [(i, [float(i), 1.0]) for i in range(1, 8)] + [(9, [2e15, 0.0]), (9, [2e15, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(r.query_id, r["rank"], r.vec_id) for r in topk.search(table, 50, 5).orderBy("rank").collect()]
    assert found == [(0, 1, 9), (0, 2, 9), (0, 3, 7), (0, 4, 6), (0, 5, 5)]
    # scores beyond 64 bits are held at their end and tie
    huge = spark.createDataFrame([(0, [2e15, 0.0]), (1, [3.0, 0.0]), (2, [1e300, 0.0]), (3, [-1e300, 0.0]), (4, [1 / 256, 0.0])], "vec_id long, embedding array<double>")
    most = 2**63 - 1
    assert [(r.vec_id, r.score) for r in topk.search(huge, 50).orderBy("rank").collect()] == [(1, most), (2, most), (4, 512 * 10**15), (3, -most)]
