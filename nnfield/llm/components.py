"""Connected components of an edge table by alternating large-star and small-star steps, all state in Spark.

Every step is written as a table and read again: a checkpoint would keep the estimated size of its plan, which for a join is the
product of both sides, so that in a loop the number itself grows without bound on the driver. The number of files follows the
number of edges, not the partitions of a shuffle: most tables are small, and a file takes longer than its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import stored

# Edges a file of a step holds.
FILE_EDGES = 500_000


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """One step: the neighbours of a node are tied to the smallest of them. ``edges`` has a > b, distinct; neither the
    nodes nor the edges after the step are more than ``most``."""
    files = max(1, -(-most // FILE_EDGES))
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # The smallest neighbours are written, so that the join meets two plain exchanges and a node of very many edges can be split.
    least = stored(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(files), "least")
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return stored(out.where("a <> b").distinct().coalesce(files), "edges")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node that can be reached.

    Loops, repeated edges and either direction are fine; an empty table gives an empty table.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = stored(pairs.distinct(), "edges")
    before = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now[0] == 0 or now == before:
            break
        before = now
        # an edge has two nodes; a large star makes no edges more, a small one at most one for each of its own
        pairs = _star(_star(pairs, True, 2 * now[0]), False, 2 * now[0])
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
