"""Sharding by a k-d tree, with DataFrame functions only.

Law ``bytes``: the leaves of the tree are shards of near equal bytes. Every node splits its rows at the weighted median of
their bytes along its widest metadata dimension; ``shards`` leaves take floor and ceil halves of a node's shards, so that
any number works. Dimensions are compared by their range in the node over their range in the table.

A median is found by narrowing: per round, one aggregation counts the bytes of each node in ``FANOUT`` slices of its
interval, and the slice that holds the median becomes the interval. It ends when that slice has no more than ``TOLERANCE``
of the node's bytes. Rows are ordered by (dimension, text_crc32, a hash of doc_id), as one long, so that rows of one value,
also a value of a third of all rows, can be split, and equal texts stay neighbours. Only slices, at most nodes x FANOUT
rows, come to the driver.

Nulls: a null text has size 1 and crc 0, null metadata counts as 0. Repeated rows each get their own slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nnfield.session import cut_lineage

SHARDS = 16
FANOUT = 2048
TOLERANCE = 1 / 4000
# Rows of one numbering task.
SLOT_ROWS = 50_000
VALUE_BITS, TIE_BITS = 24, 19
KEY_BITS = VALUE_BITS + 2 * TIE_BITS


def metadata(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions d0..d3: place in the id order, length, source, language."""
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.coalesce(F.crc32(text), F.lit(0))
    named = [F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << 20)) if c in documents.columns else F.lit(0) for c in ("source", "lang")]
    dims = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), size, *named]
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), crc.alias("text_crc32"),
                            *[d.cast("double").alias(f"d{i}") for i, d in enumerate(dims)])


def _key(node_range: dict[int, list[tuple[float, float]]], widest: dict[int, int]):
    """Order of a node's rows along its widest dimension, a long of KEY_BITS bits."""
    value = None
    for node, dim in widest.items():
        low, high = node_range[node][dim]
        scaled = F.floor((F.col(f"d{dim}") - low) / max(high - low, 1e-9) * ((1 << VALUE_BITS) - 1))
        value = F.when(F.col("node") == node, scaled) if value is None else value.when(F.col("node") == node, scaled)
    tie = F.shiftright(F.col("text_crc32"), 32 - TIE_BITS)
    last = F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    return F.coalesce(value, F.lit(0)).cast("long") * (1 << 2 * TIE_BITS) + tie * (1 << TIE_BITS) + last


def _medians(rows: DataFrame, targets: dict[int, float], totals: dict[int, int]) -> dict[int, int]:
    """For each node the key at which ``targets`` of its bytes lie before it, within TOLERANCE."""
    span = {n: (0, 1 << KEY_BITS, 0) for n in targets}  # from, to, bytes before
    done: dict[int, int] = {}
    while span:
        step = {n: max(1, -(-(high - low) // FANOUT)) for n, (low, high, _) in span.items()}
        inside = slices = None
        for n, (low, high, _) in span.items():
            here = (F.col("node") == n) & (F.col("key") >= low) & (F.col("key") < high)
            inside = here if inside is None else inside | here
            at = F.floor((F.col("key") - F.lit(low)) / F.lit(step[n]).cast("decimal(20,0)")).cast("int") if step[n] > 1 else (F.col("key") - F.lit(low)).cast("int")
            slices = F.when(F.col("node") == n, at) if slices is None else slices.when(F.col("node") == n, at)
        found: dict[int, list[tuple[int, int]]] = {n: [] for n in span}
        for r in rows.where(inside).groupBy("node", slices.alias("slice")).agg(F.sum("size").alias("size")).collect():
            found[r.node].append((r.slice, r.size))
        for n, (low, high, before) in list(span.items()):
            goal, cut, hit = targets[n] * totals[n], high, None
            for at, size in sorted(found[n]):
                if before + size > goal:
                    hit = (at, size)
                    break
                before += size
            if hit is None:
                done[n] = cut
                del span[n]
                continue
            start = low + hit[0] * step[n]
            if hit[1] <= TOLERANCE * totals[n] or step[n] == 1:
                # The nearer side of the slice.
                done[n] = start if goal - before <= hit[1] / 2 else start + step[n]
                del span[n]
            else:
                span[n] = (start, min(high, start + step[n]), before)
    return done


def kd_leaves(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds ``shard``, 0 to shards - 1: the leaf of each row of metadata()."""
    dims = [c for c in rows.columns if c.startswith("d") and c[1:].isdigit()]
    rows = rows.withColumn("node", F.lit(0).cast("int"))
    # A node is named by its first shard; leaves[node] is how many shards it becomes.
    leaves = {0: shards}
    whole: list[float] | None = None
    while any(n > 1 for n in leaves.values()):
        open_nodes = {n for n, k in leaves.items() if k > 1}
        stats = rows.where(F.col("node").isin(sorted(open_nodes))).groupBy("node").agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{name}_{d}") for d in dims for name, f in (("low", F.min), ("high", F.max))]).collect()
        if not stats:
            break
        whole = whole or [max(stats[0][f"high_{d}"] - stats[0][f"low_{d}"], 1e-9) for d in dims]
        ranges = {r.node: [(r[f"low_{d}"], r[f"high_{d}"]) for d in dims] for r in stats}
        widest = {n: max(range(len(dims)), key=lambda i: (x[i][1] - x[i][0]) / whole[i]) for n, x in ranges.items()}
        totals = {r.node: r.bytes for r in stats}
        keyed = rows.withColumn("key", _key(ranges, widest))
        medians = _medians(keyed, {n: (leaves[n] // 2) / leaves[n] for n in totals}, totals)
        side = None
        for n, cut in medians.items():
            right = F.when(F.col("key") >= cut, n + leaves[n] // 2).otherwise(n)
            side = F.when(F.col("node") == n, right) if side is None else side.when(F.col("node") == n, right)
        rows = cut_lineage(keyed.withColumn("node", side.otherwise(F.col("node")).cast("int")).drop("key"))
        split = {}
        for n, k in leaves.items():
            split |= {n: k // 2, n + k // 2: k - k // 2} if k > 1 else {n: k}
        leaves = split
    return rows.withColumnRenamed("node", "shard")


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard: rows are numbered in many small groups, and groups stand on one another."""
    groups = max(1, rows.count() // SLOT_ROWS)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(groups)).cast("int"))
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.col("part")).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")))
    sizes = rows.groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")
    bases = cut_lineage(sizes.select("shard", "part", before.alias("base")))
    order = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    return rows.withColumn("nth", F.row_number().over(order)).join(bases, ["shard", "part"]).withColumn("slot", F.col("base") + F.col("nth") - 1)


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document."""
    leaves = kd_leaves(cut_lineage(metadata(documents)), shards)
    return _numbered(leaves).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
