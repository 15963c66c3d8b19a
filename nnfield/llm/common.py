"""What several operators share: reading a table, row keys, Arrow helpers, word splitting."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnfield.session import scratch_path

# Characters that end a word, as bytes.split() has them: space and \x09 to \x0D.
ROWS_PER_BATCH = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text as bytes and the text's hash: rows of one doc_id with different texts stay apart in joins."""
    text = F.col("text").cast("binary")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def same_row(left: DataFrame, right: DataFrame):
    """Join condition on the key of keyed(); a null doc_id equals itself."""
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_hash == right.text_hash)


def widest_partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id) -> F.Column:
    """True for the rows no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS_PER_BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# Rows of one key from which on it counts as hot, and the most keys that can be hot.
HOT_ROWS = 2_000
HOT_KEYS = 200_000


def join_unique(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row per ``key`` whose column ``times`` says how many of the ``total`` rows
    have it. Keys of very many rows are met by broadcast, so that they need no shuffle: as ``times`` add up to the total,
    there are ``HOT_KEYS`` of them at most. All others are shuffled: tables that grow aren't sent through the driver."""
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(table.where(F.col("times") >= least))
    others = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("times") < least).hint("merge"), key)
    return rows.join(hot, key).unionByName(others)


def bucketed(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Like stored(), dealt by ``keys``: a later join on them reads the rows where they are. Where the rows come
    from a sort-merge join on the same keys, writing needs no shuffle either."""
    path = scratch_path(df.sparkSession, name)
    table = f"{name}_{path.rpartition('-')[2]}"
    writer = df.write.bucketBy(widest_partitions(df.sparkSession), *keys).sortBy(*keys)
    writer.option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as a compressed table below the shared folder and read again: like a checkpoint, but smaller on disk."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
