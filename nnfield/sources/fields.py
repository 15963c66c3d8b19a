"""Stored fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

FIELD_BUCKETS = 64


def write_field(field: DataFrame, path: str, buckets: int = FIELD_BUCKETS, mode: str = "overwrite") -> None:
    """One folder per ``pair_id`` bucket, so that readers of a few pairs prune the rest.

    Rows are spread over the writers by pixel rows too: a pair of any size is written by many tasks.
    """
    bucketed = field.withColumn("pair_bucket", F.pmod("pair_id", F.lit(buckets)).cast("int"))
    bucketed.repartition("pair_bucket", "pair_id", F.expr("ay div 64")).write.mode(mode).partitionBy(
        "pair_bucket"
    ).parquet(path)


def read_field(spark: SparkSession, path: str, pairs: DataFrame | None = None, buckets: int = FIELD_BUCKETS) -> DataFrame:
    """The stored field, or that of ``pairs(pair_id)`` only: folders of other buckets aren't read."""
    field = spark.read.parquet(path)
    if pairs is not None:
        wanted = pairs.select("pair_id").distinct()
        used = wanted.select(F.pmod("pair_id", F.lit(buckets)).cast("int").alias("b")).distinct().collect()
        field = field.where(F.col("pair_bucket").isin([r.b for r in used])).join(wanted, "pair_id", "left_semi")
    return field.drop("pair_bucket")
