"""Image tables: files, buffers, pixel rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, height, width, channels, data BINARY, valid); the decoder gives BGR order.

    A file that is no image stays, with ``valid`` false and no pixels.
    """
    return image_columns(spark.read.format("image").option("dropInvalid", "false").load(path))


def image_columns(files: DataFrame) -> DataFrame:
    """Rows of Spark's image source as columns."""
    return files.select(
        F.col("image.origin").alias("path"),
        F.col("image.height").alias("height"),
        F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("data"),
        (F.col("image.height") > 0).alias("valid"),
    )


def byte_values(data: str) -> str:
    """BINARY to ARRAY<INT> of 0..255, as SQL text; in one pass, each byte as one Latin-1 character."""
    return f"transform(split(decode({data}, 'ISO-8859-1'), ''), e -> ascii(e))"


def explode_pixels(images: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys.., h, w, y, x, v ARRAY<INT>) from a row-major, channel-interleaved buffer.

    ``images(keys.., height, width, channels, data)`` with ``data`` an ARRAY<INT> or BINARY.
    """
    keys = keys or ["image_id"]
    images = images.where("height > 0 and width > 0")
    if dict(images.dtypes)["data"] == "binary":
        images = images.withColumn("data", F.expr(byte_values("data")))
    at = images.selectExpr(
        *keys, "height as h", "width as w", "channels", "data", "explode(sequence(0, height * width - 1)) as p"
    )
    return at.selectExpr(
        *keys, "h", "w", "cast(p div w as int) as y", "p % w as x",
        "slice(data, p * channels + 1, channels) as v",
    )


def assemble_images(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys.., height, width, channels, data ARRAY<INT>) from pixel rows (keys.., h, w, y, x, value), row-major.

    Pixels become lines and lines become images, so that a list in memory holds one line's pixels or one
    image's lines. Values outside 0..255 are cut off, fractions are dropped.
    """
    byte = f"transform({value}, e -> cast(least(greatest(floor(e), 0), 255) as int))"
    rows = pixels.selectExpr(*keys, "h", "w", "y", "x", f"{byte} as v").repartition(*keys)
    lines = rows.groupBy(*keys, "h", "w", "y").agg(F.expr("array_sort(collect_list(struct(x, v))) as cells"))
    lines = lines.selectExpr(*keys, "h", "w", "size(cells[0].v) as channels", "struct(y, flatten(cells.v) as line) as line")
    images = lines.groupBy(*keys, "h", "w").agg(F.expr("max(channels) as channels"), F.expr("array_sort(collect_list(line)) as lines"))
    return images.selectExpr(*keys, "h as height", "w as width", "channels", "flatten(lines.line) as data")


def write_images(pixels: DataFrame, path: str) -> None:
    """Pixel rows with a ``role`` column to Parquet, one folder per role."""
    pixels.write.mode("overwrite").partitionBy("role").parquet(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
