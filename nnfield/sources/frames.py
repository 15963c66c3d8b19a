"""Video frames as tables: one row per pixel and frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nnfield.sources.files import BINARY_SCHEMA, decode_files
from nnfield.sources.images import explode_pixels, image_columns

FRAME_SCHEMA = (
    "clip_id BIGINT, role STRING, frame_no INT, ts TIMESTAMP, h INT, w INT, y INT, x INT, v ARRAY<INT>"
)
FRAME_ROLES = ("a", "b", "a_prime", "mask")
# The end of a frame file's path: clip, role, frame number.
FRAME_PATH = r"(\d+)[-/](a|b|a_prime|mask)[-/](\d+)\.\w+$"
# The columns of Spark's image source.
_IMAGE_SCHEMA = "image STRUCT<origin: STRING, height: INT, width: INT, nChannels: INT, mode: INT, data: BINARY>"
# Pixel rows a file takes, some tens of MB, and the fewest files of a table, so that small ones too arrive in parts.
FILE_PIXELS = 2_000_000
LEAST_FILES = 12
MASK_SCHEMA = "clip_id BIGINT, frame_no INT, ts TIMESTAMP, y INT, x INT, m ARRAY<INT>"


def scan_frames(spark: SparkSession, path: str, schema: str = FRAME_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_frames(
    spark: SparkSession, path: str, schema: str = FRAME_SCHEMA, files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_frame_files(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, pattern: str = FRAME_PATH, png: bool = False
) -> DataFrame:
    """Image files below ``path`` as they arrive: (path, clip_id, role, frame_no, height, width, channels, data, reason).

    Clip, role and frame number are the groups of ``pattern`` in the path. ``reason`` names why a file is no
    frame: no image, or a path that says nothing; else it is null. Pixels have the decoder's channel order. ``png``: the
    files are such as ``scan_png`` reads, and are read as it does.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if png:
        files = decode_files(reader.schema(BINARY_SCHEMA).format("binaryFile").load(path))
    else:
        files = image_columns(reader.schema(_IMAGE_SCHEMA).option("dropInvalid", "false").format("image").load(path))
    part = lambda k: F.regexp_extract("path", pattern, k)
    named = files.select(
        "path", part(1).try_cast("bigint").alias("clip_id"), part(2).alias("role"), part(3).try_cast("int").alias("frame_no"),
        "height", "width", "channels", "data",
    )
    known = F.col("clip_id").isNotNull() & F.col("frame_no").isNotNull() & F.col("role").isin(*FRAME_ROLES)
    reason = F.when(~F.coalesce(known, F.lit(False)), "unknown path").when(F.coalesce(F.col("height"), F.lit(0)) <= 0, "not an image")
    return named.withColumn("reason", reason)


def frame_pixels(files: DataFrame, frame_millis: int, start: str = "1970-01-01 00:00:00") -> DataFrame:
    """Frame rows (``FRAME_SCHEMA``) of the files that are frames; frame n is ``frame_millis`` * n after ``start`` (UTC)."""
    at = f"timestamp_millis(unix_millis(timestamp'{start} UTC') + {frame_millis} * cast(frame_no as bigint))"
    keyed = files.where("reason is null").selectExpr("clip_id", "role", "frame_no", f"{at} as ts", "height", "width", "channels", "data")
    return explode_pixels(keyed, ["clip_id", "role", "frame_no", "ts"])


def frame_files_to_table(files: DataFrame, path: str, rejected: str, checkpoint: str, frame_millis: int, start: str = "1970-01-01 00:00:00"):
    """Append a stream of files to a frame table at ``path`` and what is no frame to ``rejected(path, reason)``.

    A micro-batch that runs again replaces what it wrote. All available files, then stop.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        frame_pixels(batch, frame_millis, start).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.where("reason is not null").select("path", "reason").write.mode("overwrite").parquet(f"{rejected}/batch={batch_id}")

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def write_frames(frames: DataFrame, path: str, clip: str = "clip_id", frames_per_file: int = 64,
                 rows_per_file: int = 256) -> None:
    """Frames in order within each file: whole pieces of ``frames_per_file`` frames of one role and a band of pixel rows.

    Small pieces share a file, so that a stream has as many files to take as there is data, not as there are clips.
    """
    order = [c for c in (clip, "role", "frame_no", "y", "x") if c in frames.columns]
    role = [c for c in ("role",) if c in frames.columns]
    pieces = [F.expr(f"frame_no div {frames_per_file}"), F.expr(f"y div {rows_per_file}")]
    _in_files(frames, clip, *role, *pieces).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_clips(frames: DataFrame, path: str) -> None:
    """Append frames or masks with the rows of a clip in one file, beside those of other clips."""
    _in_files(frames, "clip_id").write.mode("append").parquet(path)


def _in_files(frames: DataFrame, *keys) -> DataFrame:
    """The rows dealt by ``keys`` to as many partitions as they fill files."""
    return frames.repartition(max(LEAST_FILES, -(-frames.count() // FILE_PIXELS)), *keys)


def stream_to_files(stream: DataFrame, path: str, checkpoint: str, name: str | None = None):
    """Append the results of a stream to Parquet, all available input then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()
