"""Frames seen through a field found on frame 0, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from nnfield.functions.pixels import mask_blend
from nnfield.operators.pairs import BROADCAST_ROWS, attach
from nnfield.operators.search import SearchOptions, bind_pairs, search_rounds
from nnfield.session import cut_lineage
from nnfield.sources.fields import read_field, write_field


def frame_pairs(clips: DataFrame, mode: str = "double") -> tuple[DataFrame, DataFrame]:
    """Pairs and pixels to match frame 0 of b onto frame 0 of a, one pair per clip.

    ``double`` compares each image a second time as its own partner, ``single`` has no second images.
    """
    if mode not in ("single", "double"):
        raise ValueError(f"mode {mode}")
    second = (lambda image: image) if mode == "double" else (lambda image: "cast(null as bigint)")
    first = clips.where("frame_no = 0 and role in ('a', 'b')")
    pixels = first.selectExpr("clip_id * 2 + if(role = 'a', 0, 1) as image_id", "h", "w", "y", "x", "v")
    pairs = first.where("role = 'b'").groupBy("clip_id").agg(
        F.max("h").alias("h"), F.max("w").alias("w"), F.max(F.size("v")).alias("c")
    )
    pairs = pairs.selectExpr(
        "clip_id as pair_id", "clip_id * 2 + 1 as a_img", f"{second('clip_id * 2 + 1')} as aa_img",
        "clip_id * 2 as b_img", f"{second('clip_id * 2')} as bb_img", "h", "w", "c",
    )
    return pairs, pixels


def clip_field(clips: DataFrame, options: SearchOptions, rounds: int, mode: str = "double") -> DataFrame:
    """Field of frame 0 of every clip: ``pair_id`` is the clip."""
    pairs, pixels = frame_pairs(clips, mode)
    return search_rounds(bind_pairs(pairs, pixels, options), options, rounds)


def warp_frames(frames: DataFrame, field: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``(clip_id, frame_no, ts, y, x, v)``: every frame of a' seen through the field of its clip.

    Each pixel of a frame goes to the field pixels that point to it, so frames need not be complete
    within a micro-batch. Field pixels that leave the image are not produced.
    """
    targets = field.selectExpr("pair_id as clip_id", "by as y", "bx as x", "ay", "ax")
    pixels = frames.where("role = 'a_prime'").select("clip_id", "frame_no", "ts", "y", "x", "v")
    met = attach(pixels, targets, ["clip_id", "y", "x"], ["frame_no"], broadcast_rows)
    return met.selectExpr("clip_id", "frame_no", "ts", "ay as y", "ax as x", "v")


def base_frame(clips: DataFrame) -> DataFrame:
    """Frame 0 of a' as the background of every clip."""
    return clips.where("frame_no = 0 and role = 'a_prime'").selectExpr("clip_id", "y", "x", "v as base")


FRAME_KEYS = ["clip_id", "frame_no", "ts", "y", "x"]
_HELD = "clip_id BIGINT, role STRING, frame_no INT, ts TIMESTAMP, h INT, w INT, y INT, x INT, v ARRAY<INT>"


def join_masks(warped: DataFrame, masks: DataFrame) -> DataFrame:
    """Pair frame i with mask frame i, in batch. Streams use ``blend_stream``, which loses no late row."""
    return warped.join(masks, FRAME_KEYS)


def unmet_pixels(warped: DataFrame, masks: DataFrame) -> DataFrame:
    """(clip_id, frame_no, ts, no_mask, no_frame): how many pixels ``join_masks`` leaves out, per frame that has some."""
    sides = warped.select(*FRAME_KEYS, F.lit(1).alias("side")).unionByName(masks.select(*FRAME_KEYS, F.lit(2).alias("side")))
    met = sides.groupBy(*FRAME_KEYS).agg(F.min("side").alias("low"), F.max("side").alias("high")).where("low = high")
    return met.groupBy("clip_id", "frame_no", "ts").agg(
        F.count_if(F.col("low") == 1).alias("no_mask"), F.count_if(F.col("low") == 2).alias("no_frame")
    )


def blend_frames(warped: DataFrame, masks: DataFrame, base: DataFrame,
                 broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """mask * warped + (1 - mask) * base: ``(clip_id, frame_no, ts, y, x, v ARRAY<DOUBLE>)``."""
    joined = attach(join_masks(warped, masks), base, ["clip_id", "y", "x"], ["frame_no"], broadcast_rows)
    return joined.select(*FRAME_KEYS, mask_blend(F.col("m"), F.col("v"), F.col("base")).alias("v"))


# ---------------------------------------------------------------- micro-batches
#
# Rows that wait for others are kept in ``held/batch=N``, written anew by every micro-batch: what batch N has
# to look at is its own rows and those of N - 1. There is no watermark, so nothing is ever late, and the
# state is only what waits. A batch that runs again replaces what it wrote.


def _as_rows(df: DataFrame, role: str, value: str = "v") -> DataFrame:
    """Masks and warped frames in the shape of frame rows."""
    size = [c if c in df.columns else f"cast(null as int) as {c}" for c in ("h", "w")]
    return df.selectExpr("clip_id", f"'{role}' as role", "frame_no", "ts", *size, "y", "x", f"{value} as v")


def _folder(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def held_rows(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Rows that still waited after the last micro-batch (before ``before``); empty if there was none."""
    empty = spark.createDataFrame([], _HELD)
    if before is not None:  # the folders of all earlier batches aren't listed
        path = f"{path}/batch={before - 1}"
    if not _folder(spark, path):
        return empty
    if before is not None:
        return spark.read.schema(_HELD).parquet(path)
    rows = spark.read.schema(f"{_HELD}, batch BIGINT").parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return empty if last is None else rows.where(F.col("batch") == last).drop("batch")


def _blend_met(warped: DataFrame, masks: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blended rows, rows of either side whose partner hasn't come), from rows in the shape of frames."""
    m = masks.select(*FRAME_KEYS, F.col("v").alias("m"))
    blended = blend_frames(warped.select(*FRAME_KEYS, "v"), m, base)
    rest = warped.join(m, FRAME_KEYS, "left_anti").unionByName(masks.join(warped, FRAME_KEYS, "left_anti"))
    return blended, rest


def blend_stream(warped: DataFrame, masks: DataFrame, base: DataFrame, out_path: str, held_path: str, checkpoint: str):
    """Stream of warped frames and stream of masks, blended over a stored base whenever both have come.

    ``held_rows(spark, held_path)`` shows what waits at the end.
    """
    both = _as_rows(warped, "warped").unionByName(_as_rows(masks, "mask", "m"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.unionByName(held_rows(batch.sparkSession, held_path, batch_id)).persist()
        try:
            blended, rest = _blend_met(rows.where("role = 'warped'"), rows.where("role = 'mask'"), base)
            blended.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            rest.select(*[c.split()[0] for c in _HELD.split(", ")]).write.mode("overwrite").parquet(f"{held_path}/batch={batch_id}")
        finally:
            rows.unpersist()

    return _started(both, handle, checkpoint)


def _started(rows: DataFrame, handle, checkpoint: str):
    return (
        rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _whole_first_frames(rows: DataFrame, roles: tuple[str, ...]) -> DataFrame:
    """Clips of which frame 0 is complete in all ``roles``."""
    per_role = rows.where((F.col("frame_no") == 0) & F.col("role").isin(*roles)).groupBy("clip_id", "role").agg(
        F.countDistinct("y", "x").alias("n"), F.max(F.expr("cast(h as bigint) * w")).alias("size")
    )
    return per_role.where("n = size").groupBy("clip_id").count().where(F.col("count") == len(roles)).select("clip_id")


def _registered(spark: SparkSession, path: str, before: int) -> DataFrame:
    """Clips that have a field, from the registry alone."""
    if not _folder(spark, f"{path}/clips"):
        return spark.createDataFrame([], "clip_id BIGINT")
    rows = spark.read.schema("clip_id BIGINT, batch BIGINT").parquet(f"{path}/clips")
    return rows.where(F.col("batch") < before).select("clip_id")


def warp_new_videos(frames: DataFrame, store: str, out_path: str, checkpoint: str, options: SearchOptions,
                    rounds: int, masks: DataFrame | None = None, mode: str = "double"):
    """Stream of clips in any order: a clip is matched once frame 0 of a and b (with masks also of a') is
    complete, its frames wait until then, and masked frames wait for their mask. All rows come out.

    Below ``store`` lie ``clips`` (a small registry), ``fields`` and ``bases`` (by bucket of the clip, so that a
    micro-batch reads only those of the clips it has) and ``held``. Frame rows of a and b beyond frame 0 have
    no use and aren't kept.
    """
    roles = ("a", "b") if masks is None else ("a", "b", "a_prime")
    stream = frames.where("role in ('a', 'b', 'a_prime')").select(*[c.split()[0] for c in _HELD.split(", ")])
    if masks is not None:
        stream = stream.unionByName(_as_rows(masks, "mask", "m"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.unionByName(held_rows(spark, f"{store}/held", batch_id)).where(
            "frame_no = 0 or role not in ('a', 'b')"
        ).persist()
        try:
            known = _registered(spark, store, batch_id)
            fresh = cut_lineage(_whole_first_frames(rows.where("role in ('a', 'b', 'a_prime')"), roles).join(known, "clip_id", "left_anti"))
            if not fresh.isEmpty():
                found = clip_field(rows.join(fresh, "clip_id", "left_semi"), options, rounds, mode)
                write_field(found, f"{store}/fields/batch={batch_id}")
                if masks is not None:
                    write_field(base_frame(rows.join(fresh, "clip_id", "left_semi")).selectExpr(
                        "clip_id as pair_id", "y as ay", "x as ax", "base"), f"{store}/bases/batch={batch_id}")
            fresh.write.mode("overwrite").parquet(f"{store}/clips/batch={batch_id}")
            ready = _registered(spark, store, batch_id + 1)
            usable = rows.join(ready, "clip_id", "left_semi")
            rest = rows.join(ready, "clip_id", "left_anti")
            arrived = rows.select(F.col("clip_id").alias("pair_id")).distinct().join(ready.withColumnRenamed("clip_id", "pair_id"), "pair_id")
            if not arrived.isEmpty():
                arrived = cut_lineage(arrived)
                field = read_field(spark, f"{store}/fields", arrived)
                warped = warp_frames(usable, field)
                out = warped.withColumn("v", F.col("v").cast("array<double>"))
                if masks is not None:
                    base = read_field(spark, f"{store}/bases", arrived).selectExpr("pair_id as clip_id", "ay as y", "ax as x", "base")
                    waiting = _as_rows(warped, "warped").unionByName(usable.where("role = 'warped'"))
                    out, unmet = _blend_met(cut_lineage(waiting), usable.where("role = 'mask'"), base)
                    rest = rest.unionByName(unmet)
                out.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
            rest.write.mode("overwrite").parquet(f"{store}/held/batch={batch_id}")
        finally:
            rows.unpersist()

    return _started(stream, handle, checkpoint)
