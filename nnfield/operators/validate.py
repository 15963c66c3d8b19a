"""Checks to run before matching. Both return the violations, so an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nnfield.operators.pairs import bind_roles

VIDEO_ROLES = ("a", "b", "a_prime")


def descriptors(images: DataFrame) -> DataFrame:
    """(image_id, height, width, channels) of pixel rows or image rows; incomplete images have height 0."""
    if "data" in images.columns:
        whole = "height > 0 and width > 0 and coalesce({}, -1) = cast(height as bigint) * width * channels"
        size = "length(data)" if dict(images.dtypes)["data"] == "binary" else "size(data)"
        return images.selectExpr("image_id", f"if({whole.format(size)}, height, 0) as height", "width", "channels").distinct()
    seen = images.groupBy("image_id").agg(
        F.min("h").alias("h0"), F.max("h").alias("height"), F.min("w").alias("w0"), F.max("w").alias("width"),
        F.min(F.size("v")).alias("c0"), F.max(F.size("v")).alias("channels"), F.count("*").alias("n"),
        F.min(F.expr("y >= 0 and x >= 0 and y < h and x < w")).alias("inside"),
    )
    whole = "h0 = height and w0 = width and c0 = channels and inside and n = cast(height as bigint) * width"
    return seen.selectExpr("image_id", f"if({whole}, height, 0) as height", "width", "channels")


def pair_violations(pairs: DataFrame, images: DataFrame, channels: int | None = None) -> DataFrame:
    """(pair_id, reason) of the pairs whose images are missing, incomplete, unlike each other or unlike the pair, or of
    other ``channels`` than wanted."""
    held = descriptors(images)
    unlike = check_shapes(pairs, held).selectExpr("pair_id", "if(images < wanted, 'missing image', 'unequal shapes') as reason")
    stated = bind_roles(pairs, held, {"a": "a_img"}).join(pairs.select("pair_id", "h", "w", "c"), "pair_id").where(
        "not (height <=> h and width <=> w and channels <=> c) or height = 0"
    ).selectExpr("pair_id", "if(height = 0, 'incomplete image', 'unlike the pair') as reason")
    if channels is not None:
        stated = stated.unionByName(pairs.where(F.col("c") != channels).select("pair_id", F.lit("other channels").alias("reason")))
    return unlike.unionByName(stated).groupBy("pair_id").agg(F.min("reason").alias("reason"))


def check_shapes(pairs: DataFrame, images: DataFrame) -> DataFrame:
    """Pairs whose images differ in height, width or channels, or are missing.

    ``images(image_id, height, width, channels)`` holds descriptors only.
    """
    wanted = sum(F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("a_img", "aa_img", "b_img", "bb_img"))
    found = bind_roles(pairs, images).groupBy("pair_id").agg(
        F.count("*").cast("int").alias("images"),
        *[F.min(c).alias(f"min_{c}") for c in ("height", "width", "channels")],
        *[F.max(c).alias(f"max_{c}") for c in ("height", "width", "channels")],
    )
    broken = F.col("images").isNull() | (F.col("images") < F.col("wanted"))
    for c in ("height", "width", "channels"):
        broken = broken | (F.col(f"min_{c}") != F.col(f"max_{c}"))
    return (
        pairs.select("pair_id", wanted.cast("int").alias("wanted"))
        .join(found, "pair_id", "left")
        .where(broken)
        .select(
            "pair_id", "wanted", F.coalesce("images", F.lit(0)).alias("images"),
            "min_height", "max_height", "min_width", "max_width", "min_channels", "max_channels",
        )
    )


def frame_gaps(frames: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(clip_id, frame_no, missing, unlike_ts): frames that some video (or mask) of a clip lacks, and frames of
    a' whose mask has another time.

    ``frames(clip_id, role, frame_no, ts, ..)``. ``missing`` names the roles, sorted and joined by commas. Equal counts
    with unlike numbers show here. Two aggregations, whose partial results have one row per clip, role and frame.
    """
    roles = list(VIDEO_ROLES)
    used = frames.where(F.col("role").isin(*VIDEO_ROLES)).select("clip_id", "role", "frame_no", "ts")
    if masks is not None:
        used = used.unionByName(masks.select("clip_id", F.lit("mask").alias("role"), "frame_no", "ts"))
        roles.append("mask")
    each = used.groupBy("clip_id", "role", "frame_no").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    at = lambda role, end: F.max(F.when(F.col("role") == role, F.col(end)))
    unlike = ~(at("a_prime", "first").eqNullSafe(at("mask", "first")) & at("a_prime", "last").eqNullSafe(at("mask", "last")))
    there = lambda role: F.max((F.col("role") == role).cast("int")) == 1
    seen = each.groupBy("clip_id", "frame_no").agg(
        F.concat_ws(",", *[F.when(~there(r), F.lit(r)) for r in sorted(roles)]).alias("missing"),
        (there("a_prime") & there("mask") & unlike).alias("unlike_ts"),
    )
    return seen.where((F.col("missing") != "") | F.col("unlike_ts"))


def clip_violations(frames: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """(clip_id, frames, first_frame, missing): clips with gaps, how many frames have one, and what the first lacks;
    ``ts`` where only the mask's time differs."""
    gaps = frame_gaps(frames, masks).withColumn("what", F.when(F.col("missing") == "", F.lit("ts")).otherwise(F.col("missing")))
    return gaps.groupBy("clip_id").agg(
        F.count("*").cast("int").alias("frames"), F.min("frame_no").alias("first_frame"), F.min_by("what", "frame_no").alias("missing")
    )


def check_frame_counts(frames: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Clips whose videos differ in their number of frames.

    ``frames(clip_id, role, frame_no, ..)``; a mask given must be as long as the others.
    """
    used = frames.where(F.col("role").isin(*VIDEO_ROLES)).select("clip_id", "role", "frame_no")
    roles = len(VIDEO_ROLES)
    if masks is not None:
        used = used.unionByName(masks.select("clip_id", F.lit("mask").alias("role"), "frame_no"))
        roles += 1
    per_role = used.groupBy("clip_id", "role").agg(F.countDistinct("frame_no").cast("int").alias("frames"))
    return (
        per_role.groupBy("clip_id")
        .agg(
            F.count("*").cast("int").alias("roles"),
            F.min("frames").alias("min_frames"),
            F.max("frames").alias("max_frames"),
        )
        .where((F.col("min_frames") != F.col("max_frames")) | (F.col("roles") < roles))
    )
