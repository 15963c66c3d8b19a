"""Image, video and pair tables derived from the given Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SIDE = 8
FRAMES_PER_VIDEO = 25
FRAME_MILLIS = 40
START = "2024-01-01 00:00:00"
EVENT_WIDTH = 50
EVENT_SHIFT = (3, 5)
CLIP_ROLES = ("a", "b", "a_prime", "mask")


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8x8 image per embedding: (image_id, height, width, channels, data)."""
    value = lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("image_id"),
        F.lit(SIDE).alias("height"), F.lit(SIDE).alias("width"), F.lit(1).alias("channels"),
        F.transform("embedding", value).alias("data"),
    )


def event_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two large images with 3 channels: 0 from the events, 1 the same moved with wrap-around."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = (events.agg(F.max("event_id")).first()[0] + EVENT_WIDTH) // EVENT_WIDTH
    image = events.select(
        F.lit(rows).cast("int").alias("h"), F.lit(EVENT_WIDTH).alias("w"),
        F.expr(f"cast(event_id div {EVENT_WIDTH} as int)").alias("y"),
        (F.col("event_id") % EVENT_WIDTH).cast("int").alias("x"),
        F.array(
            (F.col("user_id") % 256).cast("int"),
            F.least(F.floor("value"), F.lit(255)).cast("int"),
            F.length("event_type") * 20,
        ).alias("v"),
    )
    dy, dx = EVENT_SHIFT
    return image.select(
        F.explode(F.expr("array(0L, 1L)")).alias("image_id"), "h", "w", "y", "x", "v"
    ).select(
        "image_id", "h", "w",
        F.when(F.col("image_id") == 0, F.col("y")).otherwise(F.pmod(F.col("y") - dy, F.col("h"))).alias("y"),
        F.when(F.col("image_id") == 0, F.col("x")).otherwise(F.pmod(F.col("x") - dx, F.col("w"))).alias("x"),
        "v",
    )


def square_pair(spark: SparkSession, sf_dir: str, side: int = 224) -> tuple[DataFrame, DataFrame]:
    """(pair, pixels) of a side x side x 3 image from the first events and its moved copy; needs side**2 events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where(F.col("event_id") < side * side)
    image = events.select(
        F.expr(f"cast(event_id div {side} as int)").alias("y"), (F.col("event_id") % side).cast("int").alias("x"),
        F.array((F.col("user_id") % 256).cast("int"), F.least(F.floor("value"), F.lit(255)).cast("int"), F.length("event_type") * 20).alias("v"),
    )
    dy, dx = EVENT_SHIFT
    moved = image.select(F.lit(1).cast("long").alias("image_id"), ((F.col("y") + dy) % side).alias("y"), ((F.col("x") + dx) % side).alias("x"), "v")
    pixels = image.select(F.lit(0).cast("long").alias("image_id"), "y", "x", "v").unionByName(moved)
    pixels = pixels.select("image_id", F.lit(side).alias("h"), F.lit(side).alias("w"), "y", "x", "v")
    pair = spark.range(1).selectExpr("0L as pair_id", "0L as a_img", "cast(null as long) as aa_img", "1L as b_img", "cast(null as long) as bb_img", f"{side} as h", f"{side} as w", "3 as c")
    return pair, pixels


def event_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one pair of the two event images."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.agg(F.max("event_id").alias("last")).select(
        F.lit(0).cast("long").alias("pair_id"),
        F.lit(0).cast("long").alias("a_img"), F.lit(None).cast("long").alias("aa_img"),
        F.lit(1).cast("long").alias("b_img"), F.lit(None).cast("long").alias("bb_img"),
        F.expr(f"cast((last + {EVENT_WIDTH}) div {EVENT_WIDTH} as int)").alias("h"),
        F.lit(EVENT_WIDTH).alias("w"), F.lit(3).alias("c"),
    )


def frames(spark: SparkSession, sf_dir: str, frame_millis: int = FRAME_MILLIS) -> DataFrame:
    """Videos of 25 frames, at 25 fps unless stated, one row per pixel."""
    from nnfield.sources.images import explode_pixels

    return explode_pixels(embedding_images(spark, sf_dir)).select(
        F.expr(f"image_id div {FRAMES_PER_VIDEO}").alias("video_id"),
        (F.col("image_id") % FRAMES_PER_VIDEO).cast("int").alias("frame_no"),
        F.expr(
            f"timestamp_millis(unix_millis(timestamp'{START} UTC') + {frame_millis} * (image_id % {FRAMES_PER_VIDEO}))"
        ).alias("ts"),
        "h", "w", "y", "x", "v",
    )


def clip_frames(spark: SparkSession, sf_dir: str, frame_millis: int = FRAME_MILLIS) -> DataFrame:
    """The videos in groups of four: clip k uses videos 4k..4k+3 as a, b, a' and mask source."""
    role = F.element_at(F.array(*[F.lit(r) for r in CLIP_ROLES]), (F.col("video_id") % 4 + 1).cast("int"))
    return frames(spark, sf_dir, frame_millis).select(
        F.expr("video_id div 4").alias("clip_id"), role.alias("role"), "frame_no", "ts", "h", "w", "y", "x", "v"
    )


def masks(clips: DataFrame) -> DataFrame:
    """0/1 masks from the mask role of the clips."""
    return clips.where("role = 'mask'").select(
        "clip_id", "frame_no", "ts", "y", "x",
        F.transform("v", lambda e: F.when(e > 128, 1).otherwise(0)).alias("m"),
    )


def pairs(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """(pair_id, a_img, aa_img, b_img, bb_img, prime_img, h, w, c) for single, double or analogy mode."""
    # Images per pair and the image each role takes.
    layout = {
        "single": (2, {"a_img": 0, "b_img": 1}),
        "double": (4, {"a_img": 0, "aa_img": 1, "b_img": 2, "bb_img": 3}),
        "analogy": (4, {"a_img": 0, "aa_img": 0, "b_img": 1, "bb_img": 1, "prime_img": 2}),
    }
    step, roles = layout[mode]
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ids = images.select(F.expr(f"vec_id div {step}").alias("pair_id")).distinct()
    columns = [
        (F.col("pair_id") * step + roles[c] if c in roles else F.lit(None).cast("long")).alias(c)
        for c in ("a_img", "aa_img", "b_img", "bb_img", "prime_img")
    ]
    return ids.select(
        "pair_id", *columns,
        F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), F.lit(1).alias("c"),
    )
