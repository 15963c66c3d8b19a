"""Binding images to the roles of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Role name to pair column.
ROLE_COLUMNS = {"a": "a_img", "aa": "aa_img", "b": "b_img", "bb": "bb_img"}
# Uses of one image beyond which its copies are spread before they multiply.
USES_PER_KEY = 64
USE_SALTS = 256
# A side is broadcast only up to this many rows (descriptor and field rows are about 40 bytes).
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 * 1024 * 1024
ATTACH_SALTS = 16


def attach(rows: DataFrame, static: DataFrame, keys: list[str], spread: list[str],
           broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``rows`` (stream or batch) to a smaller static table on ``keys``.

    The static side's rows and array elements are counted; it is broadcast below ``broadcast_rows`` and
    BROADCAST_BYTES. Beyond, it is copied under salts and the rows are spread by ``spread``, so that a key
    which holds most rows is met in many tasks.
    """
    arrays = [F.coalesce(F.size(c), F.lit(0)) for c, kind in static.dtypes if kind.startswith("array")]
    width = F.lit(8 * len(static.columns)) + sum((8 * a for a in arrays), F.lit(0))
    held = static.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("long")).alias("bytes")).first()
    if held.n <= broadcast_rows and (held.bytes or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(static), keys)
    salted = static.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(ATTACH_SALTS - 1))))
    numbered = rows.withColumn("salt", F.pmod(F.xxhash64(*spread), F.lit(ATTACH_SALTS)).cast("int"))
    return numbered.join(salted, [*keys, "salt"]).drop("salt")


def pair_roles(pairs: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """(pair_id, role, image_id), one row per image a pair uses."""
    roles = roles or ROLE_COLUMNS
    entries = ", ".join(f"'{name}', {column}" for name, column in roles.items())
    return pairs.select("pair_id", F.expr(f"stack({len(roles)}, {entries}) as (role, image_id)")).where(
        "image_id is not null"
    )


def used_images(pairs: DataFrame, images: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """The rows of ``images`` that ``bind_roles`` may join, so that others aren't packed first. All of them where the images
    that pairs use are too many to be broadcast."""
    ids = pair_roles(pairs, roles).select("image_id").distinct()
    if ids.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return images
    return images.join(F.broadcast(ids), "image_id", "left_semi")


def bind_roles(pairs: DataFrame, images: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Join image rows (pixels or blocks, keyed ``image_id``) to every pair and role that uses them.

    An image that very many pairs share would make one task write all its copies. The largest
    number of uses is counted on the descriptors first; beyond a bound the copies are made in two
    steps, first one per (image, salt), then per pair.
    """
    uses = pair_roles(pairs, roles)
    most = uses.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0
    if most <= USES_PER_KEY:
        return uses.join(images, "image_id")
    salted = uses.withColumn("use", F.pmod(F.xxhash64("pair_id", "role"), F.lit(USE_SALTS)))
    copies = images.join(salted.select("image_id", "use").distinct(), "image_id")
    return salted.join(copies, ["image_id", "use"]).drop("use")
