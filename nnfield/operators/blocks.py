"""Square blocks of an image packed into arrays, with a halo.

A block row holds the pixels of one tile plus ``halo`` pixels around it, so a patch, a window
mean or a bilinear sample around any pixel of the tile needs no second row: the shuffle that
packs the pixels is the only one. Its size is bounded by the tile edge whatever the image size,
and an image of any size spreads over as many rows as it has tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nnfield.functions.coords import images_of, in_bounds
from nnfield.session import cut_lineage
from nnfield.sources.images import explode_pixels

BLOCK_EDGE = 64
# Tiles that have copies: at most that many, so that their table can be broadcast.
HOT_TILES = 10_000


def _placements(position: str, size: str, edge: int, halo: int, border: str) -> str:
    """ARRAY of (at, tile): where one source coordinate appears, halos and borders included.

    Only pixels near a tile border take the general way; the filter over the whole axis is left
    to pixels within reach of the image border.
    """
    first = f"cast(greatest(at - {halo}, 0) div {edge} as int)"
    last = f"least(cast((at + {halo}) div {edge} as int), cast(({size} - 1) div {edge} as int))"
    tiles = f"sequence(least({first}, {last}), {last})"
    in_tiles = f"transform({tiles}, t -> struct(at, t as tile))"
    spread = f"flatten(transform({{0}}, at -> {in_tiles}))"
    near_border = f"({position} < {2 * halo} or {position} >= {size} - {2 * halo})"
    near_tile = f"({position} % {edge} < {halo} or {position} % {edge} >= {edge} - {halo})"
    alone = f"array(struct({position} as at, cast({position} div {edge} as int) as tile))"
    return (
        f"case when {near_border} then {spread.format(images_of(position, size, halo, border))}"
        f" when {near_tile} then {spread.format(f'array({position})')} else {alone} end"
    )


def block_geometry(edge: int, halo: int) -> list[str]:
    """y0, x0, bh, bw, stride of a block from its tile and the image size."""
    return [
        f"ty * {edge} as y0",
        f"tx * {edge} as x0",
        f"least({edge}, h - ty * {edge}) as bh",
        f"least({edge}, w - tx * {edge}) as bw",
        f"least({edge}, w - tx * {edge}) + {2 * halo} as stride",
    ]


def pack_blocks(
    pixels: DataFrame,
    keys: list[str],
    halo: int = 0,
    border: str = "clip",
    edge: int = BLOCK_EDGE,
) -> DataFrame:
    """Pack ``pixels(keys.., h, w, y, x, v ARRAY)`` into ``(keys.., h, w, ty, tx, y0, x0, bh, bw, stride, c, px)``.

    ``px`` is row-major and channel-interleaved over the tile and its halo. Beyond the image it
    holds NULL (``clip``), the edge pixel (``edge``) or the mirrored one (``reflect``).
    """
    if halo:
        placed = (
            pixels.selectExpr(*keys, "h", "w", "x", "v", f"explode({_placements('y', 'h', edge, halo, border)}) as py")
            .selectExpr(*keys, "h", "w", "v", "py", f"explode({_placements('x', 'w', edge, halo, border)}) as px")
            .selectExpr(
                *keys, "h", "w", "py.tile as ty", "px.tile as tx", "py.at as vy", "px.at as vx", "v"
            )
        )
    else:  # one tile a pixel
        tile = lambda at, size: f"if({at} is null, null, least(cast({at} div {edge} as int), cast(({size} - 1) div {edge} as int)))"
        placed = pixels.selectExpr(
            *keys, "h", "w", f"{tile('y', 'h')} as ty", f"{tile('x', 'w')} as tx", "y as vy", "x as vx", "v"
        )
    if border == "clip" and halo:
        absent = "transform(v, e -> if(false, e, null))"
        placed = placed.selectExpr(
            *keys, "h", "w", "ty", "tx", "vy", "vx",
            f"if({in_bounds('vy', 'vx', 'h', 'w')}, v, {absent}) as v",
        )
    # One shuffle by tile, then lines and tiles are put together where they are: a line is small, and
    # a tile holds its lines as plain arrays, so the lists in memory stay short.
    tile = [*keys, "h", "w", "ty", "tx"]
    lines = (
        placed.repartition(*keys, "ty", "tx")
        .groupBy(*tile, "vy")
        .agg(F.expr("array_sort(collect_list(struct(vx, v))) as cells"))
        .selectExpr(*tile, "size(cells[0].v) as c", "struct(vy, flatten(cells.v) as line) as line")
    )
    return (
        lines.groupBy(*tile)
        .agg(F.expr("max(c) as c"), F.expr("array_sort(collect_list(line)) as lines"))
        .selectExpr(*tile, *block_geometry(edge, halo), "c", "flatten(lines.line) as px")
    )


def pack_image_rows(images: DataFrame, halo: int = 0, edge: int = BLOCK_EDGE) -> DataFrame:
    """Blocks of images that come as one row each and fit one block; no shuffle.

    ``images(image_id, height, width, channels, data ARRAY)``. The halo holds arbitrary values: for
    readers that never use what lies outside the image.
    """
    side = "array_repeat(data[0], {})"
    line = f"concat({side.format(f'{halo} * c')}, slice(data, y * w * c + 1, w * c), {side.format(f'{halo} * c')})"
    rim = side.format(f"{halo} * (w + {2 * halo}) * c")
    px = f"concat({rim}, flatten(transform(sequence(0, h - 1), y -> {line})), {rim})" if halo else "data"
    return images.selectExpr(
        "image_id", "height as h", "width as w", "0 as ty", "0 as tx", "channels as c", "data"
    ).selectExpr("image_id", "h", "w", "ty", "tx", *block_geometry(edge, halo), "c", f"{px} as px")


def image_blocks(images: DataFrame, halo: int = 0, edge: int = BLOCK_EDGE) -> DataFrame:
    """Blocks keyed ``image_id`` of pixel rows, or of image rows (``data`` holds the whole image).

    Image rows that fit one block are packed where they are; larger ones are taken apart first.
    """
    if "data" not in images.columns:
        return pack_blocks(images, ["image_id"], halo, "clip", edge)
    fits = f"greatest(height, width) <= {edge}"
    taken_apart = pack_blocks(explode_pixels(images.where(f"not ({fits})")), ["image_id"], halo, "clip", edge)
    return pack_image_rows(images.where(fits), halo, edge).unionByName(taken_apart)


def blocks_of(images: DataFrame, keys: list[str], halo: int, border: str, edge: int = BLOCK_EDGE) -> DataFrame:
    """Blocks of pixel rows under a border rule, or of image rows keyed ``image_id`` for readers that don't
    depend on what lies outside the image."""
    if "data" not in images.columns:
        return pack_blocks(images, keys, halo, border, edge)
    fits = f"greatest(height, width) <= {edge}"
    apart = pack_blocks(explode_pixels(images.where(f"not ({fits})"), keys), keys, halo, border, edge)
    return pack_image_rows(images.where(fits), halo, edge).unionByName(apart)


def block_index(y: str, x: str, halo: int, channels: str = "c") -> str:
    """Position of channel 0 of pixel (y, x) in the ``px`` array of the block in scope."""
    return f"((({y}) - y0 + {halo}) * stride + (({x}) - x0 + {halo})) * {channels}"


def block_positions(blocks: DataFrame, *keep: str) -> DataFrame:
    """One row per pixel of each block; narrow, the block stays where it is."""
    return blocks.selectExpr("*", "explode(sequence(0, bh * bw - 1)) as p").selectExpr(
        *keep, "y0 + cast(p div bw as int) as y", "x0 + p % bw as x"
    )


def hot_tiles(times: DataFrame, keys: list[str], tasks: int, edge: int = BLOCK_EDGE, around: bool = False) -> DataFrame | None:
    """``(keys.., ty, tx, copies)`` of the tiles that need copies, None if none does.

    ``times(keys.., ty, tx, times)`` says how many lookups meet each tile. One copy answers a quarter of a task's
    share of all lookups, but never more than twice the pixels of a tile nor, as all tiles together have no more than
    all lookups, so few that over HOT_TILES tiles had copies. Tiles met less than that have one copy and aren't listed.
    ``around`` lets the four tiles beside a listed one have as many copies.
    """
    times = cut_lineage(times)  # a row a tile, read twice
    total = times.agg(F.sum("times")).first()[0] or 0
    answered = max(min(-(-total // (4 * tasks)), 2 * edge * edge), -(-total // HOT_TILES), 1)
    hot = times.where(F.col("times") > answered)
    if around:
        beside = "array(" + ", ".join(f"struct({dy} as dy, {dx} as dx)" for dy, dx in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))) + ")"
        hot = hot.selectExpr(*keys, "ty", "tx", "times", f"inline({beside})").selectExpr(*keys, "ty + dy as ty", "tx + dx as tx", "times")
        hot = hot.groupBy(*keys, "ty", "tx").agg(F.max("times").alias("times"))
    hot = cut_lineage(hot.selectExpr(*keys, "ty", "tx", f"cast(ceil(times / {answered}) as int) as copies"))
    return None if hot.isEmpty() else hot


def copied_blocks(blocks: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """Blocks under ``salt`` 0 to copies - 1; those that aren't hot once, under 0."""
    met = blocks.join(F.broadcast(hot), [*keys, "ty", "tx"], "left")
    return met.selectExpr(*blocks.columns, "explode(sequence(0, coalesce(copies, 1) - 1)) as salt")


def copy_of(pixel: list[str]) -> str:
    """Which copy a lookup row uses, from the ``copies`` of its tile (NULL: one)."""
    return f"cast(pmod(xxhash64({', '.join(pixel)}), coalesce(copies, 1)) as int)"


def met_tiles(rows: DataFrame, keys: list[str], largest: int, edge: int = BLOCK_EDGE) -> tuple[DataFrame, DataFrame | None]:
    """Lookup rows ``(keys.., h, w, ty, tx, ..)`` and the tiles that need copies for them.

    The rows are counted per tile, for which they are checkpointed first, unless no image is larger than a tile
    (``largest``: the longest side): its one block is met wherever the rows of its image are.
    """
    if largest <= edge:
        return rows, None
    rows = cut_lineage(rows)
    times = rows.where(f"h > {edge} or w > {edge}").groupBy(*keys, "ty", "tx").agg(F.count(F.lit(1)).alias("times"))
    return rows, hot_tiles(times, keys, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), edge)


def meet_copies(rows: DataFrame, blocks: DataFrame, keys: list[str], hot: DataFrame | None, spread_by: list[str]) -> DataFrame:
    """Rows next to a copy of their block: an equi-join on image, tile and copy."""
    if hot is None:
        return rows.join(blocks, [*keys, "ty", "tx"])
    numbered = rows.join(F.broadcast(hot), [*keys, "ty", "tx"], "left").withColumn("salt", F.expr(copy_of(spread_by)))
    return numbered.drop("copies").join(copied_blocks(blocks, keys, hot), [*keys, "ty", "tx", "salt"])


def lookup(
    rows: DataFrame,
    blocks: DataFrame,
    keys: list[str],
    y: str,
    x: str,
    spread_by: list[str],
    largest: int,
    edge: int = BLOCK_EDGE,
) -> DataFrame:
    """Attach ``v``, the pixel at (y, x) of the image ``keys``, to rows that carry ``h`` and ``w``.

    ``blocks`` is packed without a halo; ``largest`` is the longest side of any image.
    """
    wanted = rows.selectExpr(
        "*", f"{y} as gy", f"{x} as gx",
        f"cast(({y}) div {edge} as int) as ty", f"cast(({x}) div {edge} as int) as tx",
    )
    wanted, hot = met_tiles(wanted, keys, largest, edge)
    held = blocks.select(*keys, "ty", "tx", "y0", "x0", "stride", "c", "px")
    found = meet_copies(wanted, held, keys, hot, spread_by)
    return found.selectExpr(*rows.columns, f"slice(px, {block_index('gy', 'gx', 0)} + 1, c) as v")
