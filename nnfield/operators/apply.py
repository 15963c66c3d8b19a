"""Using a field: gather, window averages, block copy, upsampling, colours."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from nnfield.functions.coords import clamp, visual_rgb
from nnfield.functions.windows import balanced_sum, centred_offsets, even_offsets
from nnfield.operators.blocks import (
    BLOCK_EDGE,
    block_index,
    image_blocks,
    lookup,
    meet_copies,
    met_tiles,
    pack_blocks,
)
from nnfield.operators.pairs import attach, bind_roles, used_images
from nnfield.session import cut_lineage


def pair_blocks(pairs: DataFrame, pixels: DataFrame, image_column: str, edge: int = BLOCK_EDGE) -> DataFrame:
    """Blocks of the image in one pair column, keyed ``pair_id``: few rows per image are shuffled."""
    role = {"image": image_column}
    return bind_roles(pairs, image_blocks(used_images(pairs, pixels, role), edge=edge), role).drop("role", "image_id")


def longest_side(sizes: DataFrame, h: str = "h", w: str = "w") -> int:
    return sizes.agg(F.max(F.greatest(h, w))).first()[0] or 0


def gather(field: DataFrame, blocks: DataFrame, edge: int = BLOCK_EDGE, pairs: DataFrame | None = None) -> DataFrame:
    """``(pair_id, h, w, y, x, v)``: the matched pixel of the image in ``blocks`` at every field pixel.

    Matches outside the image are clamped to its border. Where images may be larger than a block the field is
    checkpointed and its matches counted per block; ``pairs`` tells where none is.
    """
    rows = field.selectExpr(
        "pair_id", "h", "w", "ay as y", "ax as x", f"{clamp('by', 'h')} as by", f"{clamp('bx', 'w')} as bx"
    )
    largest = edge + 1 if pairs is None else longest_side(pairs)
    found = lookup(rows, blocks, ["pair_id"], "by", "bx", ["y", "x"], largest, edge)
    return found.select("pair_id", "h", "w", "y", "x", "v")


def window_average(
    gathered: DataFrame, patch_size: int, border: str = "clip", channels: int | None = None, edge: int = BLOCK_EDGE
) -> DataFrame:
    """Mean over the window around each pixel of a gathered image: ``(pair_id, y, x, v ARRAY<DOUBLE>)``.

    ``clip`` averages what lies inside and treats an even size as the next odd one; ``edge`` repeats
    the border pixels and ``reflect`` mirrors them, both over exactly ``patch_size`` squared values.
    One shuffle packs blocks whose halo already follows the border rule. Columns of the window are added up
    once per line and its sums then along the line, so work and code grow with the window's side, not its area.
    The number of channels is each image's own; ``channels``, if given, raises where an image has others.
    """
    offsets = centred_offsets(patch_size) if border == "clip" else even_offsets(patch_size)
    halo = patch_size // 2
    blocks = pack_blocks(gathered, ["pair_id"], halo=halo, border=border, edge=edge)
    lines = blocks.selectExpr("*", "explode(sequence(y0, y0 + bh - 1)) as y")
    down = balanced_sum([f"coalesce(get(px, (y - y0 + {halo + dy}) * stride * c + i), 0)" for dy in offsets])
    summed = lines.selectExpr("pair_id", "h", "w", "x0", "bw", "c", "y", f"transform(sequence(0, stride * c - 1), i -> {down}) as sums")
    at = summed.selectExpr("pair_id", "h", "w", "x0", "c", "y", "sums", "explode(sequence(x0, x0 + bw - 1)) as x")

    count = f"{patch_size * patch_size}"
    if border == "clip":
        inside = lambda p, size: f"(least({p}, {halo}) + least({size} - 1 - {p}, {halo}) + 1)"
        count = f"({inside('y', 'h')} * {inside('x', 'w')})"

    def mean(channel: str, width: str) -> str:
        across = balanced_sum([f"get(sums, (x - x0 + {halo + dx}) * {width} + {channel})" for dx in offsets])
        return f"cast({across} as double) / {count}"

    written = lambda width: "array(" + ", ".join(mean(str(k), str(width)) for k in range(width)) + ")"
    if channels is None:
        # grey and RGB images have compiled code of their own
        value = f"case c when 1 then {written(1)} when 3 then {written(3)} else transform(sequence(0, c - 1), k -> {mean('k', 'c')}) end"
    else:
        value = f"if(c = {channels}, {written(channels)}, raise_error(concat('image of ', c, ' channels, {channels} stated')))"
    return at.selectExpr("pair_id", "y", "x", f"{value} as v")


def _remainder(targets: DataFrame) -> DataFrame:
    """Pixels of an (oh, ow) grid outside its upper-left (ch, cw) corner: (pair_id, ic, y, x).

    ``targets(pair_id, ic, oh, ow, ch, cw)``. The rows below and the columns to the right are
    enumerated on their own, so the covered part is not generated. Image rows are spread over tasks
    before their pixels are made.
    """
    below = targets.where("ch < oh").selectExpr("*", "explode(sequence(ch, oh - 1)) as y", "0 as first")
    right = targets.where("cw < ow and ch > 0").selectExpr(
        "*", "explode(sequence(0, ch - 1)) as y", "cw as first"
    )
    lines = below.unionByName(right).repartition("pair_id", "y")
    return lines.selectExpr("pair_id", "ic", "y", "explode(sequence(first, ow - 1)) as x")


def image_sizes(blocks: DataFrame) -> DataFrame:
    """(pair_id, ih, iw, ic) read off the blocks."""
    return blocks.where("ty = 0 and tx = 0").selectExpr("pair_id", "h as ih", "w as iw", "c as ic")


def block_copy(field: DataFrame, pairs: DataFrame, blocks: DataFrame, sizes: DataFrame | None = None,
               edge: int = BLOCK_EDGE) -> DataFrame:
    """``(pair_id, y, x, v)``: copy the block of the match to the block of every field pixel.

    ``blocks`` holds the source image (keyed ``pair_id``), at any scale of the field:
    scale = image height div field height. Blocks cut off by the image border are copied only when
    source and target are cut alike; everything not copied is 0. ``sizes(pair_id, ih, iw, ic)``
    saves a pass over the blocks where the image sizes are known.
    """
    # read off the blocks once: the grid is counted before it is joined
    sizes = cut_lineage(image_sizes(blocks)) if sizes is None else sizes
    grid = pairs.selectExpr("pair_id", "h as fh", "w as fw").join(sizes, "pair_id").selectExpr(
        "*", "cast(ih div fh as int) as scale"
    )
    cut = lambda size, at: f"greatest(least({size} - {at} * scale, scale), 0)"
    cells = attach(field.select("pair_id", "ay", "ax", "by", "bx"), grid, ["pair_id"], ["ay", "ax"]).selectExpr(
        "*",
        f"{cut('ih', 'ay')} = {cut('ih', 'by')} and {cut('iw', 'ax')} = {cut('iw', 'bx')} as alike",
        f"{cut('ih', 'ay')} as th", f"{cut('iw', 'ax')} as tw",
    ).where("th > 0 and tw > 0")
    # A source block may lie over several tiles: it is cut at their borders, and what crosses the shuffle is
    # one row per part, not per pixel. Cells that are not copied are made of zeros without a lookup.
    part = lambda low, high: f"sequence(cast({low} div {edge} as int), cast(({high}) div {edge} as int))"
    parts = cells.where("alike").selectExpr(
        "pair_id", "ih as h", "iw as w", "ay", "ax", "scale", "by * scale as sy", "bx * scale as sx", "th", "tw"
    ).selectExpr("*", f"explode({part('sy', 'sy + th - 1')}) as ty").selectExpr("*", f"explode({part('sx', 'sx + tw - 1')}) as tx")
    wanted, hot = met_tiles(parts, ["pair_id"], longest_side(sizes, "ih", "iw"), edge)
    held = blocks.select("pair_id", "ty", "tx", "y0", "x0", "bh", "bw", "stride", "c", "px")
    inside = lambda at, size, from_, length: f"sequence(greatest({at}, {from_}), least({at} + {size}, {from_} + {length}) - 1)"
    met = meet_copies(wanted, held, ["pair_id"], hot, ["ay", "ax"])
    copied = met.selectExpr("*", f"explode({inside('sy', 'th', 'y0', 'bh')}) as gy").selectExpr(
        "*", f"explode({inside('sx', 'tw', 'x0', 'bw')}) as gx"
    ).selectExpr("pair_id", "ay * scale + gy - sy as y", "ax * scale + gx - sx as x", f"slice(px, {block_index('gy', 'gx', 0)} + 1, c) as v")
    empty = cells.where("not alike").selectExpr("*", "explode(sequence(0, th - 1)) as dy").selectExpr(
        "*", "explode(sequence(0, tw - 1)) as dx"
    ).selectExpr("pair_id", "ay * scale + dy as y", "ax * scale + dx as x", "array_repeat(0, ic) as v")
    copied = copied.unionByName(empty)
    uncovered = grid.selectExpr(
        "pair_id", "ic", "ih as oh", "iw as ow", "least(fh * scale, ih) as ch", "least(fw * scale, iw) as cw"
    )
    rest = _remainder(uncovered).selectExpr("pair_id", "y", "x", "array_repeat(0, ic) as v")
    return copied.unionByName(rest)


def upsample_field(field: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``(pair_id, ay, ax, by, bx)`` on a size x size grid: every entry repeated and multiplied.

    The ratio is size div field height on both axes; entries beyond the grid are cut, the rest of
    the grid is 0.
    """
    cells = field.selectExpr("pair_id", "ay", "ax", "by", "bx", f"cast({size} div h as int) as ratio")
    repeated = (
        cells.where("ratio > 0")
        .selectExpr("*", "explode(sequence(0, ratio - 1)) as dy")
        .selectExpr("*", "explode(sequence(0, ratio - 1)) as dx")
        .selectExpr(
            "pair_id", "ay * ratio + dy as ay", "ax * ratio + dx as ax", "by * ratio as by", "bx * ratio as bx"
        )
        .where(f"ay < {size} and ax < {size}")
    )
    ratio = f"cast({size} div h as int)"
    uncovered = pairs.selectExpr(
        "pair_id", "0 as ic", f"{size} as oh", f"{size} as ow", f"least(h * {ratio}, {size}) as ch",
        f"least(w * {ratio}, {size}) as cw",
    )
    rest = _remainder(uncovered).selectExpr("pair_id", "y as ay", "x as ax", "0 as by", "0 as bx")
    return repeated.unionByName(rest)


def visualize(field: DataFrame) -> DataFrame:
    """``(pair_id, y, x, r, g, b)``."""
    return field.selectExpr("pair_id", "ay as y", "ax as x", *visual_rgb("by", "bx", "h", "w"))
