"""Patch descriptors."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nnfield.functions.coords import in_bounds
from nnfield.functions.windows import centred_offsets, reach
from nnfield.operators.blocks import BLOCK_EDGE, block_index, block_positions, blocks_of


def patches(pixels: DataFrame, keys: list[str], patch_size: int, edge: int = BLOCK_EDGE) -> DataFrame:
    """``(keys.., y, x, pv ARRAY<ARRAY>)``: the window around each pixel, NULL outside the image.

    Row-major over the offsets. ``pixels`` are pixel rows, which one shuffle packs, or image rows, of which
    those that fit a block are packed where they are; each patch is cut from its block.
    """
    r = reach(patch_size)
    blocks = blocks_of(pixels, keys, r, "clip", edge)
    at = block_positions(blocks, *keys, "h", "w", "y0", "x0", "stride", "c", "px")
    entries = []
    for dy in centred_offsets(patch_size):
        for dx in centred_offsets(patch_size):
            y, x = f"y + {dy}", f"x + {dx}"
            index = block_index(y, x, r)
            entries.append(f"if({in_bounds(y, x, 'h', 'w')}, slice(px, {index} + 1, c), null)")
    return at.selectExpr(*keys, "y", "x", f"array({', '.join(entries)}) as pv")
