"""Bilinear resize."""

from __future__ import annotations

from pyspark.sql import DataFrame

from nnfield.operators.blocks import BLOCK_EDGE, block_index, blocks_of


def _source(target: str, size: str, target_size: int) -> str:
    """Source coordinate of a target pixel centre, clamped to the image."""
    raw = f"({target} + 0.5D) * (cast({size} as double) / {float(target_size)}D) - 0.5D"
    return f"greatest(least({raw}, cast({size} - 1 as double)), 0D)"


def _targets(start: str, length: str, size: str, target_size: int) -> str:
    """Target coordinates whose source pixel lies in [start, start + length).

    The range is bounded from the inverse map with a margin, then filtered.
    """
    ratio = f"({float(target_size)}D / {size})"
    first = f"if({start} = 0, 0, greatest(floor(({start} + 0.5D) * {ratio} - 0.5D) - 1, 0))"
    final = f"least(ceil(({start} + {length} + 0.5D) * {ratio} - 0.5D) + 1, {target_size - 1})"
    final = f"if({start} + {length} = {size}, {target_size - 1}, {final})"
    at = f"floor({_source('o', size, target_size)})"
    every = f"sequence(cast({first} as int), cast({final} as int))"
    return f"filter({every}, o -> {at} >= {start} and {at} < {start} + {length})"


def resize_bilinear(
    pixels: DataFrame, keys: list[str], height: int, width: int, edge: int = BLOCK_EDGE
) -> DataFrame:
    """``(keys.., y, x, v ARRAY<DOUBLE>)`` on a height x width grid.

    Every target pixel is made by the block that holds its upper-left source neighbour; a halo of
    one gives the other three, so packing pixel rows is the only shuffle, and image rows that fit a
    block need none: what lies beyond the image has weight 0.
    """
    blocks = blocks_of(pixels, keys, 1, "edge", edge)
    made = (
        blocks.selectExpr("*", f"explode({_targets('y0', 'bh', 'h', height)}) as y")
        .selectExpr("*", f"explode({_targets('x0', 'bw', 'w', width)}) as x")
        .selectExpr("*", f"{_source('y', 'h', height)} as sy", f"{_source('x', 'w', width)} as sx")
        .selectExpr("*", "cast(floor(sy) as int) as iy", "cast(floor(sx) as int) as ix")
        .selectExpr("*", "sy - iy as fy", "sx - ix as fx")
    )

    def corner(dy: int, dx: int) -> str:
        # beyond the last row or column the weight is 0 and the halo repeats the edge
        return f"slice(px, {block_index(f'iy + {dy}', f'ix + {dx}', 1)} + 1, c)"

    def mixed(left: str, right: str, weight: str) -> str:
        return f"zip_with({left}, {right}, (p, q) -> (1D - {weight}) * p + {weight} * q)"

    upper = mixed(corner(0, 0), corner(0, 1), "fx")
    lower = mixed(corner(1, 0), corner(1, 1), "fx")
    return made.selectExpr(*keys, "y", "x", f"{mixed(upper, lower, 'fy')} as v")
