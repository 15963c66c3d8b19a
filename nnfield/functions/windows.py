"""Patch windows and the patch distance, as SQL text."""

from __future__ import annotations

from math import lcm

MAX_PIXEL_SQUARE = 255 * 255
# Longs hold ``score * PRIORITY_SLOTS + priority``; doubles hold scores exactly below 2^53.
PRIORITY_SLOTS = 64
EXACT_DOUBLE = 2**53


def reach(patch_size: int) -> int:
    """Half width of a distance or clip-average window; an even size acts as the next odd one."""
    return patch_size // 2


def centred_offsets(patch_size: int) -> range:
    return range(-(patch_size // 2), patch_size // 2 + 1)


def even_offsets(patch_size: int) -> range:
    """Offsets of a window exactly ``patch_size`` wide: an even one leans to the low side."""
    return range(-(patch_size // 2), patch_size - patch_size // 2)




def score_scale(patch_size: int, channels: int, images: int = 2) -> int | None:
    """A common multiple of all window counts, so that distances become exact integers.

    None where the scaled distance would leave the range doubles represent exactly; callers
    then compare the quotients themselves.
    """
    r = reach(patch_size)
    one_axis = lcm(*range(1, 2 * r + 2))
    scale = one_axis * one_axis
    if MAX_PIXEL_SQUARE * channels * images * scale < EXACT_DOUBLE:
        return scale
    return None


def balanced_sum(terms: list[str]) -> str:
    """Sum as a shallow tree: a chain hundreds of terms deep is slow to analyse."""
    while len(terms) > 1:
        pairs = [terms[i : i + 2] for i in range(0, len(terms), 2)]
        terms = [f"({' + '.join(p)})" if len(p) == 2 else p[0] for p in pairs]
    return terms[0]


def scaled_score(total: str, count: str, scale: int | None) -> str:
    """Comparable distance of DOUBLE sums: an exact BIGINT where a scale exists, else the quotient."""
    if scale is None:
        return f"({total} / {count})"
    return f"cast({total} * ({scale}D / {count}) as bigint)"


def distance_of(score: str, scale: int | None) -> str:
    return score if scale is None else f"(cast({score} as double) / {scale}D)"
