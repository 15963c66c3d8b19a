"""Coordinate arithmetic as SQL text: bounds, clamping, radii, borders."""

from __future__ import annotations

def in_bounds(y: str, x: str, h: str, w: str) -> str:
    return f"({y} between 0 and {h} - 1 and {x} between 0 and {w} - 1)"


def clamp(value: str, size: str) -> str:
    """Nearest coordinate inside [0, size)."""
    return f"greatest(least({value}, {size} - 1), 0)"


def clamp_radius(radius: str, h: str, w: str) -> str:
    """Search radius, at most the longer image side; NULL means the longer side."""
    return f"least(coalesce({radius}, greatest({h}, {w})), greatest({h}, {w}))"



def radius_schedule(radius: str) -> str:
    """ARRAY of radius, radius/2, .., 1 (integer halving)."""
    halved = f"transform(sequence(0, length(bin(greatest({radius}, 1))) - 1), k -> shiftright({radius}, k))"
    return f"filter({halved}, r -> r >= 1)"


def visual_rgb(by: str, bx: str, h: str, w: str) -> list[str]:
    """Field colours r, g, b: red grows with x, blue with y."""
    return [
        f"cast(floor(255 * ({bx} / {w})) as int) as r",
        "0 as g",
        f"cast(floor(255 * ({by} / {h})) as int) as b",
    ]


def mirrored(position: str, size: str) -> str:
    """Source of a position beyond the edge when the border reflects without repeating the edge."""
    period = f"greatest(2 * ({size} - 1), 1)"
    return f"if({size} = 1, 0, least(pmod({position}, {period}), {period} - pmod({position}, {period})))"


def images_of(position: str, size: str, reach: int, border: str) -> str:
    """ARRAY of the positions in [-reach, size + reach) whose value is the one at ``position``.

    ``clip``: positions beyond the edge appear once, under the edge pixel, to hold an absent value.
    """
    if reach == 0:
        return f"array({position})"
    # only positions beyond the edges are tried: the work doesn't grow with the image
    if border in ("edge", "clip"):
        first, last = f"if({position} = 0, -{reach}, {position})", f"if({position} = {size} - 1, {size} + {reach - 1}, {position})"
        return f"if({position} >= 0 and {position} < {size}, sequence({first}, {last}), array())"
    if border == "reflect":
        tried = f"concat(sequence(-{reach}, -1), array({position}), sequence({size}, {size} + {reach - 1}))"
        return f"filter({tried}, p -> {mirrored('p', size)} = {position})"
    raise ValueError(f"border must be clip, edge or reflect, not {border!r}")
