"""Per-pixel value functions on channel arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalize(v: Column) -> Column:
    """0..255 to 0..1, single precision."""
    return F.transform(v, lambda e: (e / F.lit(255.0)).cast("float"))


def denormalize(v: Column) -> Column:
    """0..1 to 0..255 by truncation, in the precision of the input."""
    return F.transform(v, lambda e: F.floor(e * F.lit(255.0).cast("float")).cast("int"))


def swap_channels(v: Column) -> Column:
    """RGB to BGR and back."""
    return F.reverse(v)


def mask_blend(mask: Column, warped: Column, base: Column) -> Column:
    """mask * warped + (1 - mask) * base, per channel."""
    one = F.lit(1.0)
    kept = F.zip_with(mask, warped, lambda m, v: m.cast("double") * v.cast("double"))
    rest = F.zip_with(mask, base, lambda m, b: (one - m.cast("double")) * b.cast("double"))
    return F.zip_with(kept, rest, lambda k, r: k + r)
