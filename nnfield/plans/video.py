"""Video analogy in batch: match frame 0, see every frame through that field, blend by a mask."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from nnfield.operators.search import SearchOptions
from nnfield.operators.validate import clip_violations
from nnfield.session import cut_lineage
from nnfield.streaming.video import base_frame, blend_frames, clip_field, unmet_pixels, warp_frames


class Warped(NamedTuple):
    """``frames(clip_id, frame_no, ts, y, x, v ARRAY<DOUBLE>)``, the clips whose videos lack frames of each other (these
    have none), and with masks the pixels without a partner, per frame: ``unmet(clip_id, frame_no, ts, no_mask, no_frame)``."""

    frames: DataFrame
    violations: DataFrame
    unmet: DataFrame | None = None


def warp_video(clips: DataFrame, options: SearchOptions, rounds: int, masks: DataFrame | None = None, mode: str = "double") -> Warped:
    """All clips whose videos (and masks) have the same frames; ``mode`` as in ``frame_pairs``."""
    violations = cut_lineage(clip_violations(clips, masks))
    if not violations.isEmpty():
        clips = clips.join(violations, "clip_id", "left_anti")
        masks = masks if masks is None else masks.join(violations, "clip_id", "left_anti")
    field = cut_lineage(clip_field(clips, options, rounds, mode))
    warped = warp_frames(clips, field)
    if masks is None:
        return Warped(warped.withColumn("v", F.col("v").cast("array<double>")), violations)
    return Warped(blend_frames(warped, masks, base_frame(clips)), violations, unmet_pixels(warped, masks))
