"""The field search: random start, propagation, random search, best candidate.

A field row is one pixel of image A with its current match in image B. A round reads only the
field of the round before, so it is one pass over the rows: every pixel emits its own match, the
match of its neighbours moved along, and random draws around its match; each candidate is scored
against the packed images; the smallest wins.

Two layouts give the same field:

* ``whole``: both images of the pair fit one block. Field and images are partitioned by
  ``pair_id`` once, and all rounds up to the next checkpoint run in that partitioning with no
  further shuffle.
* ``tiled``: larger images, as blocks, so that one huge image spreads over the cluster. The field stays
  partitioned by pair and tile of A over all rounds, and each tile holds, beside its own pixels, those
  from which the moves of the next round reach into it. So a round cuts the patches of A where the
  field is, sends the candidates to the tiles of B once, and sends back the best of each pixel and tile of B.
  A tile of B that attracts many matches is copied as often as a count of the field asks for.
  Where the images of each pair stay below ``COPIED_BYTES``, tiles are larger, at most ``COPIES`` of them, and each tile of A
  has a copy of all tiles of B beside it: draws go all over B, so that sending them with their patches takes far
  more bytes than the copies. Then a round shuffles the field alone, packed, and numpy tries the candidates of a tile
  together (``resident``).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from nnfield.functions.coords import clamp_radius, in_bounds, radius_schedule
from nnfield.functions.draws import SALT_X, SALT_Y, key_of, pick_between, with_draws
from nnfield.functions.windows import (
    PRIORITY_SLOTS,
    balanced_sum,
    distance_of,
    reach,
    scaled_score,
    score_scale,
)
from nnfield.functions.text import subquery
from nnfield.operators import resident
from nnfield.operators.blocks import block_positions, copied_blocks, copy_of, hot_tiles, image_blocks
from nnfield.operators.pairs import attach, bind_roles, used_images
from nnfield.operators.validate import pair_violations
from nnfield.session import cut_lineage, partitions_for
from nnfield.sources.images import byte_values, explode_pixels

WHOLE_EDGE = 256
TILE_EDGE = 64
FIRST_RANDOM = 5
JUMPS = (8, 4, 2, 1)
# Fixed values: (pri, uy, ux) of the moves.
STEPS = {"jump": [(1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1)], "scan": [(1, 0, 1), (2, 1, 0)]}
FIELD_COLUMNS = ["pair_id", "h", "w", "ay", "ax", "by", "bx", "d", "round"]
_STATE = ["pair_id", "h", "w", "ay", "ax", "by", "bx", "score", "round"]
_PLACE = ["pair_id", "h", "w", "ay", "ax", "by", "bx"]
_CANDIDATE = ["pair_id", "h", "w", "ay", "ax", "by", "bx", "pri"]
_CODE_BASE = 2**31
_A_TILE = ["pair_id", "aty", "atx"]
# Candidates and their patches that meet a byte of an image: what the partitions of tiles are sized by.
TILE_BYTES = 16
# Packed bytes of an image up to which it is copied, and the copies of it (or the number of pairs, if there are more).
COPIED_BYTES = 256 * 1024 * 1024
COPIES = 64


@dataclass(frozen=True)
class SearchOptions:
    """Parameters of a search. ``random`` is closed or half_open, ``propagation`` jump or scan. Tiled images are copied
    if the largest has ``copy_pixels``; ``tile_edge`` is then the least edge of a tile."""

    patch_size: int = 3
    channels: int = 1
    radius: int | None = None
    propagation: str = "jump"
    random: str = "closed"
    jumps: tuple[int, ...] = JUMPS
    whole_edge: int = WHOLE_EDGE
    tile_edge: int = TILE_EDGE
    rounds_per_checkpoint: int = 4
    copy_pixels: int = 4096

    @property
    def halo(self) -> int:
        return reach(self.patch_size)

    @property
    def scale(self) -> int | None:
        return score_scale(self.patch_size, self.channels)

    def rounds(self, iterations: int) -> int:
        return iterations * (len(self.jumps) if self.propagation == "jump" else 1)


@dataclass(frozen=True)
class BoundPairs:
    """Pairs with their images packed: ``whole`` and ``tiled`` are None where no pair needs them.

    ``violations(pair_id, reason)`` are the pairs that can't be searched and have no rows in any field.
    ``copied``: all tiles of B stand beside each tile of A; tiles have ``tile_edge`` and their pixels are BINARY.
    """

    whole: DataFrame | None
    tiled_a: DataFrame | None
    tiled_b: DataFrame | None
    partitions: int
    tile_partitions: int
    features: tuple[str, ...]
    violations: DataFrame
    tile_edge: int
    copied: bool

    @property
    def weights(self) -> list[str]:
        return [f"w_{f}" for f in self.features]

    @property
    def arrays(self) -> list[str]:
        return [f"{p}_{f}" for p in ("pa", "pb") for f in self.features]


def _edges(options: SearchOptions) -> list[int]:
    """Edges a tile may have."""
    return [options.tile_edge << k for k in range(31) if options.tile_edge << k < 2**30]


def _bytes(images: DataFrame) -> DataFrame:
    """0..255 shifted to a signed byte: differences stay the same, arrays shrink to a quarter."""
    values = "data" if "data" in images.columns else "v"
    if dict(images.dtypes)[values] == "binary":
        images = images.withColumn(values, F.expr(byte_values(values)))
    kept = [c for c in images.columns if c != values]
    return images.selectExpr(*kept, f"transform({values}, e -> cast(e - 128 as tinyint)) as {values}")


def _weighted(pairs: DataFrame) -> DataFrame:
    """Weights of the two comparisons. AA = A and BB = B doubles the first instead of adding a second."""
    same = "coalesce(aa_img = a_img and bb_img = b_img, false)"
    return pairs.selectExpr(
        "pair_id", "a_img", "b_img", "h", "w", "c",
        f"if({same}, null, aa_img) as aa_img", f"if({same}, null, bb_img) as bb_img",
        f"if({same}, 2, 1) as w_main", f"if({same} or aa_img is null, 0, 1) as w_aux",
    )


def _present(columns: dict[str, str], absent: str = "array(0Y)") -> list[str]:
    """Columns that are never NULL, declared so: generated code then carries no null checks."""
    return [
        f"coalesce({source}, {absent}) as {name}" if name[:2] in ("p_", "pa", "pb") else f"coalesce({source}, 0) as {name}"
        for name, source in columns.items()
    ]


def _role_arrays(names: dict[str, str | int], features: tuple[str, ...], packed: bool = False) -> dict[str, str]:
    """Array column per role (``packed``: BINARY); a pair without a second image repeats the first with weight 0."""
    held = {n: f"get(filter(images, e -> e.role = {role}), 0).px" for n, role in names.items()}
    out = {}
    for name, source in held.items():
        prefix, feature = name.split("_")
        if feature in features:
            value = source if feature == "main" else f"coalesce({source}, {held[prefix + '_main']})"
            out[name] = value if packed else f"transform({value}, e -> coalesce(e, 0Y))"
    return out


def bind_pairs(pairs: DataFrame, pixels: DataFrame, options: SearchOptions) -> BoundPairs:
    """Pack the images of all pairs and cut the lineage, so that every round reads them ready-made.

    ``pixels`` are pixel rows (image_id, h, w, y, x, v) or image rows (image_id, height, width,
    channels, data). Pairs whose images are missing, incomplete, of other shapes than stated or unlike each
    other, or that have other channels than the options, are left out and listed in ``violations``. Where no pair
    at all has the channels of the options, that is an error.
    """
    spark = pairs.sparkSession
    counts = pairs.agg(F.collect_set("c")).first()[0]
    if counts and options.channels not in counts:
        raise ValueError(f"pairs have {sorted(counts)} channels, the options say {options.channels}")
    violations = cut_lineage(pair_violations(pairs, pixels, options.channels))
    if not violations.isEmpty():
        pairs = pairs.join(violations, "pair_id", "left_anti")
    pairs = _weighted(pairs)
    large = f"greatest(h, w) > {options.whole_edge}"
    facts = pairs.selectExpr(
        f"max({large}) as any_large", f"min({large}) as all_large", "max(w_aux) as aux",
        "sum(cast(h as bigint) * w * c) as total",
        f"max(if({large}, cast(h as bigint) * w, 0)) as largest", f"count_if({large}) as pairs",
        *[f"sum(if({large}, ceil(h / {e}) * ceil(w / {e}), 0)) as tiles_{e}" for e in _edges(options)],
    ).first()
    features = ("main", "aux") if facts["aux"] else ("main",)
    partitions = partitions_for(spark, (facts["total"] or 0) * 2 * len(features))
    tile_partitions = partitions_for(spark, (facts["total"] or 0) * len(features) * TILE_BYTES)
    tile_edge, packed = options.tile_edge, (facts["largest"] or 0) * options.channels * len(features)
    fit = [e for e in _edges(options) if (facts[f"tiles_{e}"] or 0) <= max(COPIES, facts["pairs"])]
    copied = bool(fit) and (facts["largest"] or 0) >= options.copy_pixels and packed <= COPIED_BYTES
    if copied:
        tile_edge = fit[0]
        tile_partitions = partitions_for(spark, packed * facts[f"tiles_{tile_edge}"])
    images = _bytes(pixels)
    image_large = large if "h" in pixels.columns else large.replace("h, w", "height, width")
    weights = ["w_main", *(["w_aux"] if facts["aux"] else [])]

    whole = tiled_a = tiled_b = None
    if not facts["all_large"]:  # also without any pair
        small = pairs.where(f"not ({large})")
        blocks = image_blocks(images.where(f"not ({image_large})"), options.halo, options.whole_edge)
        held = bind_roles(small, blocks.select("image_id", "stride", "px")).groupBy("pair_id").agg(
            F.expr("max(stride) as stride"), F.expr("collect_list(struct(role, px)) as images")
        )
        names = {"pa_main": "'a'", "pb_main": "'b'", "pa_aux": "'aa'", "pb_aux": "'bb'"}
        numbers = {n: n for n in ("stride", "h", "w", *weights)}
        whole = held.join(small.select("pair_id", "h", "w", *weights), "pair_id").selectExpr(
            "pair_id", *_present({**numbers, **_role_arrays(names, features)})
        )
        whole = whole.selectExpr("*", f"{_tries(options)} as tries", "0 as round")
        whole = cut_lineage(whole.repartition(partitions, "pair_id"))
    if facts["any_large"]:
        big = pairs.where(large)
        if copied:
            rows = used_images(big, pixels.where(image_large))
            rows = explode_pixels(rows) if "data" in rows.columns else rows
            blocks = resident.packed_tiles(rows, options.halo, tile_edge, options.channels)
        else:
            blocks = image_blocks(images.where(image_large), options.halo, tile_edge)
        tile = ["h", "w", "ty", "tx", "y0", "x0", "bh", "bw", "stride"]
        rows = bind_roles(big, blocks).selectExpr(
            "pair_id", "left(role, 1) as side", *tile, "struct(length(role) as role, px) as image"
        ).groupBy("pair_id", "side", *tile).agg(F.expr("collect_list(image) as images"))
        arrays = _role_arrays({"p_main": 1, "p_aux": 2}, features, packed=copied)
        numbers = {**{n: n for n in (*tile, *weights)}, "round": "0"}
        # both sides in one table: the pixels are read and packed once
        tiled = cut_lineage(
            attach(rows, big.select("pair_id", *weights), ["pair_id"], ["ty", "tx"]).selectExpr(
                "pair_id", "side", *_present({**numbers, **arrays}, "X''" if copied else "array(0Y)")
            )
        )
        kept = ["pair_id", *numbers]
        tiled_a = tiled.where("side = 'a'").selectExpr(*kept, *[f"p_{f} as pa_{f}" for f in features])
        tiled_b = tiled.where("side = 'b'").selectExpr(*kept, *[f"p_{f} as pb_{f}" for f in features])
    return BoundPairs(whole, tiled_a, tiled_b, partitions, tile_partitions, features, violations, tile_edge, copied)


# ---------------------------------------------------------------- scoring


def _row_bases(name: str, y: str, x: str, y0: str, x0: str, options: SearchOptions) -> list[str]:
    """Array index of the leftmost window value, one column per window row."""
    r, c = options.halo, options.channels
    return [
        f"(({y} - {y0} + {row}) * stride + ({x} - {x0})) * {c} as {name}{row}" for row in range(2 * r + 1)
    ]


def _row_flags(options: SearchOptions) -> list[str]:
    """1 where a window row (column) lies inside both images, else 0."""
    r = options.halo
    out = []
    for axis, size in (("y", "h"), ("x", "w")):
        for k in range(2 * r + 1):
            low, high = f"least(a{axis}, b{axis}) >= {r - k}", f"greatest(a{axis}, b{axis}) < {size} + {r - k}"
            out.append(f"if({low} and {high}, 1D, 0D) as f{axis}{k}")
    return out


def _fresh_score(bound: BoundPairs, options: SearchOptions, patch_in_hand: bool) -> str:
    """Comparable distance over the part of the window inside both images.

    Sums run in DOUBLE, where whole numbers are exact and no overflow check is generated: written
    out for every value of the window, the code must stay short enough for the JVM to compile.
    """
    r, c = options.halo, options.channels
    width = 2 * r + 1
    totals = []
    for feature in bound.features:
        rows = []
        for row in range(width):
            columns = []
            for k in range(width):
                squares = []
                for ch in range(k * c, (k + 1) * c):
                    at_a = f"{row * width * c + ch}" if patch_in_hand else f"ia{row} + {ch}"
                    left, right = f"pa_{feature}[{at_a}]", f"pb_{feature}[ib{row} + {ch}]"
                    difference = f"(cast({left} as double) - cast({right} as double))"
                    squares.append(f"{difference} * {difference}")
                columns.append(f"fx{k} * ({balanced_sum(squares)})")
            rows.append(f"fy{row} * ({balanced_sum(columns)})")
        totals.append(f"w_{feature} * ({balanced_sum(rows)})")
    rows, columns = (" + ".join(f"{f}{k}" for k in range(width)) for f in ("fy", "fx"))
    return scaled_score(balanced_sum(totals), f"(({rows}) * ({columns}))", options.scale)


def _scored_whole(source: str, bound: BoundPairs, options: SearchOptions, keep: list[str]) -> str:
    """Window flags, array positions and packed images next to every candidate."""
    return subquery(
        [
            *dict.fromkeys([*keep, *_PLACE, *bound.weights]), *bound.arrays, *_row_flags(options),
            *_row_bases("ia", "ay", "ax", "0", "0", options), *_row_bases("ib", "by", "bx", "0", "0", options),
        ],
        source,
    )


def _b_tile(hot: bool) -> list[str]:
    """Key of a tile of B, with the number of the copy where tiles have any."""
    return ["pair_id", "bty", "btx", *(["salt"] if hot else [])]


def _in_tiles(source: str, options: SearchOptions) -> str:
    """The tile of A of every row, for rows that don't carry it."""
    edge = options.tile_edge
    return subquery(["*", f"cast(ay div {edge} as int) as aty", f"cast(ax div {edge} as int) as atx"], source)


def _a_tile_columns(bound: BoundPairs) -> list[str]:
    return ["y0", "x0", "stride", *bound.weights, *[f"pa_{f}" for f in bound.features]]


def _met_a(source: str, bound: BoundPairs) -> str:
    """Rows that carry (aty, atx) next to that tile of A."""
    columns = ", ".join(f"t.{c}" for c in _a_tile_columns(bound))
    return f"(select /*+ shuffle_hash(t) */ r.*, {columns} from {source} r join {{a_tiles}} t using (pair_id, aty, atx))"


def _scored_tiled(met: str, bound: BoundPairs, options: SearchOptions, keep: list[str], hot: bool) -> str:
    """The same for ``tiled``, from rows next to their tile of A: the patch is cut from that tile, then
    meets the tile of B, or one of its copies if there is a table ``hot``."""
    edge, r, c = options.tile_edge, options.halo, options.channels
    length = (2 * r + 1) * c
    carry = list(dict.fromkeys([*keep, *_PLACE]))
    met_a = subquery(
        [*carry, *bound.weights, *[f"pa_{f}" for f in bound.features], *_row_bases("ia", "ay", "ax", "y0", "x0", options)], met
    )
    cut = {
        f: ", ".join(f"slice(pa_{f}, ia{row} + 1, {length})" for row in range(2 * r + 1)) for f in bound.features
    }
    carried = subquery(
        [*carry, *bound.weights, *[f"concat({v}) as pa_{f}" for f, v in cut.items()],
         f"cast(by div {edge} as int) as bty", f"cast(bx div {edge} as int) as btx"],
        met_a,
    )
    if hot:
        carried = f"(select /*+ broadcast(k) */ * from {carried} r left join {{hot}} k using (pair_id, bty, btx))"
        carried = subquery(["*", f"{copy_of(['ay', 'ax'])} as salt"], carried)
    tile = _b_tile(hot)
    return subquery(
        ["/*+ shuffle_hash(t) */ " + carry[0], *carry[1:], *tile[1:], *bound.weights, *bound.arrays,
         *_row_flags(options), *_row_bases("ib", "by", "bx", "y0", "x0", options)],
        f"{carried} join {{b_tiles}} t using ({', '.join(tile)})",
    )


def _scored_copied(met: str, bound: BoundPairs, options: SearchOptions, keep: list[str]) -> str:
    """The same where all tiles of B stand beside the tile of A: nothing is sent."""
    edge, width = options.tile_edge, range(2 * options.halo + 1)
    carry = list(dict.fromkeys([*keep, *_PLACE, "aty", "atx"]))
    pa, pb = [f"pa_{f}" for f in bound.features], [f"pb_{f}" for f in bound.features]
    known = [*carry, *bound.weights, *pa, *[f"ia{row}" for row in width]]
    met_a = subquery([*carry, *bound.weights, *pa, *_row_bases("ia", "ay", "ax", "y0", "x0", options)], met)
    met_b = f"(select /*+ shuffle_hash(t) */ r.*, {', '.join('t.' + b for b in pb)} from {met_a} r join {{b_tiles}} t using (pair_id, aty, atx))"
    place = f"cast((by div {edge}) * ((w + {edge - 1}) div {edge}) + bx div {edge} as int)"
    one = subquery(
        [*known, *[f"{b}[{place}] as {b}" for b in pb], f"cast(by div {edge} as int) * {edge} as y0", f"cast(bx div {edge} as int) * {edge} as x0",
         f"least({edge}, w - cast(bx div {edge} as int) * {edge}) + {2 * options.halo} as stride"], met_b)
    return subquery([*known, *pb, *_row_flags(options), *_row_bases("ib", "by", "bx", "y0", "x0", options)], one)


def _beside_tiles(bound: BoundPairs, options: SearchOptions) -> DataFrame:
    """All tiles of B, row by row, for each tile (aty, atx) of A: both images have one shape."""
    edge, pb = bound.tile_edge, [f"pb_{f}" for f in bound.features]
    last = lambda size: f"explode(sequence(0, cast(({size} - 1) div {edge} as int)))"
    every = bound.tiled_b.selectExpr("pair_id", "ty", "tx", "w", *pb, f"{last('h')} as aty").selectExpr("*", f"{last('w')} as atx")
    every = every.select(*_A_TILE, "ty", "tx", *pb).repartition(bound.tile_partitions, *_A_TILE)
    held = every.groupBy(*_A_TILE).agg(F.expr(f"array_sort(collect_list(struct(ty, tx, {', '.join(pb)}))) as tiles"))
    return held.selectExpr(*_A_TILE, *[f"tiles.{b} as {b}" for b in pb])


def _frames_of(bound: BoundPairs, options: SearchOptions, whole: bool, hot: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables a statement refers to."""
    if whole:
        return {"images": bound.whole.repartition(bound.partitions, "pair_id")}
    a_tiles = bound.tiled_a.selectExpr(
        "pair_id", "ty as aty", "tx as atx", "y0", "x0", "stride", *bound.weights,
        *[f"pa_{f}" for f in bound.features],
    )
    a_tries = bound.tiled_a.selectExpr("pair_id", "ty as aty", "tx as atx", f"{_tries(options)} as tries")
    b_tiles = bound.tiled_b if hot is None else copied_blocks(bound.tiled_b, ["pair_id"], hot)
    b_tiles = b_tiles.withColumnsRenamed({"ty": "bty", "tx": "btx"}).select(
        *_b_tile(hot is not None), "y0", "x0", "stride", *[f"pb_{f}" for f in bound.features]
    )
    # The number of partitions follows the packed bytes: a hash build doesn't spill.
    frames = {
        "a_tiles": a_tiles.repartition(bound.tile_partitions, *_A_TILE),
        # what a pixel offers is evaluated once per tile, not per pixel
        "tries": a_tries.repartition(bound.tile_partitions, *_A_TILE),
        "b_tiles": _beside_tiles(bound, options) if bound.copied else b_tiles.repartition(bound.tile_partitions, *_b_tile(hot is not None)),
    }
    if hot is not None:
        frames["hot"] = hot.withColumnsRenamed({"ty": "bty", "tx": "btx"})
    return frames


def matched_tiles(field: DataFrame, bound: BoundPairs, options: SearchOptions) -> DataFrame | None:
    """Tiles of B that need copies for the candidates of a field, see ``hot_tiles``. Moves may carry the
    matches of a tile to the tiles beside it, which get as many copies."""
    edge = options.tile_edge
    tiles = field.selectExpr("pair_id", f"cast(by div {edge} as int) as ty", f"cast(bx div {edge} as int) as tx")
    times = tiles.groupBy("pair_id", "ty", "tx").agg(F.count(F.lit(1)).alias("times"))
    return hot_tiles(times, ["pair_id"], bound.tile_partitions, edge, around=True)


def _scored_rows(bound: BoundPairs, options: SearchOptions, keep: list[str], whole: bool, hot: bool = False) -> str:
    """Statement scoring the rows of table ``rows`` as ``score``."""
    if whole:
        joined = f"(select /*+ shuffle_hash(i) */ r.*, {_image_columns(bound)} from {{rows}} r join {{images}} i using (pair_id))"
        source = _scored_whole(joined, bound, options, keep)
    else:
        met = _met_a(_in_tiles("{rows}", options), bound)
        source = _scored_copied(met, bound, options, keep) if bound.copied else _scored_tiled(met, bound, options, keep, hot)
    return subquery([*keep, f"{_fresh_score(bound, options, not whole and not bound.copied)} as score"], source)


def _image_columns(bound: BoundPairs) -> str:
    return ", ".join(f"i.{c}" for c in ("stride", *bound.weights, *bound.arrays))


def _run_sql(text: str, frames: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(frames.values())).sparkSession
    used = {name: frame for name, frame in frames.items() if f"{{{name}}}" in text}
    return spark.sql(text[1:-1], **used)


def score_candidates(candidates: DataFrame, bound: BoundPairs, options: SearchOptions) -> DataFrame:
    """``candidates(pair_id, h, w, ay, ax, by, bx, ..)`` inside both images, with their distance ``d``."""
    columns = candidates.columns
    options = replace(options, tile_edge=bound.tile_edge)
    if bound.copied:
        packed = lambda tiles, side: resident.as_arrays(tiles, [f"{side}_{f}" for f in bound.features])
        bound = replace(bound, tiled_a=packed(bound.tiled_a, "pa"), tiled_b=packed(bound.tiled_b, "pb"))
    parts = []
    for whole in (True, False):
        if (bound.whole if whole else bound.tiled_a) is None:
            continue
        rows = candidates.repartition(bound.partitions, "pair_id") if whole else candidates
        tables = {"rows": rows, **_frames_of(bound, options, whole)}
        parts.append(_run_sql(_scored_rows(bound, options, columns, whole), tables))
    scored = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return scored.selectExpr(*columns, f"{distance_of('score', options.scale)} as d")


# ---------------------------------------------------------------- candidates


def _random_start(source: str, kept: list[str]) -> str:
    """Uniform matches (by, bx) for rows with pair_id, h, w, ay, ax."""
    keyed = subquery(["*", f"{key_of('pair_id', 'ay', 'ax', '0')} as key"], source)
    drawn = with_draws(keyed, kept, {"dy": f"{SALT_Y}", "dx": f"{SALT_X}"})
    return subquery(
        [*kept, f"{pick_between('0', 'h', 'dy')} as by", f"{pick_between('0', 'w', 'dx')} as bx"], drawn
    )


def _tries(options: SearchOptions, incumbent: bool = True, moves: bool = True, random: bool = True) -> str:
    """ARRAY of what a pixel offers, as SQL text: (pri, uy, ux, mag).

    Priority 0 is the incumbent. Moves go to the pixels below, above, right and left, so that those
    test the match of the pixel above, below, left and right of them; a scan moves right, then down.
    From priority 5 on come the random draws, one per radius ``mag``.
    """
    fixed = ([(0, 0, 0)] if incumbent else []) + (STEPS[options.propagation] if moves else [])
    structs = ", ".join(f"named_struct('pri', {p}, 'uy', {uy}, 'ux', {ux}, 'mag', 0)" for p, uy, ux in fixed)
    parts = [f"array({structs})"] if fixed else []
    if random:
        given = str(options.radius) if options.radius is not None else "cast(null as int)"
        radii = radius_schedule(clamp_radius(given, "h", "w"))
        parts.append(
            f"transform({radii}, (m, k) -> named_struct('pri', {FIRST_RANDOM} + k, 'uy', 0, 'ux', 0, 'mag', m))"
        )
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def _stride_of_round(options: SearchOptions, round_: str = "round") -> str:
    """How far moves go in the round of column ``round``: the jump, or forward and backward in turn."""
    if options.propagation == "jump":
        return f"get(array({', '.join(map(str, options.jumps))}), ({round_} - 1) % {len(options.jumps)})"
    return f"(1 - ({round_} - 1) % 2 * 2)"


def _offered(source: str, options: SearchOptions, passed: list[str], random: bool = True) -> str:
    """Candidates from the ``tries`` of every pixel for the round in column ``round``.

    One generator, so the field is read once and nothing is shuffled. Round and jump are columns:
    the generated code is the same for every round and compiled once.
    """
    return _drawn(_tried(source, options, passed), options, passed, random)


def _tried(source: str, options: SearchOptions, passed: list[str], tile_edge: int | None = None) -> str:
    """The tries one by one that lie inside both images; with ``tile_edge`` only those for pixels of the tile
    (aty, atx) in ``passed``."""
    base = [*_PLACE, "round", *[c for c in passed if c != "round"]]
    keyed = subquery(
        [*base, "tries", f"coalesce({_stride_of_round(options)}, 0) as far",
         f"{key_of('pair_id', 'ay', 'ax', 'round')} as key"],
        source,
    )
    here = in_bounds("ay + uy * far", "ax + ux * far", "h", "w")
    if tile_edge is not None:
        here = " and ".join(
            f"a{p} + u{p} * far >= at{p} * {tile_edge} and a{p} + u{p} * far < least(at{p} * {tile_edge} + {tile_edge}, {size})"
            for p, size in (("y", "h"), ("x", "w"))
        )
    inside = f"{here} and {in_bounds('by + uy * far', 'bx + ux * far', 'h', 'w')}"
    present = [f"coalesce({n}, 0) as {n}" for n in ("pri", "uy", "ux", "mag")]
    tried = subquery([*base, "far", "key", *present], subquery([*base, "far", "key", "inline(tries)"], keyed))
    return subquery(["*"], tried, inside)


def _drawn(tried: str, options: SearchOptions, passed: list[str], random: bool = True) -> str:
    """Pixel and match of every try."""
    by, bx = "by + uy * far", "bx + ux * far"
    if random:
        moved = [*dict.fromkeys([*_PLACE, "round", *passed]), "far", "key", "pri", "uy", "ux", "mag"]
        salt = f"2 * (pri - {FIRST_RANDOM - 1})"
        tried = with_draws(tried, moved, {"dy": f"{salt} + {SALT_Y}", "dx": f"{salt} + {SALT_X}"})
        extra = " + 1" if options.random == "closed" else ""

        def around(best: str, size: str, drawn: str) -> str:
            return pick_between(f"greatest({best} - mag, 0)", f"least({best} + mag{extra}, {size})", drawn)

        by = f"if(mag > 0, {around('by', 'h', 'dy')}, {by})"
        bx = f"if(mag > 0, {around('bx', 'w', 'dx')}, {bx})"
    return subquery(
        ["pair_id", "h", "w", "ay + uy * far as ay", "ax + ux * far as ax", f"{by} as by", f"{bx} as bx", "pri",
         *passed],
        tried,
    )


def neighbour_candidates(field: DataFrame, options: SearchOptions) -> DataFrame:
    """Matches of the neighbours for the round after the one in ``round``."""
    tries = _tries(options, incumbent=False, random=False)
    ahead = subquery([*_PLACE, "round + 1 as round", f"{tries} as tries"], "{field}")
    return _run_sql(_offered(ahead, options, [], random=False), {"field": field}).select(*_CANDIDATE)


def random_candidates(field: DataFrame, options: SearchOptions) -> DataFrame:
    """Random matches around the current one for the round after the one in ``round``."""
    tries = _tries(options, incumbent=False, moves=False)
    ahead = subquery([*_PLACE, "round + 1 as round", f"{tries} as tries"], "{field}")
    return _run_sql(_offered(ahead, options, []), {"field": field}).select(*_CANDIDATE)


def best_candidate(scored: DataFrame, by: str = "d") -> DataFrame:
    """Smallest distance per pixel; on equal distances the candidate tried first (lowest ``pri``)."""
    keys = ["pair_id", "h", "w", "ay", "ax"]
    best = scored.groupBy(*keys).agg(F.min(F.struct(by, "pri", "by", "bx")).alias("m"))
    return best.select(*keys, "m.by", "m.bx", f"m.{by}")


def _settled(source: str, fresh: str, options: SearchOptions) -> str:
    """The best candidate per pixel as the state of the next round.

    With an exact integer score the whole comparison is one BIGINT: a hash aggregation on
    fixed-width buffers that combines before any shuffle. The distance is computed inside the
    aggregation so that it becomes a method of its own in the generated code; together with the
    candidate code it would be too long for the JVM to compile. The incumbent is scored again like
    the others, because a condition around the distance would keep it in one piece.
    """
    keys = ["pair_id", "h", "w", "ay", "ax", "round"]
    if options.scale is None:
        best = subquery([*keys, f"min(struct({fresh} as score, pri, by, bx)) as m"], source, group_by=keys)
        columns = {n: n if n in keys else f"m.{n}" for n in _STATE[1:]}
        return subquery(["pair_id", *_present(columns)], best)
    rank = f"{fresh} * {PRIORITY_SLOTS} + pri"
    best = subquery(
        [*keys, f"min({rank}) as rank", f"min_by(by * {_CODE_BASE}L + bx, {rank}) as code"], source, group_by=keys
    )
    columns = {n: n for n in _STATE[1:]}
    columns["by"] = f"cast(code div {_CODE_BASE}L as int)"
    columns["bx"] = f"cast(code % {_CODE_BASE}L as int)"
    columns["score"] = f"rank div {PRIORITY_SLOTS}"
    return subquery(["pair_id", *_present(columns)], best)


# ---------------------------------------------------------------- rounds


def _ahead(state: str) -> str:
    return subquery([*_PLACE, "round + 1 as round"], state)


def _next_whole(state: str, bound: BoundPairs, options: SearchOptions) -> str:
    keep = [*_PLACE, "round", "pri"]
    rows = (
        f"(select /*+ shuffle_hash(i) */ s.*, i.tries, {_image_columns(bound)}"
        f" from {_ahead(state)} s join {{images}} i using (pair_id))"
    )
    offered = _offered(rows, options, ["round", "stride", *bound.weights, *bound.arrays])
    source = _scored_whole(offered, bound, options, keep)
    return _settled(source, _fresh_score(bound, options, False), options)


def _offered_in_tile(state: str, bound: BoundPairs, options: SearchOptions) -> str:
    """Candidates of the next round for the pixels of each tile of A, from the field rows the tile holds, next to it."""
    ahead = subquery([*_PLACE, "round + 1 as round", "aty", "atx"], state)
    rows = f"(select /*+ shuffle_hash(t) */ s.*, t.tries from {ahead} s join {{tries}} t using (pair_id, aty, atx))"
    # the tile is met between the generator and the draws, in one piece they are too long for the JVM to compile
    tried = _met_a(_tried(rows, options, ["round", "aty", "atx"], options.tile_edge), bound)
    return _drawn(tried, options, ["round", *_a_tile_columns(bound)])


def _tiles_in_need(options: SearchOptions) -> str:
    """ARRAY of (aty, atx): the tile of a pixel, and those into which the moves of the next round take its match."""
    edge, far = options.tile_edge, "far"
    tile = lambda y, x: f"struct(cast(({y}) div {edge} as int) as aty, cast(({x}) div {edge} as int) as atx)"
    own = tile("ay", "ax")
    ends = [(f"ay + {s}{far}", "ax") for s in ("", "-")] + [("ay", f"ax + {s}{far}") for s in ("", "-")]
    reached = ", ".join(f"if({in_bounds(y, x, 'h', 'w')}, {tile(y, x)}, {own})" for y, x in ends)
    inner = " and ".join(f"{p} % {edge} >= {far} and {p} % {edge} < {edge} - {far}" for p in ("ay", "ax"))
    return f"if({inner}, array({own}), array_distinct(array({own}, {reached})))"


def _settled_in_tiles(source: str, bound: BoundPairs, options: SearchOptions, more: bool, hot: bool) -> str:
    """The best candidate per pixel, back in the tiles of A: combined where the tile of B is, then sent, then
    combined again. ``more``: another round follows, so that tiles beside a pixel get its match as well."""
    keys = ["pair_id", "h", "w", "ay", "ax", "round"]
    here = list(dict.fromkeys([*keys, *_b_tile(hot)]))
    fresh = _fresh_score(bound, options, True)
    if options.scale is None:
        held = ["m"]
        combined = subquery([*here, f"min(struct({fresh} as score, pri, by, bx)) as m"], source, group_by=here)
        best = ["min(m) as m"]
    else:
        held = ["rank", "code"]
        rank = f"{fresh} * {PRIORITY_SLOTS} + pri"
        combined = subquery(
            [*here, f"min({rank}) as rank", f"min_by(by * {_CODE_BASE}L + bx, {rank}) as code"], source, group_by=here
        )
        best = ["min(rank) as rank", "min_by(code, rank) as code"]
    if more:
        ahead = subquery([*keys, *held, f"abs(coalesce({_stride_of_round(options, '(round + 1)')}, 0)) as far"], combined)
        spread = subquery([*keys, *held, f"inline({_tiles_in_need(options)})"], ahead)
    else:
        spread = _in_tiles(subquery([*keys, *held], combined), options)
    # declared present before the exchange, whose columns the rounds must not change
    known = subquery([*keys, *held, "coalesce(aty, 0) as aty", "coalesce(atx, 0) as atx"], spread)
    sent = subquery([f"/*+ repartition({bound.tile_partitions}, {', '.join(_A_TILE)}) */ *"], known)
    tiled = list(dict.fromkeys([*_A_TILE, *keys]))
    settled = subquery([*tiled, *best], sent, group_by=tiled)
    columns = {n: n for n in _STATE[1:]}
    if options.scale is None:
        columns = {n: n if n in keys else f"m.{n}" for n in columns}
    else:
        columns |= {
            "by": f"cast(code div {_CODE_BASE}L as int)", "bx": f"cast(code % {_CODE_BASE}L as int)",
            "score": f"rank div {PRIORITY_SLOTS}",
        }
    return subquery([*_A_TILE, *_present(columns)], settled)


def _next_tiled(state: str, bound: BoundPairs, options: SearchOptions, more: bool, hot: bool) -> str:
    source = _scored_tiled(_offered_in_tile(state, bound, options), bound, options, [*_PLACE, "round", "pri"], hot)
    return _settled_in_tiles(source, bound, options, more, hot)


def _declared(state: DataFrame) -> DataFrame:
    """The state with columns declared present, see ``_present``."""
    return state.selectExpr("pair_id", *_present({n: n for n in _STATE[1:]}))


def _start_whole(bound: BoundPairs, options: SearchOptions, given: DataFrame | None, tables: dict[str, DataFrame]) -> DataFrame:
    """Random matches, or those of a field, with their scores."""
    keep = [*_PLACE, "round"]
    if given is not None:
        rows = given.select(*keep).repartition(bound.partitions, "pair_id")
        return _declared(_run_sql(_scored_rows(bound, options, keep, True), {**tables, "rows": rows}))
    # drawn and scored from the packed pair alone, without a join
    place = ["pair_id", "h", "w", "ay", "ax", "round", "stride", *bound.weights, *bound.arrays]
    pixels = subquery(["*", "explode(sequence(0, h * w - 1)) as p"], "{images}")
    placed = subquery(["*", "cast(p div w as int) as ay", "p % w as ax"], pixels)
    drawn = subquery(["*", "0 as pri"], _random_start(placed, place))
    source = _scored_whole(drawn, bound, options, [*keep, "pri"])
    return _declared(_run_sql(_settled(source, _fresh_score(bound, options, False), options), tables))


def _run_whole(bound: BoundPairs, options: SearchOptions, rounds: int, given: DataFrame | None) -> DataFrame:
    tables = _frames_of(bound, options, True)
    state = _start_whole(bound, options, given, tables)
    statement = _next_whole("{state}", bound, options)
    left = rounds
    while left > 0:
        batch = min(left, options.rounds_per_checkpoint)
        for _ in range(batch):
            state = _run_sql(statement, {"state": state, **tables})
        left -= batch
        if left > 0:
            state = cut_lineage(state).repartition(bound.partitions, "pair_id")
    return state


def _start_tiled(bound: BoundPairs, options: SearchOptions, given: DataFrame | None, tables: dict[str, DataFrame], more: bool) -> DataFrame:
    """The same in the tiles of A."""
    keep = [*_PLACE, "round"]
    if given is not None:
        rows = given.select(*keep)
    else:
        pixels = block_positions(bound.tiled_a, "pair_id", "h", "w", "round").withColumnsRenamed({"y": "ay", "x": "ax"})
        rows = _run_sql(_random_start("{pixels}", pixels.columns), {"pixels": pixels}).select(*keep)
    placed = subquery(["*", "0 as pri"], _in_tiles("{rows}", options))
    source = _scored_tiled(_met_a(placed, bound), bound, options, [*keep, "pri"], "hot" in tables)
    return _run_sql(_settled_in_tiles(source, bound, options, more, "hot" in tables), {**tables, "rows": rows})


def _run_copied(bound: BoundPairs, options: SearchOptions, rounds: int, given: DataFrame | None) -> DataFrame:
    jumps = options.jumps if options.propagation == "jump" else None
    plan = resident.Plan(
        options.halo, options.channels, options.radius, tuple(STEPS[options.propagation]), jumps, options.random == "closed",
        options.tile_edge, options.scale, bound.features,
    )
    return resident.search(bound.tiled_a, bound.tiled_b, plan, bound.tile_partitions, rounds, given, options.rounds_per_checkpoint)


def _run_tiled(bound: BoundPairs, options: SearchOptions, rounds: int, given: DataFrame | None) -> DataFrame:
    edge = options.tile_edge
    if bound.copied:
        return _run_copied(bound, options, rounds, given)
    if given is not None:
        hot = matched_tiles(given, bound, options)
    else:  # random matches meet each tile as often as it has pixels
        times = bound.tiled_b.selectExpr("pair_id", "ty", "tx", "cast(bh * bw as bigint) as times")
        hot = hot_tiles(times, ["pair_id"], bound.tile_partitions, edge)
    tables = _frames_of(bound, options, False, hot)
    state = _start_tiled(bound, options, given, tables, rounds > 0)
    for done in range(1, rounds + 1):
        statement = _next_tiled("{state}", bound, options, done < rounds, "hot" in tables)
        state = _run_sql(statement, {"state": state, **tables})
        if done < rounds and done % options.rounds_per_checkpoint == 0:
            state = cut_lineage(state)
            own = state.where(f"ay div {edge} = aty and ax div {edge} = atx")
            tables = _frames_of(bound, options, False, matched_tiles(own, bound, options))
            state = state.repartition(bound.tile_partitions, *_A_TILE)
    return state


def _run(bound: BoundPairs, options: SearchOptions, rounds: int, given: DataFrame | None, whole: bool) -> DataFrame:
    state = (_run_whole if whole else _run_tiled)(bound, options, rounds, given)
    return state.withColumn("d", F.expr(distance_of("score", options.scale))).select(*FIELD_COLUMNS)


def search_rounds(bound: BoundPairs, options: SearchOptions, rounds: int, start: DataFrame | None = None) -> DataFrame:
    """Run ``rounds`` rounds from the field ``start``, or from a random one."""
    large = f"greatest(h, w) > {options.whole_edge}"
    options = replace(options, tile_edge=bound.tile_edge)
    parts = []
    for whole in (True, False):
        if (bound.whole if whole else bound.tiled_a) is not None:
            own = start.where(f"not ({large})" if whole else large) if start is not None else None
            parts.append(_run(bound, options, rounds, own, whole))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def init_field(pairs: DataFrame, pixels: DataFrame, options: SearchOptions) -> DataFrame:
    """Random field with its distances, round 0."""
    return search_rounds(bind_pairs(pairs, pixels, options), options, 0)


def compute_field(pairs: DataFrame, pixels: DataFrame, options: SearchOptions, iterations: int = 2) -> DataFrame:
    """Field of all pairs after ``iterations`` (each one round per jump, or one scan round)."""
    return search_rounds(bind_pairs(pairs, pixels, options), options, options.rounds(iterations))


def resume_field(field: DataFrame, pairs: DataFrame, pixels: DataFrame, options: SearchOptions, rounds: int) -> DataFrame:
    """Continue a stored field; its ``round`` column says how many rounds it has had."""
    return search_rounds(bind_pairs(pairs, pixels, options), options, rounds, start=field)
