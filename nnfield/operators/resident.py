"""Tiles packed in numpy, and the tiled search where all of image B stands beside each tile of A, for a whole tile at a time in numpy.

The state is a row for each tile of A: its matches and scores as packed arrays. A round meets it with the tile's
pixels and all tiles of B, tries every candidate for the pixels of the tile together, and keeps the best. What the
moves of the next round carry over the tile's border is sent to the tiles beside it, as packed rectangles, so a round
shuffles few rows. Draws, window sums and the order of candidates are those of the SQL text in ``search``: both give
the same field.

Memory of a task: one tile's state and candidates, and image B twice (its tiles as they come, and put together with one
machine word a pixel).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nnfield.functions.draws import KEY_WEIGHTS, MASK, MIX_LAST, MIX_STEPS, PAIR_BITS, SALT_X, SALT_Y
from nnfield.functions.windows import MAX_PIXEL_SQUARE
from nnfield.session import cut_lineage

KEYS = ["pair_id", "aty", "atx"]
# Pixels whose candidates are scored together: their patches stay in a core's cache.
CHUNK = 16_384
# Pixels that are cut into pieces of tiles together.
PIECE_PIXELS = 200_000
_WORDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}
# What a message holds: matches drawn at random, the state of the tile, or (from 1 on) what a move brings.
_DRAWN, _OWN = -1, 0


@dataclass(frozen=True)
class Plan:
    """Plain values of the options, for the workers. ``steps``: (priority, uy, ux) of the moves."""

    halo: int
    channels: int
    radius: int | None
    steps: tuple[tuple[int, int, int], ...]
    jumps: tuple[int, ...] | None
    closed: bool
    edge: int
    scale: int | None
    features: tuple[str, ...]

    @property
    def score_type(self) -> type:
        return np.float64 if self.scale is None else np.int64

    @property
    def unknown(self) -> float | int:
        """The score of a pixel without a match."""
        return np.inf if self.scale is None else np.iinfo(np.int64).max

    def far(self, round_no: int) -> int:
        """How far moves go in a round: its jump, or forward and backward in turn."""
        if self.jumps is None:
            return 1 - int(np.fmod(round_no - 1, 2)) * 2
        k = int(np.fmod(round_no - 1, len(self.jumps)))
        return self.jumps[k] if k >= 0 else 0

    def radii(self, h: int, w: int) -> list[int]:
        top = min(max(h, w) if self.radius is None else self.radius, max(h, w))
        return [top >> k for k in range(top.bit_length())] if top > 0 else []


# ---------------------------------------------------------------- packing


def _spread(at: np.ndarray, size: int, edge: int, halo: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, tile): the tiles in which each coordinate lies, halos included."""
    first, last = np.maximum(at - halo, 0) // edge, np.minimum((at + halo) // edge, (size - 1) // edge)
    for k in range(int((last - first).max(initial=-1)) + 1):
        which = np.flatnonzero(first + k <= last)
        yield which, first[which] + k


def _parts(keys: np.ndarray) -> list[np.ndarray]:
    """The positions of each value, in order; most often the keys are one value or nearly sorted."""
    if not len(keys):
        return []
    if (keys == keys[0]).all():
        return [np.arange(len(keys))]
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(keys[order])) + 1)


def _pieces(table: pa.Table, halo: int, edge: int, channels: int) -> Iterator[tuple]:
    """(image_id, h, w, ty, tx, places, values) of the pixel rows that lie in one tile."""
    image = table.column("image_id").dictionary_encode().unify_dictionaries().combine_chunks()
    image = image.chunk(0) if isinstance(image, pa.ChunkedArray) else image
    size, at = table.column("size").to_numpy(), table.column("at").to_numpy()
    y, x = at >> 32, at & MASK
    words = [table.column(f"v{k}").to_numpy().astype("<i8").view(np.int8).reshape(-1, 8) for k in range(-(-channels // 8))]
    values = (words[0] if len(words) == 1 else np.concatenate(words, axis=1))[:, :channels]
    for of_image in _parts(image.indices.to_numpy()):
        image_id = image.dictionary[image.indices[of_image[0]].as_py()].as_py()
        for of_shape in _parts(size[of_image]):
            own = of_image[of_shape]
            high, wide = int(size[own[0]]) >> 32, int(size[own[0]]) & MASK
            for in_rows, ty in _spread(y[own], high, edge, halo):
                for in_columns, tx in _spread(x[own][in_rows], wide, edge, halo):
                    at, row = own[in_rows][in_columns], ty[in_columns]
                    stride = np.minimum(edge, wide - tx * edge) + 2 * halo
                    place = ((y[at] - row * edge + halo) * stride + (x[at] - tx * edge + halo)).astype(np.int32)
                    for part in _parts(row.astype(np.int64) * (wide // edge + 1) + tx):
                        yield image_id, high, wide, int(row[part[0]]), int(tx[part[0]]), place[part].tobytes(), values[at[part]].tobytes()


def packed_tiles(pixels: DataFrame, halo: int, edge: int, channels: int) -> DataFrame:
    """Tiles like those of ``pack_blocks``, halos beyond the image 0, with ``px`` as BINARY of signed bytes, for images of few tiles.

    ``pixels(image_id, h, w, y, x, v)`` become pieces of tiles where they are read, so that the shuffle has a row for very many
    pixels. A tile that lacks pixels has an empty ``px``.
    """
    kind = dict(pixels.dtypes)["image_id"]
    whole = ["h", "w", "ty", "tx"]
    piece = f"image_id {kind}, h int, w int, ty int, tx int, places binary, pixels binary"
    geometry = ["y0", "x0", "bh", "bw", "stride", "c"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            made = [*_pieces(pa.Table.from_batches(held), halo, edge, channels)]
            if made:
                types = [held[0].schema.field("image_id").type, *[pa.int32()] * 4, pa.binary(), pa.binary()]
                names = ["image_id", *whole, "places", "pixels"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PIECE_PIXELS:
                yield from flushed()
                held, size = [], 0
        if held:
            yield from flushed()

    def join(pieces: pa.Table) -> pa.Table:
        h, w, ty, tx = (pieces.column(c)[0].as_py() for c in whole)
        y0, x0 = ty * edge, tx * edge
        bh, bw = min(edge, h - y0), min(edge, w - x0)
        stride = bw + 2 * halo
        px, seen = np.zeros(((bh + 2 * halo) * stride, channels), np.int8), np.zeros((bh + 2 * halo) * stride, bool)
        for places, values in zip(pieces.column("places"), pieces.column("pixels")):
            at = np.frombuffer(places.as_buffer(), np.int32)
            px[at], seen[at] = np.frombuffer(values.as_buffer(), np.int8).reshape(-1, channels), True
        inside = (min(y0 + bh + halo, h) - max(y0 - halo, 0)) * (min(x0 + bw + halo, w) - max(x0 - halo, 0))
        data = px.tobytes() if seen.sum() == inside else b""
        numbers = [pa.array([n], pa.int32()) for n in (h, w, ty, tx, y0, x0, bh, bw, stride, channels)]
        image_id = pieces.column("image_id").combine_chunks().slice(0, 1)
        return pa.table([image_id, *numbers, pa.array([data], pa.binary())], names=["image_id", *whole, *geometry, "px"])

    # what a task hands over to Python costs by the value: both sizes, both coordinates and up to eight channels are one each
    two = lambda high, low: f"shiftleft(cast({high} as bigint), 32) | cast({low} as bigint)"
    byte = lambda k: f"shiftleft(cast(coalesce(cast(v[{k}] - 128 as tinyint), 0Y) & 255 as bigint), {k % 8 * 8})"
    word = lambda k: " | ".join(byte(i) for i in range(k, min(k + 8, channels)))
    rows = pixels.where(f"image_id is not null and y >= 0 and x >= 0 and y < h and x < w and size(v) = {channels}").selectExpr(
        "image_id", f"{two('h', 'w')} as size", f"{two('y', 'x')} as at", *[f"{word(k)} as v{k // 8}" for k in range(0, channels, 8)])
    pieces = rows.mapInArrow(cut, piece)
    result = f"image_id {kind}, {', '.join(f'{c} int' for c in (*whole, *geometry))}, px binary"
    return pieces.groupBy("image_id", *whole).applyInArrow(join, result)


# ---------------------------------------------------------------- draws


def _key(pair_id: int, ay: np.ndarray, ax: np.ndarray, round_no: int) -> np.ndarray:
    """The part of the hash all draws of a pixel and round share: the low 32 bits, the others are masked away."""
    p, q, r, s, _ = KEY_WEIGHTS
    fixed = ((pair_id & PAIR_BITS) * p + round_no * s) & MASK
    return ay.astype(np.uint32) * np.uint32(q) + ax.astype(np.uint32) * np.uint32(r) + np.uint32(fixed)


def _draw(key: np.ndarray, salt: int) -> np.ndarray:
    n = key + np.uint32(salt * KEY_WEIGHTS[4] & MASK)
    for bits, multiplier in MIX_STEPS:
        n ^= n >> np.uint32(bits)
        n *= np.uint32(multiplier)
    n ^= n >> np.uint32(MIX_LAST)
    return n


def _pick(low: np.ndarray | int, high: np.ndarray | int, drawn: np.ndarray) -> np.ndarray:
    """A draw in [low, high)."""
    span = np.asarray(high - low).astype(np.uint32)
    return (drawn % span).astype(np.int32) + np.int32(low) if np.isscalar(low) else (drawn % span).astype(np.int32) + low


# ---------------------------------------------------------------- scoring


def _blank(rows: int, columns: int, channels: int) -> np.ndarray:
    """An image whose pixels fill a machine word each, so that one index reads one; over 8 channels have no such word."""
    return np.zeros((rows, columns, next((k for k in _WORDS if k >= channels), channels)), np.int8)


def _words(image: np.ndarray) -> np.ndarray:
    """The pixels of such an image, one after the other."""
    flat = image.reshape(-1, image.shape[2])
    return flat.view(_WORDS[image.shape[2]])[:, 0] if image.shape[2] in _WORDS else flat


def _read(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    return words.take(at, axis=0, mode="clip").view(np.int8).reshape(len(at), -1)


class _Images:
    """A tile of A and all of B, for one pair."""

    def __init__(self, beside: pa.Table, plan: Plan):
        rows = beside.drop_columns([f"p_{f}" for f in plan.features]).to_pylist()
        own = next(i for i, r in enumerate(rows) if r["side"] == "a")
        self.plan, tile, r, c = plan, rows[own], plan.halo, plan.channels
        self.pair_id, self.h, self.w = tile["pair_id"], tile["h"], tile["w"]
        self.aty, self.atx = tile["aty"], tile["atx"]
        self.y0, self.x0, self.bh, self.bw, self.stride = (tile[k] for k in ("y0", "x0", "bh", "bw", "stride"))
        self.wide = self.w + 2 * r
        self.layers = []
        for feature in plan.features:
            if not tile[f"w_{feature}"]:
                continue
            px = beside.column(f"p_{feature}")
            packed = lambda i: np.frombuffer(px[i].as_buffer(), np.int8)
            a, b = _blank(self.bh + 2 * r, self.stride, c), _blank(self.h + 2 * r, self.wide, c)
            a[:, :, :c] = packed(own).reshape(self.bh + 2 * r, self.stride, c)
            for i, at in enumerate(rows):
                if at["side"] == "b":
                    inner = packed(i).reshape(at["bh"] + 2 * r, at["stride"], c)[r : r + at["bh"], r : r + at["bw"]]
                    b[at["y0"] + r : at["y0"] + r + at["bh"], at["x0"] + r : at["x0"] + r + at["bw"], :c] = inner
            self.layers.append((tile[f"w_{feature}"], _words(a), _words(b)))

    def at(self, first: int, last: int) -> None:
        """From now on the pixels first to last - 1 of the tile, row by row, are scored."""
        r, width, p = self.plan.halo, 2 * self.plan.halo + 1, np.arange(first, last)
        y, x = p // self.bw, p % self.bw
        self.ay, self.ax = (y + self.y0).astype(np.int32), (x + self.x0).astype(np.int32)
        corner = y * self.stride + x
        self.patches = [
            [_read(a, corner + (row * self.stride + k)).astype(np.int16) for row in range(width) for k in range(width)]
            for _, a, _ in self.layers
        ]
        self.inner = (self.ay >= r) & (self.ay < self.h - r) & (self.ax >= r) & (self.ax < self.w - r)

    def scores(self, by: np.ndarray, bx: np.ndarray) -> np.ndarray:
        """Comparable distance of every pixel to the match (by, bx), over the part of the window inside both images."""
        r, width, scale = self.plan.halo, 2 * self.plan.halo + 1, self.plan.scale
        corner = by.astype(np.int64) * self.wide + bx
        wide_sum = np.int32 if width * width * MAX_PIXEL_SQUARE < 2**31 else np.int64
        total = np.zeros(len(by), np.int64)
        for (weight, _, b), patch in zip(self.layers, self.patches):
            sums = np.zeros(patch[0].shape, wide_sum)
            for k, a in enumerate(patch):
                d = a - _read(b, corner + (k // width * self.wide + k % width))
                np.multiply(d, d, out=d)  # at most 255 * 255: 16 bits without a sign
                sums += d.view(np.uint16)
            if self.plan.channels <= 8:
                for ch in range(self.plan.channels):
                    total += weight * sums[:, ch].astype(np.int64)
            else:
                total += weight * sums.sum(axis=1, dtype=np.int64)
        scores = total * (scale // (width * width)) if scale is not None else total / float(width * width)
        inner = self.inner & (by >= r) & (by < self.h - r) & (bx >= r) & (bx < self.w - r)
        clipped = np.flatnonzero(~inner)
        if len(clipped):
            scores[clipped] = self._clipped(clipped, by[clipped], bx[clipped], corner[clipped])
        return scores

    def _clipped(self, at: np.ndarray, by: np.ndarray, bx: np.ndarray, corner: np.ndarray) -> np.ndarray:
        """The same for pixels ``at`` whose windows reach beyond an image."""
        r, width = self.plan.halo, 2 * self.plan.halo + 1
        inside = []
        for a, b, size in ((self.ay[at], by, self.h), (self.ax[at], bx, self.w)):
            low, high = np.minimum(a, b), np.maximum(a, b)
            inside.append([(low >= r - k) & (high < size + r - k) for k in range(width)])
        total = np.zeros(len(at), np.int64)
        for (weight, _, b), patch in zip(self.layers, self.patches):
            for k, a in enumerate(patch):
                d = a[at].astype(np.int32) - _read(b, corner + (k // width * self.wide + k % width))
                held = inside[0][k // width] & inside[1][k % width]
                total += np.where(held, weight * (d * d).sum(axis=1, dtype=np.int64), 0)
        count = sum(f.astype(np.int64) for f in inside[0]) * sum(f.astype(np.int64) for f in inside[1])
        return total * (self.plan.scale // count) if self.plan.scale is not None else total / count.astype(np.float64)


# ---------------------------------------------------------------- rounds


def _carried(images: _Images, by: np.ndarray, bx: np.ndarray, far: int, own: bool) -> Iterator[tuple]:
    """(priority, aty, atx, top, left, by, bx): what the moves bring into the tile itself (``own``) or into others.
    Where a match would lie outside the image, by is -1."""
    plan, edge = images.plan, images.plan.edge
    for pri, uy, ux in plan.steps:
        dy, dx = uy * far, ux * far
        y0, y1, x0, x1 = images.y0 + dy, images.y0 + images.bh + dy, images.x0 + dx, images.x0 + images.bw + dx
        moved_y, moved_x = by + np.int32(dy), bx + np.int32(dx)
        inside = (by >= 0) & (moved_y >= 0) & (moved_y < images.h) & (moved_x >= 0) & (moved_x < images.w)
        moved_y, moved_x = np.where(inside, moved_y, np.int32(-1)), np.where(inside, moved_x, np.int32(0))
        top, end, left, right = max(y0, 0), min(y1, images.h), max(x0, 0), min(x1, images.w)
        if top >= end or left >= right:
            continue
        for aty in range(top // edge, (end - 1) // edge + 1):
            for atx in range(left // edge, (right - 1) // edge + 1):
                if ((aty, atx) == (images.aty, images.atx)) is own:
                    t, e, l, r = max(top, aty * edge), min(end, aty * edge + edge), max(left, atx * edge), min(right, atx * edge + edge)
                    part = np.s_[t - y0 : e - y0, l - x0 : r - x0]
                    yield pri, aty, atx, t, l, moved_y[part], moved_x[part]


def _placed(images: _Images, message: dict) -> tuple[np.ndarray, np.ndarray, tuple]:
    shape = (message["rows"], message["columns"])
    top, left = message["top"] - images.y0, message["left"] - images.x0
    by, bx = (np.frombuffer(message[k], np.int32).reshape(shape) for k in ("by", "bx"))
    return by, bx, np.s_[top : top + shape[0], left : left + shape[1]]


def _settle(images: _Images, messages: list[dict], round_no: int, moves: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(by, bx, score) of the tile after a round, or (``moves`` False) at its start. by is -1 where no match is known."""
    plan, shape = images.plan, (images.bh, images.bw)
    full = lambda value, kind: np.full(shape, value, kind)
    was_y, was_x, score = full(-1, np.int32), full(0, np.int32), full(plan.unknown, plan.score_type)
    offers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def offer(name: int, part: tuple, by: np.ndarray, bx: np.ndarray) -> None:
        held_y, held_x = offers.setdefault(name, (full(-1, np.int32), full(0, np.int32)))
        held_y[part], held_x[part] = by, bx

    for m in messages:
        if m["pri"] != _DRAWN:
            by, bx, part = _placed(images, m)
            if m["pri"] == _OWN and m["score"] is not None:
                was_y[part], was_x[part] = by, bx
                score[part] = np.frombuffer(m["score"], plan.score_type).reshape(by.shape)
            else:
                if by.size and (by.max() >= images.h or bx.max() >= images.w):
                    raise ValueError(f"pair {images.pair_id}: a match lies outside the image")
                offer(m["pri"], part, by, bx)
    if moves:
        for pri, _, _, top, left, by, bx in _carried(images, was_y, was_x, plan.far(round_no), True):
            offer(pri, np.s_[top - images.y0 : top - images.y0 + by.shape[0], left - images.x0 : left - images.x0 + by.shape[1]], by, bx)
    drawn = any(m["pri"] == _DRAWN for m in messages)
    radii = list(enumerate(plan.radii(images.h, images.w))) if moves else []
    flat = lambda a: a.reshape(-1)
    was_y, was_x, score = flat(was_y), flat(was_x), flat(score)
    now_y, now_x = was_y.copy(), was_x.copy()
    given = [(flat(offers[k][0]), flat(offers[k][1])) for k in sorted(offers)]
    more = np.int32(1 if plan.closed else 0)
    for first in range(0, len(score), CHUNK):
        here = slice(first, min(first + CHUNK, len(score)))
        images.at(here.start, here.stop)
        best, best_y, best_x = score[here], now_y[here], now_x[here]

        def meet(by: np.ndarray, bx: np.ndarray, known: np.ndarray | None) -> None:
            s = images.scores(by, bx)
            better = s < best
            if known is not None:
                better &= known
            for held, new in ((best, s), (best_y, by), (best_x, bx)):
                np.copyto(held, new, where=better)

        for by, bx in given:
            known = by[here] >= 0
            if known.any():
                meet(np.maximum(by[here], 0), bx[here], None if known.all() else known)
        if drawn:
            key = _key(images.pair_id, images.ay, images.ax, 0)
            meet(_pick(0, images.h, _draw(key, SALT_Y)), _pick(0, images.w, _draw(key, SALT_X)), None)
        if radii and (known := was_y[here] >= 0).any():
            y, x = np.maximum(was_y[here], 0), was_x[here]
            key, known = _key(images.pair_id, images.ay, images.ax, round_no), None if known.all() else known
            for k, m in radii:
                salt, m = 2 * (k + 1), np.int32(m)
                meet(_pick(np.maximum(y - m, 0), np.minimum(y + m + more, images.h), _draw(key, salt + SALT_Y)),
                     _pick(np.maximum(x - m, 0), np.minimum(x + m + more, images.w), _draw(key, salt + SALT_X)), known)
    return now_y.reshape(shape), now_x.reshape(shape), score.reshape(shape)


def _message_schema(pair_type: pa.DataType) -> pa.Schema:
    whole = [(n, pa.int32()) for n in ("aty", "atx", "h", "w", "round", "pri", "top", "left", "rows", "columns")]
    return pa.schema([("pair_id", pair_type), *whole, ("by", pa.binary()), ("bx", pa.binary()), ("score", pa.binary())])


_MESSAGE_SQL = ("aty int, atx int, h int, w int, round int, pri int, top int, left int, rows int, columns int, "
                "by binary, bx binary, score binary")


def _field_schema(pair_type: pa.DataType, plan: Plan) -> pa.Schema:
    score = pa.float64() if plan.scale is None else pa.int64()
    return pa.schema([("pair_id", pair_type), *[(n, pa.int32()) for n in ("h", "w", "ay", "ax", "by", "bx")], ("score", score), ("round", pa.int32())])


def _round(plan: Plan, moves: bool, more: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a task does with the messages to a tile and the images beside it: the messages of the next round if
    ``more`` follow, else the rows of the field."""

    def run(messages: pa.Table, beside: pa.Table) -> pa.Table:
        pair_type = beside.schema.field("pair_id").type
        schema = _message_schema(pair_type) if more else _field_schema(pair_type, plan)
        if not messages.num_rows or not beside.num_rows:
            return schema.empty_table()
        images, made = _Images(beside, plan), []
        apart: dict[int, list[dict]] = {}
        for m in messages.to_pylist():
            apart.setdefault(m["round"], []).append(m)
        for before, held in apart.items():
            now = before + moves
            by, bx, score = _settle(images, held, now, moves)
            if more:
                out = [(_OWN, images.aty, images.atx, images.y0, images.x0, by, bx, score)]
                out += [(*m, None) for m in _carried(images, by, bx, plan.far(now + 1), False)]
                raw = lambda a: None if a is None else np.ascontiguousarray(a).tobytes()
                rows = [(images.pair_id, aty, atx, images.h, images.w, now, pri, top, left, *y.shape, raw(y), raw(x), raw(s))
                        for pri, aty, atx, top, left, y, x, s in out]
                made.append(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema))
            else:
                known = np.flatnonzero(by >= 0)
                n, y, x = len(known), known // images.bw + images.y0, known % images.bw + images.x0
                same = lambda value: np.full(n, value)
                columns = [same(images.pair_id), same(images.h), same(images.w), y, x, by.reshape(-1)[known],
                           bx.reshape(-1)[known], score.reshape(-1)[known], same(now)]
                made.append(pa.table([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, schema)], schema=schema))
        return pa.concat_tables(made)

    return run


def _packed_rows(plan: Plan, pair_type: pa.DataType) -> Callable[[pa.Table], pa.Table]:
    """Field rows of one tile as messages: a rectangle for each round, and one more for each time a pixel comes again."""
    schema = _message_schema(pair_type)

    def run(rows: pa.Table) -> pa.Table:
        pair_id, aty, atx = (rows.column(k)[0].as_py() for k in KEYS)
        h, w = rows.column("h")[0].as_py(), rows.column("w")[0].as_py()
        top, left = aty * plan.edge, atx * plan.edge
        bh, bw = min(plan.edge, h - top), min(plan.edge, w - left)
        ay, ax, by, bx, rounds = (rows.column(k).to_numpy() for k in ("ay", "ax", "by", "bx", "round"))
        if by.min() < 0 or bx.min() < 0:
            raise ValueError(f"pair {pair_id}: a match lies outside the image")
        out = []
        for number in np.unique(rounds):
            own = np.flatnonzero(rounds == number)
            place = (ay[own] - top).astype(np.int64) * bw + (ax[own] - left)
            order = np.lexsort((bx[own], by[own], place))
            own, place = own[order], place[order]
            fresh = np.r_[True, place[1:] != place[:-1]]
            again = np.arange(len(place)) - np.maximum.accumulate(np.where(fresh, np.arange(len(place)), 0))
            for k in range(int(again.max()) + 1):
                held_y, held_x, these = np.full(bh * bw, -1, np.int32), np.zeros(bh * bw, np.int32), again == k
                held_y[place[these]], held_x[place[these]] = by[own[these]], bx[own[these]]
                out.append((pair_id, aty, atx, h, w, int(number), -2 - k, top, left, bh, bw, held_y.tobytes(), held_x.tobytes(), None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def as_arrays(tiles: DataFrame, columns: list[str]) -> DataFrame:
    """Packed pixels as arrays of bytes, for SQL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in columns:
                held = [np.frombuffer(b.as_buffer(), np.int8) for b in batch.column(c)]
                ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                batch = batch.set_column(batch.schema.get_field_index(c), c, pa.ListArray.from_arrays(ends, np.concatenate(held or [np.zeros(0, np.int8)])))
            yield batch

    schema = ", ".join(f"{c} array<tinyint>" if c in columns else f"{c} {kind}" for c, kind in tiles.dtypes)
    return tiles.mapInArrow(run, schema)


def beside_tiles(tiled_a: DataFrame, tiled_b: DataFrame, plan: Plan, partitions: int) -> DataFrame:
    """Each tile (aty, atx) of A and, for each, all tiles of B; both images have one shape."""
    weights, pixels = [f"w_{f}" for f in plan.features], [f"p_{f}" for f in plan.features]
    held = ["pair_id", "ty", "tx", "h", "w", "y0", "x0", "bh", "bw", "stride", *weights]
    a = tiled_a.selectExpr("'a' as side", *held, *[f"pa_{f} as p_{f}" for f in plan.features])
    b = tiled_b.selectExpr("'b' as side", *held, *[f"pb_{f} as p_{f}" for f in plan.features])
    last = lambda size: f"cast(({size} - 1) div {plan.edge} as int)"
    every = a.unionByName(b).selectExpr(
        "*", f"explode(if(side = 'a', array(ty), sequence(0, {last('h')}))) as aty"
    ).selectExpr("*", f"explode(if(side = 'a', array(tx), sequence(0, {last('w')}))) as atx")
    return every.select(*KEYS, "side", *held[1:], *pixels).repartition(partitions, *KEYS)


def search(tiled_a: DataFrame, tiled_b: DataFrame, plan: Plan, partitions: int, rounds: int, given: DataFrame | None,
           checkpoint_every: int) -> DataFrame:
    """``(pair_id, h, w, ay, ax, by, bx, score, round)`` after ``rounds`` rounds from random matches or from a field."""
    pair_sql = dict(tiled_a.dtypes)["pair_id"]
    pair_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[pair_sql]
    message_sql = f"pair_id {pair_sql}, {_MESSAGE_SQL}"
    sizes = [f"cast({c} as {dict(tiled_a.dtypes)[c]}) as {c}" for c in ("h", "w")]
    field_sql = f"pair_id {pair_sql}, h int, w int, ay int, ax int, by int, bx int, score {'double' if plan.scale is None else 'bigint'}, round int"
    if given is None:
        state = tiled_a.selectExpr(
            "pair_id", "ty as aty", "tx as atx", "h", "w", "cast(round as int) as round", f"{_DRAWN} as pri",
            *[f"0 as {c}" for c in ("top", "left", "rows", "columns")], *[f"cast(null as binary) as {c}" for c in ("by", "bx", "score")],
        )
    else:
        whole = ["h", "w", "ay", "ax", "by", "bx", "round"]
        placed = given.selectExpr(f"cast(pair_id as {pair_sql}) as pair_id", f"cast(ay div {plan.edge} as int) as aty",
                                  f"cast(ax div {plan.edge} as int) as atx", *[f"cast({c} as int) as {c}" for c in whole])
        state = placed.groupBy(*KEYS).applyInArrow(_packed_rows(plan, pair_type), message_sql)
    beside = beside_tiles(tiled_a, tiled_b, plan, partitions).groupBy(*KEYS)
    for done in range(rounds + 1):
        more = done < rounds
        met = state.repartition(partitions, *KEYS).groupBy(*KEYS).cogroup(beside)
        state = met.applyInArrow(_round(plan, done > 0, more), message_sql if more else field_sql)
        if more and done and done % checkpoint_every == 0:
            state = cut_lineage(state)
    return state.selectExpr("pair_id", *sizes, "ay", "ax", "by", "bx", "score", "round")
