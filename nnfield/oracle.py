"""Plain SQL with the meaning of every query, for DuckDB over the same Parquet tables.

Written from the definitions alone: patches are sums over joined pixels, not packed arrays, and
every field round is a chain of common table expressions.
"""

from __future__ import annotations

from nnfield.functions.draws import KEY_WEIGHTS, MASK, MIX_LAST, MIX_STEPS, PAIR_BITS

IMAGES = """px as materialized (
  select vec_id img, cast(p // 8 as int) y, cast(p % 8 as int) x,
         cast(floor((cast(embedding[p + 1] as double) + 1) * 127.5) as int) v
  from embeddings, range(64) r(p))"""

EVENTS = """ev as materialized (
  select cast(event_id // 50 as int) y, cast(event_id % 50 as int) x, cast(user_id % 256 as int) v0,
         cast(least(floor(value), 255) as int) v1, cast(length(event_type) * 20 as int) v2,
         cast((select (max(event_id) + 50) // 50 from events) as int) h
  from events),
epx as materialized (
  select cast(0 as bigint) img, y, x, v0, v1, v2 from ev
  union all
  select 1, cast((y - 3 + h) % h as int), cast((x - 5 + 50) % 50 as int), v0, v1, v2 from ev)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes)


def pairs_cte(mode: str) -> str:
    step, roles = {
        "single": (2, "k * 2 a, k * 2 + 1 b, cast(null as bigint) aa, cast(null as bigint) bb, cast(null as bigint) prime"),
        "double": (4, "k * 4 a, k * 4 + 2 b, k * 4 + 1 aa, k * 4 + 3 bb, cast(null as bigint) prime"),
        "analogy": (4, "k * 4 a, k * 4 + 1 b, k * 4 aa, k * 4 + 1 bb, k * 4 + 2 prime"),
    }[mode]
    return f"""prs as materialized (
  select k pair_id, {roles}, 8 h, 8 w from (select distinct vec_id // {step} k from embeddings))"""


def draw(pair: str, y: str, x: str, round_no: str, salt: str) -> str:
    """One draw, each mixing step written as a nested lambda-free expression over a subquery."""
    p, q, r, s, t = KEY_WEIGHTS
    key = (
        f"(((cast({pair} as bigint) & {PAIR_BITS}) * {p} + cast({y} as bigint) * {q} + cast({x} as bigint) * {r}"
        f" + cast({round_no} as bigint) * {s} + cast({salt} as bigint) * {t}) & {MASK})"
    )
    (b1, m1), (b2, m2) = MIX_STEPS
    one = f"((xor({key}, {key} >> {b1}) * {m1}) & {MASK})"
    two = f"((xor({one}, {one} >> {b2}) * {m2}) & {MASK})"
    return f"xor({two}, {two} >> {MIX_LAST})"


def start_cte(name: str = "n0", grid: str | None = None) -> str:
    grid = grid or "(select pair_id, h, w, cast(p // w as int) ay, cast(p % w as int) ax from prs, range(64) g(p))"
    return f"""{name} as materialized (
  select pair_id, h, w, ay, ax, cast({draw('pair_id', 'ay', 'ax', '0', '0')} % h as int) by_,
         cast({draw('pair_id', 'ay', 'ax', '0', '1')} % w as int) bx_
  from {grid})"""


def scored_cte(name: str, source: str, extra: str = "", patch: int = 3, pixels: str = "px",
               values: tuple[str, ...] = ("v",), double: bool = False) -> str:
    """Distance of every row of ``source``: sum of squares over the clipped window by pixel count."""
    r = patch // 2
    square = lambda p, q: " + ".join(f"({p}.{v} - {q}.{v}) * ({p}.{v} - {q}.{v})" for v in values)
    total, aux_join = square("a", "q"), ""
    if double:
        total += " + " + square("c", "d")
        aux_join = f"""
    join {pixels} c on c.img = s.aa and c.y = s.y1 and c.x = s.x1
    join {pixels} d on d.img = s.bb and d.y = s.y2 and d.x = s.x2"""
    return f"""{name}_at as materialized (
  select s.*, z.a, z.b, z.aa, z.bb, cast(ay + dy as int) y1, cast(ax + dx as int) x1,
         cast(by_ + dy as int) y2, cast(bx_ + dx as int) x2
  from {source} s join prs z on z.pair_id = s.pair_id, range(-{r}, {r + 1}) oy(dy), range(-{r}, {r + 1}) ox(dx)),
{name} as materialized (
  select s.pair_id, s.h, s.w, s.ay, s.ax, s.by_, s.bx_{extra},
         cast(sum({total}) as double) / cast(count(*) as double) d
  from {name}_at s
    join {pixels} a on a.img = s.a and a.y = s.y1 and a.x = s.x1
    join {pixels} q on q.img = s.b and q.y = s.y2 and q.x = s.x2{aux_join}
  group by all)"""


def random_rows(source: str, round_no: int, closed: bool, radius: str = "greatest(h, w)") -> str:
    extra = " + 1" if closed else ""
    low = lambda b: f"greatest({b} - mag, 0)"
    high = lambda b, n: f"least({b} + mag{extra}, {n})"
    uy, ux = (draw("pair_id", "ay", "ax", str(round_no), f"(2 * (k + 1) + {axis})") for axis in (0, 1))
    return f"""select pair_id, h, w, ay, ax,
      cast({low('by_')} + {uy} % ({high('by_', 'h')} - {low('by_')}) as int) by_,
      cast({low('bx_')} + {ux} % ({high('bx_', 'w')} - {low('bx_')}) as int) bx_, cast(5 + k as int) pri
    from (select *, {radius} >> k mag from {source}, range(0, 31) radii(k)) where mag >= 1"""


def moved_rows(source: str, moves: list[tuple[int, int, int]]) -> str:
    rows = ", ".join(f"({p}, {dy}, {dx})" for p, dy, dx in moves)
    return f"""select pair_id, h, w, ay + my ay, ax + mx ax, by_ + my by_, bx_ + mx bx_, pri
    from {source}, (values {rows}) m(pri, my, mx)
    where ay + my between 0 and h - 1 and ax + mx between 0 and w - 1
      and by_ + my between 0 and h - 1 and bx_ + mx between 0 and w - 1"""


def moves_of(kind: str, round_no: int) -> list[tuple[int, int, int]]:
    if kind == "jump":
        j = (8, 4, 2, 1)[(round_no - 1) % 4]
        return [(1, j, 0), (2, -j, 0), (3, 0, j), (4, 0, -j)]
    way = 1 if round_no % 2 == 1 else -1
    return [(1, 0, way), (2, way, 0)]


def round_ctes(n: int, kind: str, closed: bool, **score) -> list[str]:
    """Round n: candidates c_n, their distances e_n, the best of them and the incumbents s_n."""
    before = f"s{n - 1}"
    return [
        f"""c{n} as materialized (
  {moved_rows(before, moves_of(kind, n))}
  union all
  {random_rows(before, n, closed)})""",
        scored_cte(f"e{n}", f"(select distinct pair_id, h, w, ay, ax, by_, bx_ from c{n})", **score),
        f"""s{n} as materialized (
  select pair_id, h, w, ay, ax, m.by_, m.bx_, m.d from (
    select pair_id, h, w, ay, ax, min(struct_pack(d := d, pri := pri, by_ := by_, bx_ := bx_)) m from (
      select c.pair_id, c.h, c.w, c.ay, c.ax, e.d, c.pri, c.by_, c.bx_ from c{n} c
        join e{n} e using (pair_id, ay, ax, by_, bx_)
      union all
      select pair_id, h, w, ay, ax, d, 0, by_, bx_ from {before}) group by all))""",
    ]


def rounds(count: int, kind: str = "jump", closed: bool = True, grid: str | None = None, **score) -> list[str]:
    ctes = [start_cte(grid=grid), scored_cte("s0", "n0", **score)]
    for n in range(1, count + 1):
        ctes += round_ctes(n, kind, closed, **score)
    return ctes


FIELD = "pair_id, ay, ax, by_ \"by\", bx_ bx, d"


def field_sql(mode: str, count: int, kind: str = "jump", closed: bool = True) -> str:
    double = mode != "single"
    ctes = rounds(count, kind, closed, double=double)
    return f"{with_(IMAGES, pairs_cte(mode), *ctes)}\nselect {FIELD} from s{count}"


# The event images make one pair with 3 channels.
EVENT_PAIR = """prs as materialized (
  select 0 pair_id, 0 a, 1 b, cast(null as bigint) aa, cast(null as bigint) bb, max(h) h, 50 w from ev)"""
EVENT_GRID = "(select 0 pair_id, h, 50 w, y ay, x ax from ev)"

EVENT_TRUTH = """id as (
  select 0 pair_id, h, 50 w, y ay, x ax, cast((y - 3 + h) % h as int) by_, cast((x - 5 + 50) % 50 as int) bx_ from ev)"""

CLIPS = """fr as materialized (
  select img // 25 // 4 clip_id, ['a', 'b', 'a_prime', 'mask'][img // 25 % 4 + 1] role,
         cast(img % 25 as int) frame_no, y, x, v,
         epoch_ms(timestamp '2024-01-01 00:00:00') + 40 * (img % 25) ts_ms
  from px)"""
# Field of frame 0: the grid is that of b, matches lie in a; both modes of the second image repeat the first.
CLIP_PAIRS = """prs as materialized (
  select distinct img // 100 pair_id, img // 100 * 100 + 25 a, img // 100 * 100 b,
         img // 100 * 100 + 25 aa, img // 100 * 100 bb, 8 h, 8 w from px)"""


_SEEN = """warped as (
  select f.clip_id, f.frame_no, f.ts_ms, s.ay y, s.ax x, f.v from s{n} s
    join fr f on f.clip_id = s.pair_id and f.role = 'a_prime' and f.y = s.by_ and f.x = s.bx_)"""


def warp_ctes(count: int) -> list[str]:
    return [IMAGES, CLIPS, CLIP_PAIRS, *rounds(count, double=True), _SEEN.format(n=count)]


def window_average_sql(patch: int, border: str) -> str:
    """Mean of the gathered image under a border rule."""
    low, high = -(patch // 2), patch - patch // 2
    if border == "clip":
        high = patch // 2 + 1
    near = {
        "clip": ("c.y + dy", "c.x + dx"),
        "edge": ("greatest(least(c.y + dy, 7), 0)", "greatest(least(c.x + dx, 7), 0)"),
        "reflect": ("7 - abs(7 - abs(c.y + dy))", "7 - abs(7 - abs(c.x + dx))"),
    }[border]
    return f"""{with_(IMAGES, pairs_cte('analogy'), *rounds(1, double=True), GATHERED.format(n=1))}
select c.pair_id, c.y, c.x, cast(sum(q.v) as double) / cast(count(*) as double) v
from g c cross join range({low}, {high}) oy(dy) cross join range({low}, {high}) ox(dx)
  join g q on q.pair_id = c.pair_id and q.y = {near[0]} and q.x = {near[1]}
group by all"""


GATHERED = """g as materialized (
  select s.pair_id, s.ay y, s.ax x, p.v from s{n} s join prs z using (pair_id)
    join px p on p.img = z.prime and p.y = s.by_ and p.x = s.bx_)"""


def resize_sql(height: int, width: int) -> str:
    return f"""{with_(IMAGES)},
sizes as (select distinct img from px),
grid as (
  select img, cast(oy as int) y, cast(ox as int) x,
         greatest(least((oy + 0.5::double) * (8::double / {float(height)}::double) - 0.5::double, 7::double), 0::double) sy,
         greatest(least((ox + 0.5::double) * (8::double / {float(width)}::double) - 0.5::double, 7::double), 0::double) sx
  from sizes, range({height}) a(oy), range({width}) b(ox)),
cut as (select *, cast(floor(sy) as int) iy, cast(floor(sx) as int) ix, sy - floor(sy) fy, sx - floor(sx) fx from grid)
select c.img image_id, c.y, c.x,
  (1::double - fy) * ((1::double - fx) * p00.v + fx * p01.v) + fy * ((1::double - fx) * p10.v + fx * p11.v) v
from cut c
  join px p00 on p00.img = c.img and p00.y = iy and p00.x = ix
  join px p01 on p01.img = c.img and p01.y = iy and p01.x = least(ix + 1, 7)
  join px p10 on p10.img = c.img and p10.y = least(iy + 1, 7) and p10.x = ix
  join px p11 on p11.img = c.img and p11.y = least(iy + 1, 7) and p11.x = least(ix + 1, 7)"""


def _field_ctes(mode: str, count: int, **more) -> str:
    return with_(IMAGES, pairs_cte(mode), *rounds(count, double=mode != "single", **more))


def _distance_sql(mode: str, patch: int = 3) -> str:
    grid = "id as (select pair_id, h, w, a.y ay, a.x ax, 7 - a.y by_, a.x bx_ from prs join px a on a.img = prs.a)"
    scored = scored_cte("sc", "id", patch=patch, double=mode != "single")
    return f"{with_(IMAGES, pairs_cte(mode), grid, scored)}\nselect {FIELD} from sc"


def _candidates_sql(rows: str) -> str:
    return f"""{with_(IMAGES, pairs_cte('single'), start_cte())}
select pair_id, ay, ax, by_ "by", bx_ bx, pri from ({rows})"""


_WARPED = 'select clip_id, frame_no, ts_ms, y, x, v from warped'
_BLEND_CTE = """masked as (
  select w.clip_id, w.frame_no, w.ts_ms, w.y, w.x,
         cast(m.m as double) * cast(w.v as double) + (1::double - cast(m.m as double)) * cast(b.v as double) v
  from warped w
    join (select *, case when v > 128 then 1 else 0 end m from fr where role = 'mask') m
      using (clip_id, frame_no, ts_ms, y, x)
    join (select clip_id, y, x, v from fr where role = 'a_prime' and frame_no = 0) b using (clip_id, y, x))"""
_MASKED = f"{with_(*warp_ctes(2), _BLEND_CTE)}\nselect clip_id, frame_no, ts_ms, y, x, v from masked"
_MASKED_LONG = _MASKED.replace("40 * (img % 25)", "1000 * (img % 25)")
_ROLES = """select pair_id, role, image_id, p.y, p.x, p.v from (
    select pair_id, 'a' role, a image_id from prs union all select pair_id, 'aa', aa from prs
    union all select pair_id, 'b', b from prs union all select pair_id, 'bb', bb from prs) r
  join px p on p.img = r.image_id"""
_COPY = f"""{_field_ctes('analogy', 1)},
large as materialized (select image_id, y, x, cast(floor(v) as int) v from ({resize_sql(19, 17)})),
grid as (select pair_id, prime, cast(ty as int) y, cast(tx as int) x from prs, range(19) a(ty), range(17) b(tx))
select g.pair_id, g.y, g.x, coalesce(l.v, 0) v from grid g
  left join s1 s on s.pair_id = g.pair_id and s.ay = g.y // 2 and s.ax = g.x // 2
  left join large l on l.image_id = g.prime and l.y = s.by_ * 2 + g.y % 2 and l.x = s.bx_ * 2 + g.x % 2"""

# A pair with an image of 7 lines is unlike itself, one with a missing image lacks it.
_VIOLATIONS = f"""{_field_ctes('double', 1)},
bad as (
  select pair_id, case when bool_or(i % 22 = 9) then 'missing image' else 'unequal shapes' end reason
  from (select pair_id, unnest([a, aa, b, bb]) i from prs) group by pair_id having bool_or(i % 22 = 9 or i % 10 = 7))
select pair_id, ay, ax, by_ "by", bx_ bx, d, cast(null as varchar) reason from s1 where pair_id not in (select pair_id from bad)
union all select pair_id, null, null, null, null, null, reason from bad"""

_RGB = ("v0", "v1", "v2")
_EVENT_ROUNDS = lambda n: rounds(n, grid=EVENT_GRID, pixels="epx", values=_RGB)


def _event_gather(n: int, image: int, source: str | None = None) -> str:
    at = "greatest(least(s.by_, h - 1), 0)", "greatest(least(s.bx_, 49), 0)"
    return f"""eg as materialized (
  select cast(0 as bigint) pair_id, s.h, s.ay y, s.ax x, p.v0, p.v1, p.v2 from {source or f's{n}'} s
    join epx p on p.img = {image} and p.y = {at[0]} and p.x = {at[1]})"""


def _event_average(border: str) -> str:
    near = {
        "clip": ("c.y + dy", "c.x + dx"),
        "edge": ("greatest(least(c.y + dy, c.h - 1), 0)", "greatest(least(c.x + dx, 49), 0)"),
        "reflect": ("c.h - 1 - abs(c.h - 1 - abs(c.y + dy))", "49 - abs(49 - abs(c.x + dx))"),
    }[border]
    means = ", ".join(f"cast(sum(q.{v}) as double) / cast(count(*) as double) {v}" for v in _RGB)
    return f"""{with_(EVENTS, EVENT_PAIR, *_EVENT_ROUNDS(1), _event_gather(1, 1))}
select c.pair_id, c.y, c.x, {means} from eg c cross join range(-1, 2) oy(dy) cross join range(-1, 2) ox(dx)
  join eg q on q.y = {near[0]} and q.x = {near[1]} group by c.pair_id, c.y, c.x"""


_SHOWN_RGB = "select pair_id, y, x, v0, v1, v2 from eg"
_OUTSIDE = "far as (select h, y ay, x ax, 2 * y - h // 2 by_, 2 * x - 25 bx_ from ev)"
_COPY_RGB = f"""{with_(EVENTS)},
cell as (select h, y, x, (7 * y + x) % h sy, (3 * x + y) % 50 sx from ev)
select cast(0 as bigint) pair_id, cast(2 * c.y + dy as int) y, cast(2 * c.x + dx as int) x,
       {', '.join(f'cast((p.{v} + 2 * dy + dx) % 256 as int) {v}' for v in _RGB)}
from cell c join epx p on p.img = 1 and p.y = c.sy and p.x = c.sx, range(2) a(dy), range(2) b(dx)"""

ORACLE = {
    "pixels": f"{with_(IMAGES)}\nselect img image_id, y, x, v from px",
    "event_image": f"{with_(EVENTS)}\nselect img image_id, y, x, v0, v1, v2 from epx",
    "image_files": f"{with_(IMAGES)}\nselect img image_id, y, x, v from px",
    "image_table": f"{with_(IMAGES, pairs_cte('double'))}\n{_ROLES}",
    "frames": f"""{with_(IMAGES)}
select img // 25 video_id, cast(img % 25 as int) frame_no,
       epoch_ms(timestamp '2024-01-01 00:00:00') + 40 * (img % 25) ts_ms, y, x, v from px""",
    "bind_roles": f"{with_(IMAGES, pairs_cte('double'))}\n{_ROLES}",
    "normalize_roundtrip": f"""{with_(IMAGES)}
select img image_id, y, x, cast(cast(v / 255.0::double as float) as double) unit,
       cast(floor(cast(v / 255.0::double as float) * cast(255 as float)) as int) v from px""",
    "swap_channels": f"{with_(EVENTS)}\nselect img image_id, y, x, v2 v0, v1, v0 v2 from epx",
    "resize_bilinear_up": resize_sql(12, 12),
    "resize_bilinear_down": resize_sql(5, 3),
    "check_shapes": f"""{with_(IMAGES, pairs_cte('double'))},
im as (select vec_id image_id, 8 height, case when vec_id % 10 = 7 then 7 else 8 end width, 1 channels from embeddings),
r as (select pair_id, unnest([a, aa, b, bb]) image_id from prs)
select pair_id, 4 wanted, cast(count(*) as int) images, min(height) min_height, max(height) max_height,
       min(width) min_width, max(width) max_width, min(channels) min_channels, max(channels) max_channels
from r join im using (image_id) group by pair_id having min(width) <> max(width)""",
    "check_frame_counts": f"""{with_(IMAGES, CLIPS)},
used as (select clip_id, role, frame_no from fr where not (role = 'mask' and clip_id % 2 = 1 and frame_no = 24)),
per as (select clip_id, role, cast(count(distinct frame_no) as int) n from used group by all)
select clip_id, cast(count(*) as int) roles, min(n) min_frames, max(n) max_frames from per
group by clip_id having min(n) <> max(n) or count(*) < 4""",
    "frame_gaps": f"""{with_(IMAGES, CLIPS)},
used as (select distinct clip_id, role, case when role = 'mask' and clip_id % 2 = 1 then frame_no + 1 else frame_no end frame_no,
           case when role = 'mask' and clip_id % 2 = 0 and frame_no = 7 then ts_ms + 1 else ts_ms end ts_ms from fr),
per as (select clip_id, frame_no,
          concat_ws(',', case when not bool_or(role = 'a') then 'a' end, case when not bool_or(role = 'a_prime') then 'a_prime' end,
                    case when not bool_or(role = 'b') then 'b' end, case when not bool_or(role = 'mask') then 'mask' end) missing,
          coalesce(max(ts_ms) filter (role = 'a_prime') <> max(ts_ms) filter (role = 'mask'), false) unlike_ts
        from used group by all)
select clip_id, cast(frame_no as int) frame_no, missing, unlike_ts from per where missing <> '' or unlike_ts""",
    "frames_from_files_stream": f"{with_(IMAGES, CLIPS)}\nselect clip_id, role, frame_no, ts_ms, y, x, v from fr",
    "patches": f"""{with_(IMAGES)}
select c.img image_id, c.y, c.x, cast((dy + 1) * 3 + dx + 1 as int) k, p.v
from px c cross join range(-1, 2) oy(dy) cross join range(-1, 2) ox(dx)
  left join px p on p.img = c.img and p.y = c.y + dy and p.x = c.x + dx""",
    "radius_schedule": f"""{with_(IMAGES, pairs_cte('single'))},
t as (select pair_id, case when pair_id % 3 > 0 then least(cast(pair_id % 13 as int), 8) else 8 end top from prs)
select pair_id, cast(k as int) k, top >> cast(k as int) radius from t, range(0, 31) r(k) where top >> cast(k as int) >= 1""",
    "field_init": field_sql("single", 0),
    "patch_distance_single": _distance_sql("single"),
    "patch_distance_double": _distance_sql("double"),
    "patch_distance_wide": _distance_sql("double", 5),
    "patch_distance_planted": f"""{with_(EVENTS, EVENT_PAIR, EVENT_TRUTH, scored_cte('sc', 'id', pixels='epx', values=('v0', 'v1', 'v2')))}
select cast(pair_id as bigint) pair_id, ay, ax, by_ "by", bx_ bx, d from sc""",
    "neighbour_candidates": _candidates_sql(moved_rows("n0", [(1, 2, 0), (2, -2, 0), (3, 0, 2), (4, 0, -2)])),
    "random_candidates_closed": _candidates_sql(random_rows("n0", 1, True)),
    "random_candidates_half_open": _candidates_sql(random_rows("n0", 1, False)),
    "best_candidate": f"""{with_(
    IMAGES, pairs_cte('single'), start_cte(),
    f"c as ({moved_rows('n0', [(1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1)])})", scored_cte('e', 'c', ', s.pri'))}
select pair_id, ay, ax, m.by_ "by", m.bx_ bx, m.d from (
  select pair_id, ay, ax, min(struct_pack(d := d, pri := pri, by_ := by_, bx_ := bx_)) m from e group by all)""",
    "field_jump_2rounds": field_sql("single", 2),
    "field_scan_2rounds": field_sql("single", 2, "scan", False),
    "field_double_2rounds": field_sql("double", 2),
    "field_large_image": f"""{with_(
    EVENTS, EVENT_PAIR, *rounds(2, grid=EVENT_GRID, pixels='epx', values=('v0', 'v1', 'v2')))}
select cast(pair_id as bigint) pair_id, ay, ax, by_ "by", bx_ bx, d from s2""",
    "field_full": field_sql("single", 40),
    "field_resume": field_sql("single", 2),
    "gather": f"{_field_ctes('analogy', 1)},\n{GATHERED.format(n=1)}\nselect pair_id, y, x, v from g",
    "window_average_clip": window_average_sql(3, "clip"),
    "window_average_clip_even": window_average_sql(4, "clip"),
    "window_average_edge": window_average_sql(3, "edge"),
    "window_average_edge_even": window_average_sql(4, "edge"),
    "window_average_reflect": window_average_sql(3, "reflect"),
    "window_average_reflect_even": window_average_sql(4, "reflect"),
    "window_average_clip_15": window_average_sql(15, "clip"),
    "window_average_edge_31": window_average_sql(31, "edge"),
    "window_average_reflect_15": window_average_sql(15, "reflect"),
    "block_copy": _COPY,
    "upsample_field": f"""{_field_ctes('single', 1)},
grid as (select pair_id, cast(ty as int) ay, cast(tx as int) ax from prs, range(21) a(ty), range(21) b(tx))
select g.pair_id, g.ay, g.ax, coalesce(s.by_ * 2, 0) "by", coalesce(s.bx_ * 2, 0) bx from grid g
  left join s1 s on s.pair_id = g.pair_id and s.ay = g.ay // 2 and s.ax = g.ax // 2""",
    "visualize": f"""{_field_ctes('single', 1)}
select pair_id, ay y, ax x, cast(floor(255 * (bx_ / w)) as int) r, 0 g, cast(floor(255 * (by_ / h)) as int) b from s1""",
    "analogy_2rounds": f"{_field_ctes('analogy', 2)},\n{GATHERED.format(n=2)}\nselect pair_id, y, x, v from g",
    "gather_rgb": f"{with_(EVENTS, EVENT_PAIR, *_EVENT_ROUNDS(1), _event_gather(1, 1))}\n{_SHOWN_RGB}",
    "gather_outside": f"{with_(EVENTS, _OUTSIDE, _event_gather(1, 1, 'far'))}\n{_SHOWN_RGB}",
    "window_average_clip_rgb": _event_average("clip"),
    "window_average_edge_rgb": _event_average("edge"),
    "window_average_reflect_rgb": _event_average("reflect"),
    "block_copy_rgb": _COPY_RGB,
    "analogy_rgb": f"{with_(EVENTS, EVENT_PAIR, *_EVENT_ROUNDS(2), _event_gather(2, 0))}\n{_SHOWN_RGB}",
    "analogy_files": f"{_field_ctes('analogy', 2)},\n{GATHERED.format(n=2)}\nselect pair_id, y, x, cast(floor(cast(v / 255.0::double as float) * cast(255 as float)) as int) v from g",
    "image_files_rgb": f"{with_(EVENTS)}\nselect img image_id, y, x, v0, v1, v2 from epx",
    "warp_stream": f"{with_(*warp_ctes(2))}\n{_WARPED}",
    "warp_stream_masked": _MASKED,
    "warp_new_videos": f"{with_(*warp_ctes(2))}\n{_WARPED}",
    "warp_stream_masked_long": _MASKED_LONG,
    "warp_new_videos_late_start": _MASKED,
    "warp_batch_masked": _MASKED,
    "warp_batch_single": f"{with_(IMAGES, CLIPS, CLIP_PAIRS, *rounds(2, double=False), _SEEN.format(n=2))}\n{_WARPED}",
    "field_with_violations": _VIOLATIONS,
}
