import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import PAIRS, PIXELS, image_rows, random_images
from nnfield.functions.coords import clamp_radius, radius_schedule
from nnfield.operators.apply import block_copy, gather, pair_blocks, upsample_field, visualize, window_average
from nnfield.operators.patches import patches
from nnfield.operators.resize import resize_bilinear
from nnfield.operators.validate import check_frame_counts, check_shapes, clip_violations, frame_gaps

# the hand-made image for border rules
RAMP = (np.arange(35).reshape(5, 7, 1) * 7) % 256
FIELDS = {
    "identity": lambda y, x: (y, x),
    "constant": lambda y, x: (2, 3),
    "mirrored": lambda y, x: (y, 6 - x),
}


def field_of(spark, rule, h=5, w=7):
    rows = [(0, h, w, y, x, *rule(y, x)) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "pair_id BIGINT, h INT, w INT, ay INT, ax INT, by INT, bx INT")


@pytest.mark.parametrize("rule", sorted(FIELDS))
@pytest.mark.parametrize("patch_size", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("edge", [64, 3])
def test_window_average_follows_the_border_rule(spark, rule, patch_size, edge):
    pixels = spark.createDataFrame(image_rows({9: RAMP}), PIXELS)
    pairs = spark.createDataFrame([(0, 9, None, 9, None, 5, 7, 1)], PAIRS)
    seen = gather(field_of(spark, FIELDS[rule]), pair_blocks(pairs, pixels, "b_img", edge), edge)
    picture = np.array([[RAMP[FIELDS[rule](y, x)][0] for x in range(7)] for y in range(5)], float)
    low, high = patch_size // 2, patch_size - 1 - patch_size // 2
    for border in ("clip", "edge", "reflect"):
        got = np.zeros((5, 7))
        for r in window_average(seen, patch_size, border, edge=edge).collect():
            got[r.y, r.x] = r.v[0]
        if border == "clip":
            r = patch_size // 2
            want = [[picture[max(0, y - r):y + r + 1, max(0, x - r):x + r + 1].mean() for x in range(7)] for y in range(5)]
        else:
            pad = np.pad(picture, ((low, high), (low, high)), mode=border)
            want = [[pad[y:y + patch_size, x:x + patch_size].mean() for x in range(7)] for y in range(5)]
        assert np.allclose(got, want), border


def test_window_average_of_three_channels(spark):
    image = random_images(1, 6, 5, 3)[0]
    seen = spark.createDataFrame(image_rows({0: image}), PIXELS).withColumnRenamed("image_id", "pair_id")
    for r in window_average(seen, 3, "clip", channels=3).collect():
        part = image[max(0, r.y - 1):r.y + 2, max(0, r.x - 1):r.x + 2].reshape(-1, 3)
        assert np.allclose(r.v, part.mean(axis=0))


@pytest.mark.parametrize("edge", [64, 4])
@pytest.mark.parametrize("patch_size", [8, 15, 31])
def test_wide_windows_of_several_channel_counts(spark, patch_size, edge):
    """Grey and RGB have code of their own, other counts the general one; blocks are narrower than the window."""
    low, high = patch_size // 2, patch_size - 1 - patch_size // 2
    images = {c: random_images(1, 9, 11, c, seed=c)[0] for c in (1, 2, 3)}
    seen = spark.createDataFrame(image_rows(images), PIXELS).withColumnRenamed("image_id", "pair_id")
    for border in ("clip", "edge"):
        got = {(r.pair_id, r.y, r.x): r.v for r in window_average(seen, patch_size, border, edge=edge).collect()}
        assert len(got) == 3 * 9 * 11
        for c, image in images.items():
            pad = np.pad(image, ((low, high), (low, high), (0, 0)), mode="edge")
            for y, x in ((0, 0), (4, 5), (8, 10), (0, 7), (8, 1)):
                part = image[max(0, y - low):y + low + 1, max(0, x - low):x + low + 1]
                part = part if border == "clip" else pad[y:y + patch_size, x:x + patch_size]
                assert np.allclose(got[c, y, x], part.reshape(-1, c).mean(axis=0)), (border, c, y, x)


def test_reflection_beyond_a_very_small_image(spark):
    image = np.array([[[1], [5]]])
    seen = spark.createDataFrame(image_rows({0: image}), PIXELS).withColumnRenamed("image_id", "pair_id")
    got = {r.x: r.v[0] for r in window_average(seen, 5, "reflect").collect()}
    row = [1, 5, 1, 5, 1, 5]
    assert got == {0: np.mean(row[0:5]), 1: np.mean(row[1:6])}


@pytest.mark.parametrize("edge", [64, 3])
def test_patches_hold_null_outside(spark, edge):
    pixels = spark.createDataFrame(image_rows({4: RAMP}), PIXELS)
    for r in patches(pixels, ["image_id"], 5, edge).collect():
        assert len(r.pv) == 25
        for k, entry in enumerate(r.pv):
            y, x = r.y + k // 5 - 2, r.x + k % 5 - 2
            inside = 0 <= y < 5 and 0 <= x < 7
            assert entry == ([int(RAMP[y, x, 0])] if inside else None)


@pytest.mark.parametrize("shape", [(5, 7), (11, 3), (2, 20), (1, 1)])
@pytest.mark.parametrize("edge", [64, 2])
def test_resize_interpolates_between_pixel_centres(spark, shape, edge):
    pixels = spark.createDataFrame(image_rows({4: RAMP}), PIXELS)
    got = {(r.y, r.x): r.v[0] for r in resize_bilinear(pixels, ["image_id"], *shape, edge=edge).collect()}
    assert len(got) == shape[0] * shape[1]
    for (oy, ox), v in got.items():
        sy = min(max((oy + 0.5) * 5 / shape[0] - 0.5, 0), 4)
        sx = min(max((ox + 0.5) * 7 / shape[1] - 0.5, 0), 6)
        y, x = int(sy), int(sx)
        y1, x1, fy, fx = min(y + 1, 4), min(x + 1, 6), sy - y, sx - x
        p = RAMP[..., 0]
        want = (1 - fy) * ((1 - fx) * p[y, x] + fx * p[y, x1]) + fy * ((1 - fx) * p[y1, x] + fx * p[y1, x1])
        assert v == pytest.approx(want)


@pytest.mark.parametrize("height,width", [(10, 14), (11, 15), (13, 12), (5, 7), (4, 7)])
def test_block_copy_of_images_at_a_larger_scale(spark, height, width):
    source = random_images(1, height, width, seed=5)[0] + 1
    pixels = spark.createDataFrame(image_rows({9: source}), PIXELS)
    pairs = spark.createDataFrame([(0, 9, None, 9, None, 5, 7, 1)], PAIRS)
    rule = lambda y, x: ((y * 3 + 1) % 5, (x * 2 + y) % 7)
    scale = height // 5
    # One formula per pixel: its cell is copied if the lengths of both cells agree on both axes, else it is 0.
    length = lambda size, cell: max(0, min(scale, size - cell * scale))

    def wanted(y, x):
        if not scale or y // scale >= 5 or x // scale >= 7:
            return 0
        by, bx = rule(y // scale, x // scale)
        alike = length(height, y // scale) == length(height, by) and length(width, x // scale) == length(width, bx)
        return source[by * scale + y % scale, bx * scale + x % scale, 0] if alike else 0

    want = np.array([[[wanted(y, x)] for x in range(width)] for y in range(height)])
    got = np.full_like(source, -1)
    for edge in (4, 64):
        rows = block_copy(field_of(spark, rule), pairs, pair_blocks(pairs, pixels, "b_img", edge), edge=edge).collect()
        assert len(rows) == height * width and len({(r.y, r.x) for r in rows}) == len(rows)
        for r in rows:
            got[r.y, r.x] = r.v
        assert (got == want).all()


def test_averages_take_the_channels_of_each_image(spark):
    pixels = [(0, 1, 3, 0, x, [9 * x, 100, 200]) for x in range(3)] + [(1, 1, 2, 0, x, [x]) for x in range(2)]
    gathered = spark.createDataFrame(pixels, "pair_id BIGINT, h INT, w INT, y INT, x INT, v ARRAY<INT>")
    got = {(r.pair_id, r.x): r.v for r in window_average(gathered, 3).collect()}
    assert got == {(0, 0): [4.5, 100, 200], (0, 1): [9, 100, 200], (0, 2): [13.5, 100, 200], (1, 0): [0.5], (1, 1): [0.5]}
    with pytest.raises(Exception, match="channels"):
        window_average(gathered, 3, channels=1).collect()


@pytest.mark.parametrize("size", [5, 10, 13, 16, 3])
def test_upsampled_field_repeats_and_fills_with_zero(spark, size):
    rule = lambda y, x: (4 - y, 6 - x)
    pairs = spark.createDataFrame([(0, 9, None, 9, None, 5, 7, 1)], PAIRS)
    rows = upsample_field(field_of(spark, rule), pairs, size).collect()
    ratio = size // 5
    assert len({(r.ay, r.ax) for r in rows}) == len(rows) == size * size
    for r in rows:
        covered = ratio and r.ay // ratio < 5 and r.ax // ratio < 7
        want = tuple(ratio * m for m in rule(r.ay // ratio, r.ax // ratio)) if covered else (0, 0)
        assert (r.by, r.bx) == want


def test_colours(spark):
    for r in visualize(field_of(spark, FIELDS["mirrored"])).collect():
        assert (r.r, r.g, r.b) == (int(255 * ((6 - r.x) / 7)), 0, int(255 * (r.y / 5)))


@pytest.mark.parametrize("asked,side,want", [(None, 9, [9, 4, 2, 1]), (200, 8, [8, 4, 2, 1]), (5, 8, [5, 2, 1]), (1, 8, [1]), (0, 8, [])])
def test_radius_schedule(spark, asked, side, want):
    given = "cast(null as int)" if asked is None else str(asked)
    top = clamp_radius(given, str(side), "3")
    assert spark.sql(f"select {radius_schedule(top)} as r").first().r == want


def test_shape_and_frame_violations(spark):
    images = spark.createDataFrame(
        [(0, 8, 8, 1), (1, 8, 7, 1), (2, 8, 8, 1)], "image_id BIGINT, height INT, width INT, channels INT"
    )
    pairs = spark.createDataFrame(
        [(0, 0, None, 2, None, 8, 8, 1), (1, 0, None, 1, None, 8, 8, 1), (2, 0, 0, 2, 77, 8, 8, 1)], PAIRS
    )
    assert sorted(r.pair_id for r in check_shapes(pairs, images).collect()) == [1, 2]
    frames = [(c, role, n) for c in (0, 1) for role in ("a", "b", "a_prime") for n in range(4)]
    clips = spark.createDataFrame(frames, "clip_id BIGINT, role STRING, frame_no INT")
    masks = spark.createDataFrame([(c, n) for c in (0, 1) for n in range(4 - c)], "clip_id BIGINT, frame_no INT")
    assert check_frame_counts(clips).isEmpty()
    assert [r.clip_id for r in check_frame_counts(clips, masks).collect()] == [1]
    assert [r.clip_id for r in check_frame_counts(clips.where("clip_id = 0 or role <> 'b'")).collect()] == [1]


def test_frame_sets_not_only_counts_are_compared(spark):
    import datetime as dt

    ts = lambda n: dt.datetime(2024, 1, 1, 0, 0, n)
    rows = [(c, role, n, ts(n)) for c in range(4) for role in ("a", "b", "a_prime") for n in range(4)]
    clips = spark.createDataFrame(rows, "clip_id BIGINT, role STRING, frame_no INT, ts TIMESTAMP")
    masks = [(c, n + (c == 1), ts(n + (c == 1) + 9 * (c == 2 and n == 3))) for c in range(4) for n in range(4)]
    masks = spark.createDataFrame(masks, "clip_id BIGINT, frame_no INT, ts TIMESTAMP")
    assert check_frame_counts(clips, masks).isEmpty()
    got = {(r.clip_id, r.frame_no): (r.missing, r.unlike_ts) for r in frame_gaps(clips, masks).collect()}
    assert got == {(1, 0): ("mask", False), (1, 4): ("a,a_prime,b", False), (2, 3): ("", True)}
    assert {tuple(r) for r in clip_violations(clips, masks).collect()} == {(1, 2, 0, "mask"), (2, 1, 3, "ts")}
    assert frame_gaps(clips).isEmpty() and frame_gaps(clips.limit(0), masks.limit(0)).isEmpty()


@pytest.mark.parametrize("border", ["clip", "edge", "reflect"])
def test_positions_a_border_repeats_are_found_beyond_the_edges_alone(spark, border):
    from nnfield.functions.coords import images_of

    rows = [(at, size) for size in range(1, 7) for at in range(-2, size + 2)]
    frame = spark.createDataFrame(rows, "at INT, size INT")

    def source(p, size):
        if border != "reflect":
            return max(min(p, size - 1), 0)
        period = max(2 * (size - 1), 1)
        return 0 if size == 1 else min(p % period, period - p % period)

    for reach in (1, 2, 9):
        text = images_of("at", "size", reach, border)
        for r in frame.selectExpr("at", "size", f"{text} as found").collect():
            assert r.found == [p for p in range(-reach, r.size + reach) if source(p, r.size) == r.at]
        assert "sequence(-" not in text or f"{reach}, size" not in text  # no walk over the whole axis
