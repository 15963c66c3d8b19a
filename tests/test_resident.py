"""The search in numpy where image B stands beside each tile of A, against the SQL rounds of the whole layout."""

import dataclasses

import numpy as np
import pytest

from helpers import PAIRS, PIXELS, brute_distance, image_rows, random_images
from nnfield.operators import search
from nnfield.operators.search import SearchOptions, bind_pairs, search_rounds


class Unscaled(SearchOptions):
    @property
    def scale(self):
        return None


def tables(spark, height, width, channels=1, second=False, values=None):
    images = random_images(4, height, width, channels)
    if values is not None:
        images = {i: a % values for i, a in images.items()}
    pixels = spark.createDataFrame(image_rows(images), PIXELS)
    pairs = spark.createDataFrame([(3, 0, 1 if second else None, 2, 3 if second else None, height, width, channels)], PAIRS)
    return images, pixels, pairs


def rows_of(field):
    return sorted(tuple(r) for r in field.select("pair_id", "h", "w", "ay", "ax", "by", "bx", "d", "round").collect())


def both(spark, monkeypatch, pixels, pairs, options, rounds, copies=20):
    monkeypatch.setattr(search, "COPIES", copies)
    copied = dataclasses.replace(options, whole_edge=4, tile_edge=4, copy_pixels=1, rounds_per_checkpoint=2)
    bound = bind_pairs(pairs, pixels, copied)
    assert bound.copied
    return rows_of(search_rounds(bind_pairs(pairs, pixels, options), options, rounds)), rows_of(search_rounds(bound, copied, rounds))


@pytest.mark.parametrize("options,size,values", [
    (SearchOptions(jumps=(11, 1)), (14, 11), None),  # moves go beyond the next tile
    (SearchOptions(patch_size=5, radius=3, random="half_open"), (17, 3), 2),  # all windows are clipped, many equal scores
    (Unscaled(channels=2, propagation="scan"), (9, 13), None),
    (SearchOptions(channels=5), (13, 6), None),  # eight bytes a pixel
    (SearchOptions(channels=9), (9, 6), None),  # more than a word a pixel
    (SearchOptions(patch_size=1, radius=0), (12, 5), 3),
])
def test_numpy_and_sql_give_the_same_field(spark, monkeypatch, options, size, values):
    _, pixels, pairs = tables(spark, *size, options.channels, values=values)
    expected, made = both(spark, monkeypatch, pixels, pairs, options, 3)
    assert made == expected and len(made) == size[0] * size[1]


def test_chunks_of_a_tile_give_the_same_field(spark, monkeypatch):
    images, pixels, pairs = tables(spark, 13, 9, 3, second=True)
    options = SearchOptions(channels=3)
    expected, made = both(spark, monkeypatch, pixels, pairs, options, 1)
    assert made == expected
    for _, _, _, ay, ax, by, bx, d, _ in made:
        assert d == brute_distance([(images[0], images[2]), (images[1], images[3])], ay, ax, by, bx, 3)


def test_a_field_with_gaps_and_repeated_pixels_goes_on_as_in_sql(spark, monkeypatch):
    _, pixels, pairs = tables(spark, 13, 9)
    given = pixels.where("image_id = 0 and (y + x) % 3 > 0").selectExpr(
        "3L as pair_id", "h", "w", "y as ay", "x as ax", "12 - y as by", "8 - x as bx", "explode(array(0, 1)) as again", "5 as round")
    given = given.where("again = 0 or x = 4").selectExpr("*", "if(again = 1, 0, by) as b").drop("by", "again").withColumnRenamed("b", "by")
    monkeypatch.setattr(search, "COPIES", 20)
    tiled, fields = SearchOptions(whole_edge=4, tile_edge=4), []
    for options in (tiled, dataclasses.replace(tiled, copy_pixels=1)):
        for rounds in (0, 2):
            fields.append(rows_of(search_rounds(bind_pairs(pairs, pixels, options), options, rounds, start=given.where("x != 4") if rounds == 0 else given)))
    assert fields[0] == fields[2]
    assert {r[-1] for r in fields[3]} == {7}
    assert fields[1] == fields[3]


def test_matches_outside_the_image_are_an_error(spark):
    _, pixels, pairs = tables(spark, 9, 9)
    options = SearchOptions(whole_edge=4, tile_edge=4, copy_pixels=1)
    given = pixels.where("image_id = 0").selectExpr("3L as pair_id", "h", "w", "y as ay", "x as ax", "y + 1 as by", "x as bx", "0 as round")
    with pytest.raises(Exception, match="outside the image"):
        search_rounds(bind_pairs(pairs, pixels, options), options, 1, start=given).collect()


def test_a_copied_round_makes_no_row_for_a_candidate(spark):
    _, pixels, pairs = tables(spark, 13, 9)
    options = SearchOptions(whole_edge=4, tile_edge=4, copy_pixels=1)
    plan = search_rounds(bind_pairs(pairs, pixels, options), options, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" not in plan and "Aggregate" not in plan
    assert plan.count("FlatMapCoGroupsInArrow") == 3


def test_draws_are_those_of_the_sql(spark):
    from nnfield.functions import draws
    from nnfield.operators.resident import _draw, _key

    rows = [(p, y, x, n, s) for p in (0, 5, -7, 2**40 + 3) for y in (0, 119_999) for x in (0, 49) for n in (0, 7) for s in (0, 35)]
    frame = spark.createDataFrame(rows, "p BIGINT, y INT, x INT, n INT, s INT")
    keyed = f"(select *, {draws.key_of('p', 'y', 'x', 'n')} as key from {{t}})"
    drawn = spark.sql(draws.with_draws(keyed, ["p", "y", "x", "n", "s"], {"u": "s"})[1:-1], t=frame)
    for r in drawn.collect():
        assert int(_draw(_key(r.p, np.array([r.y]), np.array([r.x]), r.n), r.s)[0]) == r.u


@pytest.mark.parametrize("channels,halo,edge", [(1, 0, 4), (3, 1, 4), (10, 3, 2), (2, 1, 64)])
def test_tiles_packed_in_numpy_hold_the_same_pixels(spark, monkeypatch, channels, halo, edge):
    from nnfield.operators import resident
    from nnfield.operators.blocks import pack_blocks

    monkeypatch.setattr(resident, "PIECE_PIXELS", 50)
    images = {k: random_images(1, h, w, channels, seed=k)[0] for k, (h, w) in enumerate([(11, 5), (1, 9), (7, 3)])}
    rows = [(i, h, w, y, x, [None if e == 7 else e for e in v]) for i, h, w, y, x, v in image_rows(images)]
    rows = spark.createDataFrame([rows[(k * 31) % len(rows)] for k in range(len(rows))], PIXELS)  # 31: no order, each once
    shifted = rows.selectExpr("image_id", "h", "w", "y", "x", "transform(v, e -> cast(e - 128 as tinyint)) as v")
    columns = ["image_id", "h", "w", "ty", "tx", "y0", "x0", "bh", "bw", "stride", "c"]
    expected = pack_blocks(shifted, ["image_id"], halo, "clip", edge).selectExpr(*columns, "transform(px, e -> coalesce(e, 0Y)) as px")
    made = resident.as_arrays(resident.packed_tiles(rows, halo, edge, channels), ["px"])
    assert sorted(map(tuple, made.select(*columns, "px").collect())) == sorted(map(tuple, expected.collect()))


def test_a_tile_that_lacks_pixels_is_empty(spark):
    from nnfield.operators import resident

    rows = spark.createDataFrame(image_rows(random_images(1, 4, 9)), PIXELS).where("not (y = 3 and x = 0)")
    rows = rows.unionByName(rows.where("y = 0 and x = 0")).selectExpr("image_id", "h", "w", "y", "x", "if(y = 1 and x = 8, array(1, 2), v) as v")
    made = {(r.ty, r.tx): len(r.px) for r in resident.packed_tiles(rows, 0, 4, 1).collect()}
    assert made == {(0, 0): 0, (0, 1): 16, (0, 2): 0}


def test_images_that_no_pair_uses_are_not_packed(spark, monkeypatch):
    from nnfield.operators import pairs as pair_module
    from nnfield.operators.apply import pair_blocks

    _, pixels, pairs = tables(spark, 5, 7)
    blocks = pair_blocks(pairs, pixels, "b_img")
    assert "LeftSemi" in blocks._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(pair_module, "BROADCAST_ROWS", 0)
    every = pair_blocks(pairs, pixels, "b_img")
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, every.collect())) != []


def test_pixels_outside_the_image_lie_in_the_last_tile(spark):
    from nnfield.operators.blocks import pack_blocks

    rows = spark.createDataFrame([(0, 5, 5, y, x, [1]) for y, x in ((0, 0), (5, 1), (-4, 2), (9, 9), (None, 3))], PIXELS)
    made = pack_blocks(rows, ["image_id"], 0, "clip", 2).collect()
    assert sorted((r.ty, r.tx) for r in made if r.ty is not None) == [(-2, 1), (0, 0), (2, 0), (2, 2)]
    assert [r.tx for r in made if r.ty is None] == [1]
