import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import PAIRS, PIXELS, brute_distance, image_rows, random_images
from nnfield import fixtures as fx
from nnfield.functions import draws
from nnfield.operators import pairs as pair_module
from nnfield.operators.apply import gather, pair_blocks
from nnfield.operators.blocks import hot_tiles
from nnfield.operators.search import (
    SearchOptions,
    bind_pairs,
    compute_field,
    matched_tiles,
    resume_field,
    score_candidates,
    search_rounds,
)
from nnfield.sources.fields import read_field, write_field

KEYS = ["pair_id", "ay", "ax"]


def rows_of(field):
    return sorted(tuple(r) for r in field.select(*KEYS, "by", "bx", "d").collect())


def small_tables(spark, height, width, channels=1, mode="single", count=2):
    images = random_images(count * 4, height, width, channels)
    pixels = spark.createDataFrame(image_rows(images), PIXELS)
    second = mode == "double"
    pairs = spark.createDataFrame(
        [(k, 4 * k, 4 * k + 1 if second else None, 4 * k + 2, 4 * k + 3 if second else None, height, width, channels)
         for k in range(count)], PAIRS,
    )
    return images, pixels, pairs


@pytest.mark.parametrize("patch_size", [1, 2, 3, 5])
@pytest.mark.parametrize("mode,channels", [("single", 3), ("double", 1)])
def test_start_distances_equal_brute_force(spark, patch_size, mode, channels):
    images, pixels, pairs = small_tables(spark, 5, 7, channels, mode)
    options = SearchOptions(patch_size=patch_size, channels=channels)
    for pair_id, ay, ax, by, bx, d in rows_of(search_rounds(bind_pairs(pairs, pixels, options), options, 0)):
        layers = [(images[4 * pair_id], images[4 * pair_id + 2])]
        if mode == "double":
            layers.append((images[4 * pair_id + 1], images[4 * pair_id + 3]))
        assert d == brute_distance(layers, ay, ax, by, bx, patch_size)


@pytest.mark.parametrize("mode,channels", [("single", 3), ("double", 1)])
def test_tiles_give_the_same_field(spark, mode, channels):
    _, pixels, pairs = small_tables(spark, 13, 9, channels, mode)
    whole = SearchOptions(channels=channels)
    tiled = dataclasses.replace(whole, whole_edge=4, tile_edge=4)
    fields = [search_rounds(bind_pairs(pairs, pixels, o), o, 3) for o in (whole, tiled)]
    assert rows_of(fields[0]) == rows_of(fields[1])


def test_small_and_large_pairs_together(spark):
    small, large = random_images(2, 5, 5), random_images(2, 11, 6, seed=3)
    images = {0: small[0], 1: small[1], 2: large[0], 3: large[1]}
    pixels = spark.createDataFrame(image_rows(images), PIXELS)
    pairs = spark.createDataFrame([(0, 0, None, 1, None, 5, 5, 1), (1, 2, None, 3, None, 11, 6, 1)], PAIRS)
    mixed = SearchOptions(whole_edge=8, tile_edge=4)
    alone = SearchOptions()
    fields = [search_rounds(bind_pairs(pairs, pixels, o), o, 2) for o in (mixed, alone)]
    assert rows_of(fields[0]) == rows_of(fields[1])
    assert fields[0].count() == 25 + 66


def test_second_images_that_repeat_the_first_double_the_distance(spark):
    _, pixels, pairs = small_tables(spark, 6, 6)
    doubled = pairs.withColumns({"aa_img": F.col("a_img"), "bb_img": F.col("b_img")})
    one, two = (search_rounds(bind_pairs(p, pixels, SearchOptions()), SearchOptions(), 2) for p in (pairs, doubled))
    assert [(*r[:5], 2 * r[5]) for r in rows_of(one)] == rows_of(two)


def test_pairs_with_and_without_second_images(spark):
    images, pixels, pairs = small_tables(spark, 6, 6, mode="double")
    mixed = pairs.withColumns({c: F.when(F.col("pair_id") == 0, F.col(c)) for c in ("aa_img", "bb_img")})
    for pair_id, ay, ax, by, bx, d in rows_of(search_rounds(bind_pairs(mixed, pixels, SearchOptions()), SearchOptions(), 0)):
        layers = [(images[4 * pair_id], images[4 * pair_id + 2])]
        if pair_id == 0:
            layers.append((images[1], images[3]))
        assert d == brute_distance(layers, ay, ax, by, bx, 3)


class Unscaled(SearchOptions):
    """As for patches too large for an exact integer score."""

    @property
    def scale(self):
        return None


def test_quotients_choose_the_same_candidates(spark):
    _, pixels, pairs = small_tables(spark, 9, 7)
    fields = [search_rounds(bind_pairs(pairs, pixels, o), o, 3) for o in (SearchOptions(), Unscaled())]
    assert rows_of(fields[0]) == rows_of(fields[1])
    assert SearchOptions(patch_size=17).scale is None


def test_distance_never_grows_and_matches_stay_inside(spark, sf_dir):
    from nnfield.queries import _pixels

    options = SearchOptions()
    bound = bind_pairs(fx.pairs(spark, sf_dir, "single"), _pixels(spark, sf_dir), options)
    fields = [search_rounds(bound, options, n) for n in (0, 1, 4, 6)]
    for before, after in zip(fields, fields[1:]):
        both = before.select(*KEYS, F.col("d").alias("was")).join(after, KEYS)
        assert both.count() == 250 * 64
        assert both.where("d > was").isEmpty()
        assert after.where("by not between 0 and h - 1 or bx not between 0 and w - 1").isEmpty()
    means = [f.agg(F.avg("d")).first()[0] for f in fields]
    assert means[3] < 0.3 * means[0]


def test_search_approaches_the_best_match(spark):
    images, pixels, pairs = small_tables(spark, 8, 8)
    options = SearchOptions()
    found = rows_of(compute_field(pairs, pixels, options, 6))
    best = [
        min(brute_distance([(images[4 * p], images[4 * p + 2])], y, x, by, bx, 3) for by in range(8) for bx in range(8))
        for p, y, x, *_ in found
    ]
    assert all(r[5] >= b for r, b in zip(found, best))
    # an approximate search: about six pixels in ten are exact after two iterations on the 8x8 images
    assert np.mean([r[5] == b for r, b in zip(found, best)]) > 0.6


@pytest.mark.parametrize("options", [SearchOptions(), SearchOptions(propagation="scan", random="half_open")])
def test_resuming_equals_running_on_for_any_partitioning(spark, tmp_path, options):
    _, pixels, pairs = small_tables(spark, 8, 8)
    through = rows_of(search_rounds(bind_pairs(pairs, pixels, options), options, 5))
    write_field(search_rounds(bind_pairs(pairs, pixels, options), options, 2), str(tmp_path / "f"))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        stored = read_field(spark, str(tmp_path / "f"))
        assert rows_of(resume_field(stored, pairs, pixels, options, 3)) == through
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_radius_limits_the_random_search(spark):
    _, pixels, pairs = small_tables(spark, 8, 8)
    from nnfield.operators.search import random_candidates

    options = SearchOptions(radius=2)
    start = search_rounds(bind_pairs(pairs, pixels, options), options, 0)
    drawn = random_candidates(start, options).withColumnsRenamed({"by": "ny", "bx": "nx"}).join(start, KEYS)
    assert drawn.count() == 2 * 64 * 2
    assert drawn.where("abs(ny - by) > 2 or abs(nx - bx) > 2").isEmpty()


def test_one_image_in_very_many_pairs(spark, monkeypatch):
    images = random_images(3, 4, 4)
    pixels = spark.createDataFrame(image_rows(images), PIXELS)
    pairs = spark.createDataFrame([(k, 0, None, 1 + k % 2, None, 4, 4, 1) for k in range(40)], PAIRS)
    plain = rows_of(search_rounds(bind_pairs(pairs, pixels, SearchOptions()), SearchOptions(), 1))
    monkeypatch.setattr(pair_module, "USES_PER_KEY", 5)
    monkeypatch.setattr(pair_module, "USE_SALTS", 4)
    assert rows_of(search_rounds(bind_pairs(pairs, pixels, SearchOptions()), SearchOptions(), 1)) == plain


def test_candidates_scored_in_both_layouts(spark):
    images, pixels, pairs = small_tables(spark, 10, 6)
    for options in (SearchOptions(), SearchOptions(whole_edge=4, tile_edge=4)):
        wanted = pixels.where("image_id = 0").selectExpr(
            "0L as pair_id", "h", "w", "y as ay", "x as ax", "h - 1 - y as by", "w - 1 - x as bx"
        )
        scored = score_candidates(wanted, bind_pairs(pairs, pixels, options), options).collect()
        assert len(scored) == 60
        for r in scored:
            assert r.d == brute_distance([(images[0], images[2])], r.ay, r.ax, r.by, r.bx, 3)


def test_identity_field_returns_the_image_and_wrong_channels_are_refused(spark):
    _, pixels, pairs = small_tables(spark, 5, 70, 2)
    field = pixels.where("image_id = 2").selectExpr("0L as pair_id", "h", "w", "y as ay", "x as ax", "y as by", "x as bx")
    seen = gather(field, pair_blocks(pairs.where("pair_id = 0"), pixels, "b_img"))
    assert sorted(seen.select("y", "x", "v").collect()) == sorted(pixels.where("image_id = 2").select("y", "x", "v").collect())
    with pytest.raises(ValueError):
        bind_pairs(pairs, pixels, SearchOptions(channels=3))


def test_pairs_of_other_channels_are_named(spark):
    grey, colour = random_images(2, 4, 5, 1), random_images(2, 4, 5, 3, seed=8)
    pixels = spark.createDataFrame(image_rows({**grey, 2: colour[0], 3: colour[1]}), PIXELS)
    pairs = spark.createDataFrame([(0, 0, None, 1, None, 4, 5, 1), (1, 2, None, 3, None, 4, 5, 3), (2, 2, None, 3, None, 4, 5, 1)], PAIRS)
    for channels, searched, others in ((1, 0, {1: "other channels", 2: "unlike the pair"}), (3, 1, {0: "other channels", 2: "other channels"})):
        options = SearchOptions(channels=channels)
        bound = bind_pairs(pairs, pixels, options)
        assert {r.pair_id: r.reason for r in bound.violations.collect()} == others
        assert {r.pair_id for r in search_rounds(bound, options, 1).select("pair_id").distinct().collect()} == {searched}


def test_draws_are_the_documented_hash(spark):
    def mix(pair, y, x, n, salt):
        value = sum(k * m for k, m in zip((pair, y, x, n, salt), draws.KEY_WEIGHTS)) & draws.MASK
        for bits, multiplier in draws.MIX_STEPS:
            value = ((value ^ (value >> bits)) * multiplier) & draws.MASK
        return value ^ (value >> draws.MIX_LAST)

    rows = [(p, y, x, n, s) for p in (0, 5, 2**31 - 1) for y in (0, 9) for x in (0, 3) for n in (0, 7) for s in (0, 11)]
    frame = spark.createDataFrame(rows, "p BIGINT, y INT, x INT, n INT, s INT")
    keyed = f"(select *, {draws.key_of('p', 'y', 'x', 'n')} as key from {{t}})"
    drawn = spark.sql(draws.with_draws(keyed, ["p", "y", "x", "n", "s"], {"u": "s"})[1:-1], t=frame)
    for r in drawn.collect():
        assert r.u == mix(r.p, r.y, r.x, r.n, r.s)


def test_a_tiled_round_shuffles_twice(spark):
    _, pixels, pairs = small_tables(spark, 13, 9, count=1)
    options = SearchOptions(whole_edge=4, tile_edge=4)
    bound = bind_pairs(pairs, pixels, options)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [search_rounds(bound, options, n)._jdf.queryExecution().executedPlan().toString() for n in (1, 2)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # beside the packed tiles, which are shuffled once: candidates to the tiles of B and the best ones back
    counts = [sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in p.splitlines()) for p in plans]
    assert counts[1] - counts[0] == 2


def test_a_constant_field_is_spread_over_copies(spark):
    _, pixels, pairs = small_tables(spark, 13, 9, count=1)
    whole, tiled = SearchOptions(), SearchOptions(whole_edge=4, tile_edge=4)
    field = pixels.where("image_id = 0").selectExpr(
        "0L as pair_id", "h", "w", "y as ay", "x as ax", "5 as by", "6 as bx", "4 as round"
    )
    bound = bind_pairs(pairs, pixels, tiled)
    hot = {(r.ty, r.tx): r.copies for r in matched_tiles(field, bound, tiled).collect()}
    # 117 matches in one tile, a quarter of an eighth of them a copy; the tiles beside it have as many, the others one
    assert hot == {t: -(-117 // 4) for t in ((1, 1), (0, 1), (2, 1), (1, 0), (1, 2))}
    fields = [rows_of(search_rounds(bind_pairs(pairs, pixels, o), o, 2, start=field)) for o in (whole, tiled)]
    assert fields[0] == fields[1] and len(fields[0]) == 117
    at = pixels.where("image_id = 2 and y = 5 and x = 6").first().v
    seen = gather(field, pair_blocks(pairs, pixels, "b_img", 4), 4).collect()
    assert len(seen) == 117 and all(r.v == at for r in seen)


def test_the_number_of_copied_tiles_is_bounded(spark, monkeypatch):
    times = spark.range(400).selectExpr("0L as pair_id", "cast(id as int) as ty", "0 as tx", "if(id < 3, 10000L, 500L) as times")
    hot = hot_tiles(times, ["pair_id"], tasks=8, edge=16)
    assert {r.ty: r.copies for r in hot.collect()} == {0: 20, 1: 20, 2: 20}  # 512 lookups a copy
    monkeypatch.setattr("nnfield.operators.blocks.HOT_TILES", 20)
    assert hot_tiles(times, ["pair_id"], tasks=8, edge=16) is None
    assert hot_tiles(times.limit(0), ["pair_id"], tasks=8, edge=16) is None


def test_tiles_after_a_checkpoint_give_the_same_field(spark):
    _, pixels, pairs = small_tables(spark, 13, 9, count=1)
    whole = SearchOptions()
    tiled = SearchOptions(whole_edge=4, tile_edge=4, rounds_per_checkpoint=1)
    fields = [search_rounds(bind_pairs(pairs, pixels, o), o, 2) for o in (whole, tiled)]
    assert rows_of(fields[0]) == rows_of(fields[1])


@pytest.mark.parametrize("mode,channels,propagation", [("single", 3, "jump"), ("double", 1, "scan")])
def test_copied_images_give_the_same_field(spark, monkeypatch, mode, channels, propagation):
    from nnfield.operators import search

    _, pixels, pairs = small_tables(spark, 23, 9, channels, mode)
    whole = SearchOptions(channels=channels, propagation=propagation)
    copied = dataclasses.replace(whole, whole_edge=4, tile_edge=4, copy_pixels=1, rounds_per_checkpoint=2)
    monkeypatch.setattr(search, "COPIES", 6)
    bound = bind_pairs(pairs, pixels, copied)
    assert bound.copied and bound.tile_edge == 16
    fields = [search_rounds(b, o, 3) for b, o in ((bind_pairs(pairs, pixels, whole), whole), (bound, copied))]
    assert rows_of(fields[0]) == rows_of(fields[1])
    again = search_rounds(bound, copied, 1, start=search_rounds(bound, copied, 2))
    assert rows_of(again) == rows_of(fields[0])
    monkeypatch.setattr(search, "COPIED_BYTES", 23 * 9)
    assert bind_pairs(pairs, pixels, copied).copied is False


def test_a_copied_round_shuffles_the_field_alone(spark):
    _, pixels, pairs = small_tables(spark, 13, 9, count=1)
    options = SearchOptions(whole_edge=4, tile_edge=4, copy_pixels=1)
    bound = bind_pairs(pairs, pixels, options)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plans = [search_rounds(bound, options, n)._jdf.queryExecution().executedPlan().toString() for n in (1, 2)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # beside the packed tiles, which are shuffled once: the best candidates to the tiles of A
    counts = [sum("Exchange hashpartitioning" in line and "ReusedExchange" not in line for line in p.splitlines()) for p in plans]
    assert counts[1] - counts[0] == 1
