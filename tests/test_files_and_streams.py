import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nnfield import fixtures as fx
from nnfield.functions.pixels import mask_blend, swap_channels
from nnfield.operators.search import SearchOptions, bind_pairs, search_rounds
from nnfield.queries import QUERIES
from nnfield.sources.files import SIGNATURE, decode_png, encode_png, scan_png, write_png
from nnfield.plans.video import warp_video
from nnfield.sources.fields import read_field, write_field
from nnfield.sources.frames import MASK_SCHEMA, frame_files_to_table, scan_frames, stream_frame_files, stream_frames, write_clips, write_frames
from nnfield.sources.images import assemble_images, byte_values, explode_pixels, scan_images
from nnfield.streaming.video import (
    base_frame,
    blend_frames,
    blend_stream,
    clip_field,
    held_rows,
    warp_frames,
    warp_new_videos,
)

KEYS = ["clip_id", "frame_no", "ts", "y", "x"]


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*KEYS, "v").collect())


def test_image_files_arrive_in_blue_green_red_order(spark, tmp_path):
    picture = np.arange(10, 28).reshape(2, 3, 3)
    (tmp_path / "p.png").write_bytes(encode_png(picture))
    rows = explode_pixels(scan_images(spark, str(tmp_path)), ["path"]).withColumn("rgb", swap_channels(F.col("v")))
    got = {(r.y, r.x): r.rgb for r in rows.collect()}
    assert got == {(y, x): picture[y, x].tolist() for y in range(2) for x in range(3)}


def test_frames_are_read_back_in_order(spark, sf_dir, tmp_path):
    clips = fx.clip_frames(spark, sf_dir)
    write_frames(clips, str(tmp_path / "f"))
    back = scan_frames(spark, str(tmp_path / "f"))
    columns = ["clip_id", "role", "frame_no", "ts", "h", "w", "y", "x", "v"]
    assert back.select(*columns).exceptAll(clips.select(*columns)).isEmpty()
    assert back.count() == clips.count()


def test_small_clips_share_files(spark, sf_dir, tmp_path):
    clips = fx.clip_frames(spark, sf_dir).where("frame_no = 0").withColumn("clip_id", F.expr("explode(sequence(clip_id, clip_id + 195, 5))"))
    write_frames(clips, str(tmp_path / "f"))
    write_clips(fx.masks(clips), str(tmp_path / "m"))
    for name, rows in (("f", clips.count()), ("m", clips.count() // 4)):
        back = spark.read.parquet(str(tmp_path / name)).select("clip_id", F.input_file_name().alias("file"))
        files = {r.file for r in back.select("file").distinct().collect()}
        assert 1 < len(files) <= 12 and back.count() == rows
    assert back.distinct().count() == back.select("clip_id").distinct().count() == 200


def test_a_batch_reads_what_the_one_before_held(spark, sf_dir, tmp_path):
    held = fx.clip_frames(spark, sf_dir).where("clip_id < 2 and frame_no = 0")
    for batch in (3, 4):
        held.where(f"clip_id = {batch} - 3").write.parquet(str(tmp_path / f"batch={batch}"))
    found = held_rows(spark, str(tmp_path), 5)
    assert {r.clip_id for r in found.collect()} == {1} and all("batch=4" in f for f in found.inputFiles())
    assert held_rows(spark, str(tmp_path), 3).isEmpty()


def test_masked_stream_equals_batch(spark, sf_dir, tmp_path):
    clips = fx.clip_frames(spark, sf_dir)
    field = clip_field(clips, SearchOptions(), 1)
    field.write.parquet(str(tmp_path / "field"))
    field = spark.read.parquet(str(tmp_path / "field"))
    masks = fx.masks(clips)
    write_frames(clips, str(tmp_path / "f"))
    masks.write.parquet(str(tmp_path / "m"))
    stream = warp_frames(stream_frames(spark, str(tmp_path / "f"), files_per_trigger=12), field)
    mask_stream = stream_frames(spark, str(tmp_path / "m"), MASK_SCHEMA)
    paths = [str(tmp_path / n) for n in ("out", "held", "cp")]
    blend_stream(stream, mask_stream, base_frame(clips), *paths).awaitTermination()
    batch = blend_frames(warp_frames(clips, field), masks, base_frame(clips))
    assert rows_of(spark.read.parquet(paths[0])) == rows_of(batch)
    assert held_rows(spark, paths[1]).isEmpty()


def test_frames_without_a_mask_wait(spark, sf_dir, tmp_path):
    clips = fx.clip_frames(spark, sf_dir).where("clip_id = 0 and frame_no < 4")
    field = clip_field(clips, SearchOptions(), 0)
    field.write.parquet(str(tmp_path / "field"))
    field = spark.read.parquet(str(tmp_path / "field"))
    write_frames(clips, str(tmp_path / "f"))
    fx.masks(clips).where("frame_no <> 2").write.parquet(str(tmp_path / "m"))
    paths = [str(tmp_path / n) for n in ("out", "held", "cp")]
    stream = warp_frames(stream_frames(spark, str(tmp_path / "f")), field)
    blend_stream(stream, stream_frames(spark, str(tmp_path / "m"), MASK_SCHEMA), base_frame(clips), *paths).awaitTermination()
    assert {r.frame_no for r in spark.read.parquet(paths[0]).select("frame_no").distinct().collect()} == {0, 1, 3}
    assert {(r.role, r.frame_no) for r in held_rows(spark, paths[1]).collect()} == {("warped", 2)}


def test_large_static_sides_are_salted_by_frame(spark, sf_dir):
    clips = fx.clip_frames(spark, sf_dir)
    field = clip_field(clips, SearchOptions(), 0).checkpoint()
    near, far = warp_frames(clips, field), warp_frames(clips, field, broadcast_rows=10)
    assert rows_of(near) == rows_of(far)
    masks, base = fx.masks(clips), base_frame(clips)
    assert rows_of(blend_frames(near, masks, base)) == rows_of(blend_frames(far, masks, base, broadcast_rows=10))


def test_new_clips_are_matched_once_in_any_order(spark, sf_dir, tmp_path):
    clips, options = fx.clip_frames(spark, sf_dir).where("frame_no < 8 and clip_id < 3"), SearchOptions()
    store, out, cp = (str(tmp_path / n) for n in ("store", "out", "cp"))

    def arrive(part):
        part.repartition("clip_id").write.mode("append").partitionBy("clip_id").parquet(str(tmp_path / "f"))
        warp_new_videos(stream_frames(spark, str(tmp_path / "f")), store, out, cp, options, 1).awaitTermination()

    arrive(clips.where("frame_no >= 4 or clip_id = 0"))
    arrive(clips.where("frame_no < 4 and clip_id > 0 and role = 'a'"))
    arrive(clips.where("frame_no < 4 and clip_id > 0 and role <> 'a'"))
    want = warp_frames(clips, clip_field(clips, options, 1))
    assert rows_of(spark.read.parquet(out)) == rows_of(want)
    fields = read_field(spark, f"{store}/fields")
    assert fields.count() == fields.select("pair_id", "ay", "ax").distinct().count() == 3 * 64


def test_video_names_clips_of_unequal_length(spark, sf_dir):
    clips = fx.clip_frames(spark, sf_dir).where("clip_id < 3 and frame_no < 3")
    short = fx.masks(clips).where("not (clip_id = 1 and frame_no = 2)")
    warped = warp_video(clips, SearchOptions(), 0, short)
    assert [r.clip_id for r in warped.violations.collect()] == [1]
    assert {r.clip_id for r in warped.frames.select("clip_id").distinct().collect()} == {0, 2}


def test_pixels_without_a_mask_are_named(spark, sf_dir):
    clips = fx.clip_frames(spark, sf_dir).where("clip_id < 2 and frame_no < 3")
    masks = fx.masks(clips)
    made = warp_video(clips, SearchOptions(), 0, masks.where("not (clip_id = 1 and frame_no = 2 and y = 3)"))
    assert made.violations.isEmpty()
    assert [(r.clip_id, r.frame_no, r.no_mask, r.no_frame) for r in made.unmet.collect()] == [(1, 2, 8, 0)]
    assert made.frames.count() == 2 * 3 * 64 - 8
    moved = masks.withColumn("frame_no", F.expr("if(clip_id = 1, frame_no + 1, frame_no)"))
    late = warp_video(clips, SearchOptions(), 0, moved)
    assert [(r.clip_id, r.missing) for r in late.violations.collect()] == [(1, "mask")]
    assert late.unmet.isEmpty() and late.frames.select("clip_id").distinct().count() == 1


def test_single_mode_halves_the_distance_of_a_clip(spark, sf_dir):
    clips = fx.clip_frames(spark, sf_dir).where("clip_id = 0 and frame_no = 0")
    both = {m: {(r.ay, r.ax): (r.by, r.bx, r.d) for r in clip_field(clips, SearchOptions(), 1, m).collect()} for m in ("single", "double")}
    assert {k: (y, x, 2 * d) for k, (y, x, d) in both["single"].items()} == both["double"]


def test_frame_files_arrive_as_a_stream(spark, tmp_path):
    draw = np.random.default_rng(3)
    pictures = {(c, role, n): draw.integers(0, 256, (2, 3, 3)) for c in (4, 5) for role in ("a", "mask") for n in (0, 11)}
    folder = tmp_path / "files"
    for (c, role, n), picture in list(pictures.items())[:5]:
        (folder / str(c) / role).mkdir(parents=True, exist_ok=True)
        (folder / str(c) / role / f"{n:04d}.png").write_bytes(encode_png(picture))
    (folder / "4" / "a" / "0007.png").write_bytes(b"no image")
    (folder / "cover.png").write_bytes(encode_png(draw.integers(0, 256, (2, 2, 3))))

    def arrive():
        table, rejected, checkpoint = (str(tmp_path / n) for n in ("table", "rejected", "checkpoint"))
        frame_files_to_table(stream_frame_files(spark, str(folder), 2), table, rejected, checkpoint, 40).awaitTermination()
        rows = scan_frames(spark, table).select("*", F.unix_millis("ts").alias("ms")).collect()
        got = {(r.clip_id, r.role, r.frame_no, r.y, r.x): r.v[::-1] for r in rows}
        assert len(got) == len(rows) and all(r.ms == 40 * r.frame_no for r in rows)
        return got, sorted((r.path.rsplit("/", 1)[1], r.reason) for r in spark.read.parquet(rejected).collect())

    pixels = lambda some: {(*k, y, x): p[y, x].tolist() for k, p in some for y in range(2) for x in range(3)}
    bad = [("0007.png", "not an image"), ("cover.png", "unknown path")]
    assert arrive() == (pixels(list(pictures.items())[:5]), bad)
    for (c, role, n), picture in list(pictures.items())[5:]:
        (folder / str(c) / role).mkdir(parents=True, exist_ok=True)
        (folder / str(c) / role / f"{n:04d}.png").write_bytes(encode_png(picture))
    assert arrive() == (pixels(pictures.items()), bad)


def test_fields_are_read_by_bucket(spark, sf_dir, tmp_path):
    write_field(clip_field(fx.clip_frames(spark, sf_dir).where("frame_no = 0"), SearchOptions(), 0), str(tmp_path / "f"))
    some = read_field(spark, str(tmp_path / "f"), spark.createDataFrame([(1,), (3,)], "pair_id BIGINT"))
    assert {r.pair_id for r in some.select("pair_id").distinct().collect()} == {1, 3}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*pair_bucket", plan)


def test_all_byte_values_and_undecodable_files(spark, tmp_path):
    got = spark.createDataFrame([(bytearray(range(256)) * 3,)], "data BINARY").selectExpr(f"{byte_values('data')} as v").first().v
    assert got == list(range(256)) * 3
    picture = np.arange(96 * 96 * 3).reshape(96, 96, 3) * 7 % 256
    (tmp_path / "p.png").write_bytes(encode_png(picture))
    (tmp_path / "q.png").write_bytes(b"no image")
    files = scan_images(spark, f"file://{tmp_path}")
    assert {r.path.rpartition("/")[2]: r.valid for r in files.collect()} == {"p.png": True, "q.png": False}
    back = assemble_images(explode_pixels(files, ["path"]).withColumn("v", swap_channels(F.col("v"))), ["path"]).collect()
    assert [(r.height, r.width, r.channels, r.data) for r in back] == [(96, 96, 3, picture.ravel().tolist())]


def png(width, height, depth, colour, lines, interlace=0, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlace))
    packed = zlib.compress(bytes(lines))
    return SIGNATURE + header + extra + chunk(b"IDAT", packed[:5]) + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


def test_png_reader_gives_what_the_image_source_gives(spark, tmp_path):
    draw, folder = np.random.default_rng(9), tmp_path / "some files"
    folder.mkdir()
    for colour, channels in ((0, 1), (2, 3), (6, 4)):
        (folder / f"plain{channels}.png").write_bytes(encode_png(draw.integers(0, 256, (5, 7, channels))))
        for width in (1, 13):
            lines = [[y % 5, *draw.integers(0, 256, width * channels).tolist()] for y in range(20)]
            (folder / f"differences{channels}-{width}.png").write_bytes(png(width, 20, 8, colour, sum(lines, [])))
    (folder / "none.png").write_bytes(b"no image")
    (folder / "empty.png").write_bytes(b"")  # Spark skips it
    columns = ("path", "height", "width", "channels", "data", "valid")
    ours, theirs = ({r.path: tuple(r) for r in read(spark, str(folder)).select(*columns).collect()} for read in (scan_png, scan_images))
    assert ours == theirs and sum(r[5] for r in ours.values()) == 9 and len(ours) == 10


def test_png_of_other_kinds_are_named_and_not_misread(spark, tmp_path):
    whole = encode_png(np.arange(12).reshape(3, 4, 1))
    key = struct.pack(">I", 2) + b"tRNS" + bytes(2) + struct.pack(">I", zlib.crc32(b"tRNS" + bytes(2)))
    other = {
        "cut": whole[:-20], "half": whole[:30], "long": png(4, 3, 8, 0, bytes(16)), "short": png(4, 3, 8, 0, bytes(14)),
        "filter": png(4, 3, 8, 0, bytes([5, 0, 0, 0, 0]) * 3), "depth": png(4, 3, 16, 0, bytes(27)), "palette": png(4, 3, 8, 3, bytes(15)),
        "interlaced": png(4, 3, 8, 0, bytes(20), 1), "key": png(4, 3, 8, 0, bytes(15), extra=key),
    }
    for name, content in other.items():
        assert decode_png(content) is None, name
        (tmp_path / f"{name}.png").write_bytes(content)
    (tmp_path / "whole.png").write_bytes(whole)
    files = {r.path.rpartition("/")[2]: r for r in scan_png(spark, f"file://{tmp_path}").collect()}
    assert {n for n, r in files.items() if r.valid} == {"whole.png"} and bytes(files["whole.png"].data) == bytes(range(12))
    assert {(r.height, r.width, r.channels, bytes(r.data)) for r in files.values() if not r.valid} == {(-1, -1, -1, b"")}


@pytest.mark.parametrize("name", ["image_files", "analogy_files"])
def test_written_files_are_not_read_by_the_image_source(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan binaryFile" in plan and "FileScan image" not in plan


def test_many_small_files_share_tasks_and_are_all_read(spark, tmp_path, monkeypatch):
    tasks = 4 * spark.sparkContext.defaultParallelism
    count = 32 * tasks + 100
    made = spark.range(count).selectExpr("id", "1 as height", "2 as width", "1 as channels", "array(cast(id % 256 as int), cast(id div 256 % 256 as int)) as data")
    assert write_png(made, str(tmp_path / "f"), "id") == count
    back = scan_png(spark, str(tmp_path / "f"))
    assert back.rdd.getNumPartitions() <= tasks < spark.read.format("binaryFile").load(str(tmp_path / "f")).rdd.getNumPartitions()
    got = {int(r.path.rpartition("=")[2][:-4]): bytes(r.data) for r in back.collect()}
    assert got == {i: bytes([i % 256, i // 256 % 256]) for i in range(count)}
    size = sum(f.stat().st_size for f in (tmp_path / "f").iterdir())
    monkeypatch.setattr("nnfield.sources.files.TASK_BYTES", size // (tasks + 2))
    assert tasks + 2 <= scan_png(spark, str(tmp_path / "f")).rdd.getNumPartitions() <= tasks + 3


def test_batches_end_at_their_bytes(spark, tmp_path, monkeypatch):
    pictures = {i: np.random.default_rng(i).integers(0, 256, (3, 5, 3)) for i in range(9)}
    for i, picture in pictures.items():
        (tmp_path / f"{i}.png").write_bytes(encode_png(picture))
    monkeypatch.setattr("nnfield.sources.files.BATCH_BYTES", 100)
    got = {int(r.path.rpartition("/")[2][:-4]): bytes(r.data) for r in scan_png(spark, str(tmp_path)).collect()}
    assert got == {i: p[:, :, ::-1].astype(np.uint8).tobytes() for i, p in pictures.items()}


def test_bad_pairs_are_named_and_the_rest_searched(spark, sf_dir):
    images, pairs = fx.embedding_images(spark, sf_dir), fx.pairs(spark, sf_dir, "single").where("pair_id < 5")
    pixels = explode_pixels(images).where("not (image_id = 2 and y = 3 and x = 3) and image_id not in (4, 8, 9)")
    wrong = pairs.withColumn("h", F.when(F.col("pair_id") == 3, 7).otherwise(F.col("h")))
    bound = bind_pairs(wrong, pixels, SearchOptions())
    assert {r.pair_id: r.reason for r in bound.violations.collect()} == {1: "incomplete image", 2: "missing image", 3: "unlike the pair", 4: "missing image"}
    assert {r.pair_id for r in search_rounds(bound, SearchOptions(), 0).select("pair_id").distinct().collect()} == {0}
    huge = spark.createDataFrame([(0, 1, None, 2, None, 30000, 30000, 3)], "pair_id BIGINT, a_img BIGINT, aa_img BIGINT, b_img BIGINT, bb_img BIGINT, h INT, w INT, c INT")
    bare = spark.createDataFrame([], "image_id BIGINT, h INT, w INT, y INT, x INT, v ARRAY<INT>")
    assert bind_pairs(huge, bare, SearchOptions(channels=3)).violations.count() == 1
    assert huge.selectExpr("sum(cast(h as bigint) * w * c) as n").first().n == 2_700_000_000


def test_image_rows_and_pixel_rows_give_the_same_field(spark, sf_dir):
    images, pairs = fx.embedding_images(spark, sf_dir), fx.pairs(spark, sf_dir, "analogy")
    fields = [
        search_rounds(bind_pairs(pairs, table, o), o, 1).drop("round")
        for table in (images, explode_pixels(images))
        for o in (SearchOptions(), SearchOptions(whole_edge=4))
    ]
    for other in fields[1:]:
        assert fields[0].exceptAll(other).isEmpty() and other.count() == fields[0].count()


def test_blend(spark):
    row = spark.sql("select array(0, 1) m, array(5, 6) v, array(7, 8) b")
    assert row.select(mask_blend(F.col("m"), F.col("v"), F.col("b")).alias("o")).first().o == [7.0, 6.0]
