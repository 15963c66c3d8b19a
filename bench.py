"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

After a warm-up every query runs once, and twice more if it took under ``AGAIN`` seconds: the figure is the median.
Results go to the no-op sink. ``field_224_*`` are 4 rounds on one 224x224x3 pair (patch 3, radius 224) in the two
layouts; ``evaluations_per_sec`` counts the candidates that lie inside the image, on a field of one round.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from nnfield import fixtures
from nnfield.operators.search import SearchOptions, bind_pairs, neighbour_candidates, random_candidates, search_rounds
from nnfield.queries import QUERIES

AGAIN = 6
SQUARE_ROUNDS = 4

HEADLINE = [
    "patches",
    "resize_bilinear_up",
    "field_init",
    "patch_distance_double",
    "field_jump_2rounds",
    "field_scan_2rounds",
    "field_large_image",
    "field_full",
    "analogy_2rounds",
    "window_average_clip",
    "block_copy",
    "warp_stream",
]


def square(whole_edge: int):
    """Search of the 224x224x3 pair in the layout that ``whole_edge`` selects."""

    def query(spark, sf_dir):
        options = SearchOptions(channels=3, radius=224, whole_edge=whole_edge)
        pair, pixels = fixtures.square_pair(spark, sf_dir)
        return search_rounds(bind_pairs(pair, pixels, options), options, SQUARE_ROUNDS)

    return query


MORE = {"field_224_whole": square(256), "field_224_tiled": square(64)}


def candidates_a_pixel(spark, sf_dir) -> float:
    """Candidates inside the image per pixel and round, the incumbent included: counted for one cycle of jumps."""
    options, pairs = SearchOptions(), fixtures.pairs(spark, sf_dir, "single")
    field = search_rounds(bind_pairs(pairs, fixtures.embedding_images(spark, sf_dir), options), options, 0).persist()
    pixels = field.count()
    moved = sum(neighbour_candidates(field.selectExpr("* except (round)", f"{r} as round"), options).count() for r in range(len(options.jumps)))
    return 1 + moved / len(options.jumps) / pixels + random_candidates(field, options).count() / pixels


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("nnfield-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # a round multiplies rows before the next shuffle: keep small inputs on all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    enough = spark.read.parquet(f"{sf_dir}/events.parquet").count() >= 224 * 224
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE + (list(MORE) if enough else []))).split(",")
    every = QUERIES | MORE

    def run(name: str) -> float:
        began = time.perf_counter()
        every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("field_init")
    seconds = {}
    for name in names:
        times = [run(name)]
        if times[0] < AGAIN:
            times += [run(name), run(name)]
        seconds[name] = round(statistics.median(times), 3)
    report = {
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if "field_full" in seconds:
        pairs = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count() // 2
        report["evaluations_per_sec"] = round(pairs * 64 * 40 * candidates_a_pixel(spark, sf_dir) / seconds["field_full"])
    for name in MORE:
        if name in seconds:
            report[f"{name}_sec_per_round"] = round(seconds[name] / SQUARE_ROUNDS, 2)
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
