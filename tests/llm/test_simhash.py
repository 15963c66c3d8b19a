"""SimHash groups against all pairs."""

import random

import numpy as np
import xxhash

from nnfield.llm import simhash
from nnfield.llm.components import components


def plain(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(nodes, edges):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 200))]
        for _ in range(rnd.randint(1, 8)):
            copy = list(base)
            for _ in range(rnd.randint(0, 2)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows.append((len(rows) + 5, " ".join(copy)))
    return rows + [(1, None), (2, ""), (3, " \n"), (None, rows[0][1]), (9000, rows[0][1].upper()), (rows[0][0], rows[0][1]), (None, "nobody else")]


def test_groups_equal_brute_force(docs_of):
    rows = corpus()
    found = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs_of(rows)).collect()}
    prints = [plain(t) for _, t in rows]
    distinct = sorted(set(prints))
    pairs = [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4]
    assert pairs
    label = smallest(distinct, pairs)
    least = {}
    for (doc, _), fp in zip(rows, prints):
        if doc is not None:
            least[label[fp]] = min(least.get(label[fp], doc), doc)
    assert found == {(doc, f"{fp:016x}"): least.get(label[fp]) for (doc, _), fp in zip(rows, prints)}


def test_every_division_finds_every_link(spark):
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 1 << 62, 12, dtype=np.int64)
    fps = {int(c) for c in centres} | {0, 1}
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in rng.integers(0, 63, rng.integers(1, 7)):
                x ^= 1 << int(b)
            fps.add(x)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    for parts in ((2, 3, 4, 5), (2,), (3,), (4,), (5,)):
        assert {(r.a, r.b) for r in simhash.links(nodes, 4, parts).collect()} == want


def test_representatives(docs_of):
    rows = corpus()
    docs = docs_of(rows)
    out = simhash.representatives(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named))
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert set(ids) == groups


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (100, 90)] + [(500, k) for k in range(501, 560)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    assert found == smallest(nodes, edges)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(docs_of):
    assert simhash.near_duplicates(docs_of([])).collect() == []


def test_steps_of_few_edges_are_few_files(spark, monkeypatch):
    from nnfield.llm import components as module

    files = []

    def counted(df, name):
        table = stored(df, name)
        files.append(len(table.inputFiles()))
        return table

    stored = module.stored
    monkeypatch.setattr(module, "stored", counted)
    edges = spark.range(1, 3000).selectExpr("id as a", "id % 10 as b")
    # without this the partitions of a small shuffle are put together anyway
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert components(edges).select("component").distinct().count() == 10
        # the edges themselves come as they are; a step before had a file per shuffle partition
        assert len(files) > 4 and max(files[1:]) == 1
        files.clear()
        monkeypatch.setattr(module, "FILE_EDGES", 1500)
        assert components(edges).select("component").distinct().count() == 10
        assert 1 < max(files[1:]) <= 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
