"""Shards of the k-d tree: whole, gapless, near equal in bytes."""

import random
import zlib
from collections import Counter, defaultdict

from nnfield.llm import sharding


def check(rows, docs, shards, slack):
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, size = defaultdict(list), Counter()
    for r in rows:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    mean = sum(size.values()) / shards
    largest = max(r["size"] for r in rows)
    assert all(abs(size[k] - mean) <= slack * mean + 2 * largest for k in range(shards))


def test_near_equal_bytes(docs_of):
    rnd = random.Random(2)
    docs = [(i, "ü" * rnd.randint(0, 60) if i % 3 else "the same text of a third of all rows") for i in range(3000)]
    docs += [(None, None), (None, "x"), (5, docs[5][1]), (9000, None), (9001, "")]
    check(sharding.shard(docs_of(docs)).collect(), docs, 16, 0.02)
    check(sharding.shard(docs_of(docs), 5).collect(), docs, 5, 0.02)


def test_ties_and_tiny_tables(docs_of):
    assert sharding.shard(docs_of([])).collect() == []
    docs = [(1, "a")] * 7
    rows = sharding.shard(docs_of(docs)).collect()
    assert len(rows) == 7
    same = [(i, "a") for i in range(640)]
    check(sharding.shard(docs_of(same)).collect(), same, 16, 0.02)


def test_one_long_document(docs_of):
    docs = [(0, "x" * 100_000)] + [(i, "y" * 10) for i in range(1, 200)]
    assert len(sharding.shard(docs_of(docs)).collect()) == 200
