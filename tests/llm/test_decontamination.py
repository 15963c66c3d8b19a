"""Contamination against plain window sets."""

import hashlib
import random
import re

import pytest

from nnfield.llm import decontamination


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(8)
    words = [f"W{i}é" if i % 3 else f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 40) if i % 5 else rnd.randint(6, 14)))) for i in range(30)]
    items += [(30, items[0][1]), (31, None), (32, "..."), (None, items[2][1]), (1, items[1][1])]
    docs = []
    for d in range(80):
        text = []
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.6:
                w = (rnd.choice(items)[1] or "").split()
                cut = rnd.randint(0, max(0, len(w) - 10))
                text += w[cut : cut + rnd.randint(5, 40)]
            text += [rnd.choice(words + ["other"]) for _ in range(rnd.randint(0, 60))]
        docs.append((d, "-".join(text).upper() if d % 2 else "\x00,\n".join(text)))
    docs += [(500, None), (501, ""), (None, docs[3][1]), (4, docs[4][1]), (502, (items[6][1] + " x ") * 300)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 24, 1500])
def test_equals_brute_force(spark, docs_of, planted, block_bytes):
    docs, items = planted
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    found = decontamination.contamination(docs_of(docs), bench, block_bytes=block_bytes)
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()), key=str)
    assert rows == brute(docs, items)


def test_removes_contaminated(spark, docs_of, planted):
    docs, items = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = docs_of(docs)
    out = decontamination.decontaminated(table, bench)
    assert out.columns == table.columns
    clean = sorted((str(r[0]) for r in brute(docs, items) if not r[5]))
    assert sorted(str(r.doc_id) for r in out.collect()) == clean


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs_of([]), bench).collect() == []
    row = decontamination.contamination(docs_of([(1, "one two")]), bench).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (2, 0, 0, False)
