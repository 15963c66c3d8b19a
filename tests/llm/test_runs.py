"""Runs of words against a search of all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from nnfield.llm import runs


def plain_runs(words, least=24, repeats=3):
    out, n = [], len(words)
    for q in range(1, n // repeats + 1):
        start = None
        for i in range(n - q + 1):
            if i < n - q and words[i] == words[i + q]:
                start = i if start is None else start
            elif start is not None:
                length = i - start + q
                piece = words[start : start + length]
                if length >= max(least, repeats * q) and not any(piece[: length - r] == piece[r:] for r in range(1, q)):
                    out.append((start, length, q))
                start = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain(doc_id, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, p = (h // 10) % n, 0
        p = 1 + (n - a) // (3 + (h // 10) % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest(lines), digest(kept))


@pytest.mark.parametrize("seed", range(60))
def test_automaton_equals_all_periods(seed):
    rnd = random.Random(seed)
    words = []
    while len(words) < 260:
        piece = [rnd.randrange(rnd.choice((1, 2, 3, 40))) for _ in range(rnd.randint(1, 25))]
        words += piece * rnd.choice((1, 1, 2, 3, 5)) + piece[: rnd.randrange(len(piece))]
    for least, repeats in ((24, 3), (4, 2), (6, 2), (9, 3)):
        want = plain_runs(words, least, repeats)
        assert runs.runs_of(words, least, repeats) == want
        assert runs.text_runs([b"%d" % w for w in words], runs._WordNumbers(), least, repeats) == want


def test_fibonacci_words_and_one_word():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert runs.runs_of(b, 6, 2) == plain_runs(b, 6, 2)
    assert runs.runs_of([5] * 100_000) == [(0, 100_000, 1)]


def test_last_occurrences_are_exact():
    rnd = random.Random(1)
    words = [rnd.randrange(3) for _ in range(120)]
    seen = runs.LastOccurrences()
    for e, w in enumerate(words):
        found = dict(seen.append(w, e))
        for size in range(1, e + 1):
            ends = [t for t in range(size - 1, e) if words[t - size + 1 : t + 1] == words[e - size + 1 : e + 1]]
            last = max(ends, default=None)
            deepest = min((c for c in found if found[c] >= size), key=lambda c: found[c], default=None)
            assert deepest == last


def corpus():
    rnd = random.Random(3)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "x " * 40), (4, "a\xa0b " * 30), (5, "É é\x0b" * 24), (5, "É é\x0b" * 24)]
    for i in range(10, 130):
        words = [rnd.choice(["a", "b", "the", f"w{rnd.randrange(500)}"]) for _ in range(rnd.randint(1, 300))]
        if i % 4 == 0:
            at = rnd.randrange(len(words))
            words[at:at] = words[at : at + rnd.randint(1, 12)] * rnd.randint(2, 30)
        rows.append((i, " ".join(words)))
    return rows + [(9_999, "one two three " * 4_000)]


def test_query_equals_brute_force(docs_of):
    rows = corpus()
    found = runs.summaries(runs.detect(docs_of(rows), runs.cycled))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is not None, x) for x in r)
    want = [plain(*r) for r in rows[:-1]] + [(9_999, 1, 0, 12_000, 3, 4_000_000, hashlib.sha256(b"0,12000,3\n").hexdigest(), hashlib.sha256(b"one two three").hexdigest())]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert sum(r[1] > 0 for r in want) > 20


def test_ties_take_the_smallest_start(spark):
    table = spark.createDataFrame([(1, "p q r " * 10 + "| " + "x y z " * 10)], "doc_id long, text string")
    row = runs.summaries(runs.detect(table)).first()
    assert (row.n_runs, row.start, row.length, row.period) == (2, 0, 30, 3)


def test_empty_table(docs_of):
    assert runs.detect(docs_of([])).collect() == []
