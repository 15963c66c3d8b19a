"""Periodic runs of words: a suffix automaton with link-cut access over the stretches that can hold one.

A run is a stretch of consecutive words with smallest period q, at least ``min_length`` words and ``REPEATS`` * q long, that
no neighbouring word extends with that period.

Words are appended to a suffix automaton. Its suffix links form a tree whose nodes are coloured by the place where their
words last ended; equal colours on a way to the root are one path of a link-cut tree. The access that follows an appended
word takes the way to the root path by path: a path of colour t whose deepest node on the way has length L says that the
last L words also ended at t and no longer stretch did. With d = e - t and L >= d these are squares of period d that reach back
L + d words, as far as they can; the place where the next word ends the period is the run's end. Then the whole way takes
the colour e. Since the last occurrence is the nearest, d is always the smallest period.

Before that, windows of 8 words (``window_of``) are hashed: a run is so long that each of its windows recurs in it, one period
on or back. So runs lie in stretches of windows that recur within the stretch, and only those are appended.

One row per row of the table, no shuffle; a row's memory is that of its text, plus about 1 KB for each word of its longest
such stretch. A null text has no words. Repeated rows and null doc_ids are rows like others. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import batches

MIN_LENGTH = 24
REPEATS = 3
CACHED_WORDS = 200_000

Run = tuple[int, int, int]  # start, length, period

_BASE = 0x9E3779B97F4A7C15
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())])
_RESULT_SQL = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


class LastOccurrences:
    """A suffix automaton that grows by one word at a time and tells where the words so far last ended."""

    def __init__(self) -> None:
        # automaton: transitions, suffix link, length of the longest string
        self.next: list[dict[int, int]] = [{}, {}]
        self.link, self.length = [0, 0], [0, 0]
        # splay trees over the paths, ordered by depth; node 0 is none and node 1 the root. Only a splay root's colour counts.
        self.left, self.right, self.up, self.colour = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last = 1

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        for column in (self.left, self.right):
            column.append(0)
        self.up.append(link)
        self.colour.append(-1)
        return len(self.length) - 1

    def _splay(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        if not p or (left[p] != x and right[p] != x):
            return
        top = p
        while True:
            g = up[top]
            if not g or (left[g] != top and right[g] != top):
                break
            top = g
        colour = self.colour[top]
        while True:
            p = up[x]
            if not p or (left[p] != x and right[p] != x):
                break
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
        self.colour[x] = colour

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x

    def _split(self, state: int, length: int) -> int:
        """A copy of ``state`` for its strings up to ``length``, put above it on its path: same colour."""
        copy = self._state(length, self.link[state], dict(self.next[state]))
        self.link[state] = copy
        self._splay(state)
        above = self.left[copy] = self.left[state]
        if above:
            self.up[above] = copy
        self.left[state], self.up[copy] = copy, state
        return copy

    def _access(self, x: int, end: int) -> list[tuple[int, int]]:
        found, below = [], 0
        left, right, up, colour, length = self.left, self.right, self.up, self.colour, self.length
        first = x
        while x:
            self._splay(x)
            if colour[x] >= 0 and length[x]:
                found.append((colour[x], length[x]))
            cut = right[x]
            if cut:
                colour[cut] = colour[x]
            right[x] = below
            if below:
                up[below] = x
            below, x = x, up[x]
        self._splay(first)
        colour[first] = end
        return found

    def append(self, word: int, end: int) -> list[tuple[int, int]]:
        """(t, L), deepest first: the last L words, not more, ended at t too, and no later."""
        following, link, length = self.next, self.link, self.length
        p = self.last
        self.last = self._state(length[p] + 1, 1, {})
        while p and word not in following[p]:
            following[p][word] = self.last
            p = link[p]
        parent = 1
        if p:
            parent = following[p][word]
            if length[parent] != length[p] + 1:
                old, parent = parent, self._split(parent, length[p] + 1)
                while p and following[p].get(word) == old:
                    following[p][word] = parent
                    p = link[p]
        link[self.last] = self.up[self.last] = parent
        return self._access(self.last, end)


def runs_of(words: list[int], min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[Run]:
    """All runs of a list of whole numbers, by start and period."""
    seen, out, n = LastOccurrences(), [], len(words)
    for e, word in enumerate(words):
        for t, back in seen.append(word, e):
            d = e - t
            if back >= (repeats - 1) * d and back + d >= min_length and (e + 1 == n or words[e + 1] != words[e + 1 - d]):
                out.append((e - back - d + 1, back + d, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


class _WordNumbers(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def stretches(numbers: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches whose windows all recur within the stretch: every run lies in one of them."""
    if len(numbers) <= window:
        return []
    steps = np.full(window, _BASE, np.uint64)
    steps[0] = 1
    powers = np.multiply.accumulate(steps)
    grams = np.zeros(len(numbers) - window + 1, np.uint64)
    for k in range(window):
        grams += numbers[k : k + len(grams)] * powers[k]
    where = np.zeros(len(grams), np.int64)
    recur = np.ones(len(grams), bool)
    for _ in range(2):
        # windows recur within the piece they lie in: at first the whole text, then a stretch
        order = np.lexsort((grams, where))
        same = (grams[order][1:] == grams[order][:-1]) & (where[order][1:] == where[order][:-1])
        twin = np.zeros(len(grams), bool)
        twin[order[1:][same]] = True
        twin[order[:-1][same]] = True
        recur &= twin
        if not recur.any():
            return []
        edge = np.flatnonzero(np.diff(np.concatenate(([0], recur.astype(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        # stretches that share words are one
        apart = np.append(True, starts[1:] >= ends[:-1] + window - 1)
        where = np.cumsum(np.bincount(starts[apart], minlength=len(grams)))
    starts, ends = starts[apart], ends[np.append(apart[1:], True)]
    return [(int(s), int(e) + window - 1) for s, e in zip(starts, ends)]


def window_of(min_length: int, repeats: int) -> int:
    """Words of a window that recurs in every run: a run has 2 * period + window - 1 words at least."""
    return max(1, min_length * (repeats - 2) // repeats)


def text_runs(words: list[bytes], numbers: _WordNumbers, min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> list[Run]:
    """All runs of the words of one text."""
    hashed = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    out = []
    for start, end in stretches(hashed, window_of(min_length, repeats)):
        if end - start >= min_length:
            own: dict[bytes, int] = {}
            out += [(start + s, n, q) for s, n, q in runs_of([own.setdefault(w, len(own)) for w in words[start:end]], min_length, repeats)]
    return out


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those of a run that follow its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return b" ".join(w for w, g in zip(words, gone.tolist()) if not g)


def cycled(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's input: in one of ten documents the words from a place on repeat the first of them. A null doc_id
    has no checksum and keeps its words."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def detect(documents: DataFrame, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
           min_length: int = MIN_LENGTH, repeats: int = REPEATS) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period), collapsed (UTF-8 of the words that stay).

    ``prepare`` may change the words of a document before they are looked at.
    """

    def rows(parts: Iterator[pa.RecordBatch]):
        numbers = _WordNumbers()
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                words = (text.as_py() or b"").split()
                if prepare is not None:
                    words = prepare(doc_id, words)
                found = text_runs(words, numbers, min_length, repeats)
                yield doc_id, len(words), [dict(zip(("start", "length", "period"), r)) for r in found], collapse(words, found)

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return docs.mapInArrow(lambda parts: batches(rows(parts), _RESULT), _RESULT_SQL)


def summaries(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run of greatest exponent, and digests of all runs and
    of the words that stay. Exponents are compared as exact fractions."""
    beats = "x.length * y.period > y.length * x.period or (x.length * y.period = y.length * x.period and (x.start < y.start or (x.start = y.start and x.period < y.period)))"
    best = f"aggregate(slice(runs, 2, greatest(size(runs) - 1, 0)), get(runs, 0), (y, x) -> if({beats}, x, y))"
    lines = "transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n'))"
    return found.selectExpr("doc_id", "runs", "collapsed", f"{best} as best").selectExpr(
        "doc_id", "cast(size(runs) as bigint) as n_runs", "best.start", "best.length", "best.period",
        "(1000 * best.length) div best.period as exponent_milli",
        f"sha2(array_join({lines}, ''), 256) as runs_sha256", "sha2(collapsed, 256) as collapsed_sha256",
    )
