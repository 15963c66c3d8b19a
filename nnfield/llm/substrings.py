"""Substring dedup against every earlier document, by hashed phrases and windows in blocks that the text cuts. No greedy
relative Lempel-Ziv parse is done; its cost has not been measured.

The dictionary is cut at places the text itself decides: every window of ``WINDOW`` words has a smallest ``GRAM``-word
hash (its anchor), and a phrase is a stretch of neighbouring windows with one anchor. Equal windows have equal anchors,
so the dictionary block that holds an anchor holds every phrase in which such a window can occur, and one lookup per
phrase asks all blocks. Phrases that occur earlier join into factors, the maximal runs of removed words; where
the phrases differ, at the boundaries of factors, single windows are compared. A word is a duplicate if a window that
covers it starts earlier, in a smaller doc_id or in the same document.

Steps: (1) map: phrases per document; each task drops phrases it has seen earlier itself, so that a passage of a third of
all rows reaches a block once per task; (2) blocks: phrases meet by anchor, sorted, and are read as a stream;
(3) the windows of boundary phrases meet by their hash in the same way; (4) spans go back to their documents.

Nulls: a null text has no words; a null doc_id counts as the smallest. Rows that repeat doc_id and text are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import batches, bucketed, keyed, widest_partitions
from nnfield.session import cut_lineage

WINDOW = 20
GRAM = 6
# Phrases a task holds before it sorts them; about 60 bytes each.
CHUNK_PHRASES = 1_000_000
# Words whose hashes a task remembers.
CACHED_WORDS = 200_000
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
DUPLICATE, BOUNDARY, LOOKUP = 0, 1, 2

_PHRASES = pa.schema([("block", pa.int64()), ("phrase", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()),
                      ("start", pa.int32()), ("n", pa.int32()), ("kind", pa.int8())])
_PHRASES_SQL = "block long, phrase long, doc_id long, text_hash long, start int, n int, kind byte"
_PARTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("kind", pa.int8())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_factors", pa.int64())])


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


class _Hasher:
    """Hashes of all windows of a text and the anchors of these windows."""

    def __init__(self, window: int) -> None:
        self.words, self.window, self.gram = _WordHashes(), window, min(GRAM, window)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("powers", _BASE), ("inverses", _BASE_INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(self.words.__getitem__, words), np.uint64, n) * self.powers[:n], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.inverses[start]

    def windows(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix sums, window hashes and window anchors; words are at least one window."""
        sums = self.prefix(words)
        n = len(words)
        window = (sums[self.window:] - sums[: n + 1 - self.window]) * self.inverses[: n + 1 - self.window]
        gram = (sums[self.gram:] - sums[: n + 1 - self.gram]) * self.inverses[: n + 1 - self.gram]
        gram ^= gram >> np.uint64(31)
        gram *= np.uint64(0xD6E8FEB86659FD93)
        gram ^= gram >> np.uint64(32)
        return sums, window, _sliding_min(gram, self.window - self.gram + 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach, low = 1, values
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _runs(anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1))
    return start, np.diff(np.append(start, len(anchors)))


def _ids(column: pa.Array) -> list[int]:
    return [NO_ID if x is None else x for x in column.to_pylist()]


def _chunk(held: list[tuple[np.ndarray, ...]], boundaries: bool) -> pa.RecordBatch:
    """Sorts what a task holds: what it has seen earlier itself leaves as a duplicate and the first of each goes to its
    block. ``boundaries``: phrases whose anchor has several here are boundary phrases already."""
    anchor, phrase, doc, text, start, n, own = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((text, start, doc, phrase, anchor))
    anchor, phrase, doc, text, start, n, own = (x[order] for x in (anchor, phrase, doc, text, start, n, own))
    new_anchor = np.append(True, anchor[1:] != anchor[:-1])
    first = new_anchor | np.append(True, phrase[1:] != phrase[:-1])
    at_first = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    # A repeated row stands at the place of the first and isn't later than it.
    keep = first | (doc != doc[at_first]) | (start != start[at_first])
    kind = np.where(first, LOOKUP, DUPLICATE).astype(np.int8)
    told = np.zeros(len(first), bool)
    if boundaries:
        groups = np.cumsum(new_anchor) - 1
        many = (np.bincount(groups, weights=first) > 1)[groups] | (np.bincount(groups, weights=own) > 0)[groups]
        kind[first & many] = BOUNDARY
        # A block needs two phrases of an anchor at most to know that it has several.
        rank = np.cumsum(first)
        told = many & first & (rank - rank[np.flatnonzero(new_anchor)][groups] < 2)
    parts = [x[keep] for x in (anchor, phrase, doc, text, start, n, kind)]
    more = [x[told] for x in (anchor, phrase, doc, text, start, n)] + [np.full(int(told.sum()), LOOKUP, np.int8)]
    anchor, phrase, doc, text, start, n, kind = (np.concatenate(x) for x in zip(parts, more))
    order = np.lexsort((start, doc))  # neighbours alike: the shuffle compresses better
    anchor, phrase, doc, text, start, n, kind = (x[order] for x in (anchor, phrase, doc, text, start, n, kind))
    spread = phrase ^ (doc.astype(np.uint64) * np.uint64(_BASE)) ^ start.astype(np.uint64)
    block = np.where(kind == LOOKUP, anchor, spread)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (block.view(np.int64), phrase.view(np.int64), doc, text, start, n, kind)], schema=_PHRASES)


def _phrases(window: int, chunk_phrases: int):
    """Phrases of whole texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, count = _Hasher(window), [], 0
        for part in parts:
            for doc, text, key in zip(_ids(part.column(0)), part.column(1), part.column(2).to_pylist()):
                words = (text.as_py() or b"").split()
                if len(words) < window:
                    continue
                sums, hashes, anchors = hasher.windows(words)
                start, n = _runs(anchors)
                phrase = hasher.stretch(sums, start, start + n + window - 1) ^ (n.astype(np.uint64) * np.uint64(_BASE))
                own = np.zeros(len(start), bool)
                if len(np.unique(hashes)) < len(hashes):
                    for i in np.flatnonzero(n > 1):
                        inside = hashes[start[i] : start[i] + n[i]]
                        own[i] = len(np.unique(inside)) < len(inside)
                k = len(start)
                held.append((anchors[start], phrase, np.full(k, doc), np.full(k, key), start.astype(np.int32), n.astype(np.int32), own))
                count += k
                if count >= chunk_phrases:
                    yield _chunk(held, True)
                    held, count = [], 0
        if held:
            yield _chunk(held, True)

    return run


def _blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads phrases sorted by (block, phrase, doc, start): later ones are duplicates, and the first
    of each phrase is a boundary phrase once its anchor has two. State: the last row, and one row that waits."""
    last: tuple | None = None  # block and phrase of the last row, place of that phrase's first row
    waiting: tuple | None = None
    for part in parts:
        block, phrase, doc, text, start, n, kind = (np.asarray(c) for c in part.columns)
        through = kind != LOOKUP
        out = [(doc[through], text[through], start[through], n[through], kind[through])]
        look = ~through
        block, phrase, doc, text, start, n = (x[look] for x in (block, phrase, doc, text, start, n))
        if len(block):
            same_block = np.append(last is not None and last[0] == block[0], block[1:] == block[:-1])
            same = same_block & np.append(last is not None and last[1] == phrase[0], phrase[1:] == phrase[:-1])
            at_first = np.maximum.accumulate(np.where(same, -1, np.arange(len(block))))
            first_doc = np.where(at_first < 0, last[2] if last else 0, doc[at_first])
            first_start = np.where(at_first < 0, last[3] if last else 0, start[at_first])
            later = same & ((doc != first_doc) | (start != first_start))
            out.append((doc[later], text[later], start[later], n[later], np.zeros(int(later.sum()), np.int8)))
            first = ~same
            # A first phrase is a boundary if it isn't its block's only one: it follows, or another follows it.
            at = np.flatnonzero(first)
            follows = same_block[at]
            followed = np.append(follows[1:], False)
            if waiting is not None and follows.size and follows[0]:
                out.append(tuple(np.array([x], t) for x, t in zip((*waiting, BOUNDARY), (np.int64, np.int64, np.int32, np.int32, np.int8))))
            if at.size:
                edge = at[follows | followed]
                out.append((doc[edge], text[edge], start[edge], n[edge], np.full(len(edge), BOUNDARY, np.int8)))
                k = at[-1]
                waiting = None if follows[-1] else (doc[k], text[k], start[k], n[k])
            last = (block[-1], phrase[-1], first_doc[-1], first_start[-1])
        columns = [np.concatenate(x) for x in zip(*out)]
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS)], schema=_PARTS)


def _window_rows(window: int, chunk_rows: int):
    """The windows of boundary phrases, as phrases of one window in the block of their hash."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, count = _Hasher(window), [], 0
        for part in parts:
            for doc, text, key, edges in zip(_ids(part.column(0)), part.column(1), part.column(2).to_pylist(), part.column(3).to_pylist()):
                _, hashes, anchors = hasher.windows(text.as_py().split())
                at = np.unique(np.concatenate([np.arange(e["start"], e["start"] + e["n"]) for e in edges]))
                k = len(at)
                held.append((hashes[at], anchors[at], np.full(k, doc), np.full(k, key), at.astype(np.int32), np.ones(k, np.int32), np.zeros(k, bool)))
                count += k
                if count >= chunk_rows:
                    yield _chunk(held, False)
                    held, count = [], 0
        if held:
            yield _chunk(held, False)

    return run


def _met(phrases: DataFrame) -> DataFrame:
    """Phrases after they met in their blocks: doc_id, text_hash, start, n, kind."""
    width = widest_partitions(phrases.sparkSession)
    return (
        phrases.repartition(width, "block").sortWithinPartitions("block", "phrase", "doc_id", "start", "text_hash")
        .mapInArrow(_blocks, "doc_id long, text_hash long, start int, n int, kind byte")
    )


def _ambiguous(documents: DataFrame) -> bool:
    """Whether a doc_id names two texts; otherwise the text's hash needn't travel with the phrases."""
    ids = keyed(documents).groupBy("doc_id").agg((F.min("text_hash") != F.max("text_hash")).alias("several"))
    return not ids.where("several").isEmpty()


def factors(documents: DataFrame, window: int = WINDOW, chunk_phrases: int = CHUNK_PHRASES) -> tuple[DataFrame, DataFrame, bool]:
    """(keyed documents, rows doc_id, text_hash, text, spans): the documents that share a phrase with another place, and
    spans, arrays of (start, n): n window starts that occur earlier; whether text_hash tells rows apart, else it is 0).
    A null doc_id is NO_ID in both."""
    docs = keyed(documents).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    hashed = _ambiguous(documents)
    if not hashed:
        docs = docs.withColumn("text_hash", F.lit(0).cast("long"))
    parts = _met(docs.mapInArrow(_phrases(window, chunk_phrases), _PHRASES_SQL))
    place = F.struct("start", "n")
    parts = parts.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.when(F.col("kind") == BOUNDARY, place)).alias("edges"),
        F.collect_list(F.when(F.col("kind") == DUPLICATE, place)).alias("known"))
    key = ["doc_id", "text_hash"]
    met = docs.join(parts.hint("merge"), key)
    asked = bucketed(met.select("doc_id", "text", "text_hash", "edges", "known"), "asked", key)
    windows = _met(asked.where(F.size("edges") > 0).select("doc_id", "text", "text_hash", "edges").mapInArrow(_window_rows(window, chunk_phrases), _PHRASES_SQL))
    repeated = windows.where(F.col("kind") == DUPLICATE).groupBy("doc_id", "text_hash").agg(F.collect_list(place).alias("found"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    spans = F.concat("known", F.coalesce("found", none))
    return docs, asked.join(repeated.hint("merge"), key, "left").select("doc_id", "text_hash", "text", spans.alias("spans")), hashed


def _covered(n_words: int, spans: list[dict], window: int) -> tuple[np.ndarray, int]:
    """Mask of the words inside duplicate windows, and the number of maximal factors."""
    change = np.zeros(n_words + 1, np.int64)
    start = np.fromiter((s["start"] for s in spans), np.int64, len(spans))
    end = start + np.fromiter((s["n"] for s in spans), np.int64, len(spans)) + window - 1
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    inside = np.cumsum(change)[:-1] > 0
    return inside, int(inside[0]) + int((inside[1:] & ~inside[:-1]).sum()) if n_words else 0


def _kept(text: bytes | None, spans: list[dict], window: int) -> tuple[int, int, int, bytes]:
    """Words, removed words, maximal factors and the kept words joined by one space."""
    words = (text or b"").split()
    if not spans:
        return len(words), 0, 0, b" ".join(words)
    inside, n_factors = _covered(len(words), spans, window)
    return len(words), int(inside.sum()), n_factors, b" ".join(w for w, gone in zip(words, inside.tolist()) if not gone)


def _summaries(window: int):
    """From doc_id, text_hash, text and maybe spans."""

    def rows(parts: Iterator[pa.RecordBatch]):
        for part in parts:
            found = part.column(3).to_pylist() if part.num_columns > 3 else [[]] * part.num_rows
            for doc, key, text, spans in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), found):
                n_words, removed, n_factors, kept = _kept(text.as_py(), spans, window)
                yield doc, key, n_words, removed, hashlib.sha256(kept).hexdigest(), n_factors

    return lambda parts: batches(rows(parts), _RESULT)


def deduplicate(documents: DataFrame, window: int = WINDOW, chunk_phrases: int = CHUNK_PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_factors.

    Only texts that share a phrase meet their spans; the digest of the others needs no join with their text.
    """
    docs, asked, _ = factors(documents, window, chunk_phrases)
    schema = "doc_id long, text_hash long, n_words long, n_removed long, kept_sha256 string, n_factors long"
    every = docs.select("doc_id", "text_hash", "text").mapInArrow(_summaries(window), schema)
    changed = cut_lineage(asked.where(F.size("spans") > 0).mapInArrow(_summaries(window), schema).dropDuplicates(["doc_id", "text_hash"]))
    changed = changed.select("doc_id", "text_hash", *[F.col(c).alias(f"new_{c}") for c in ("n_removed", "kept_sha256", "n_factors")])
    both = every.join(changed, ["doc_id", "text_hash"], "left")
    return both.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_words",
                       *[F.coalesce(f"new_{c}", c).alias(c) for c in ("n_removed", "kept_sha256", "n_factors")])


def cleaned(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with the kept words of each changed text, joined by one space; other texts stay as they are."""

    @F.arrow_udf("string")
    def kept(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_kept(t, x, window)[3].decode("utf-8", "replace") for t, x in zip(text.to_pylist(), spans.to_pylist())], pa.string())

    _, asked, hashed = factors(documents, window)
    asked = asked.where(F.size("spans") > 0).withColumn("kept", kept("text", "spans")).dropDuplicates(["doc_id", "text_hash"])
    asked = cut_lineage(asked.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("_id"), F.col("text_hash").alias("_hash"), F.col("kept").alias("_kept")))
    match = documents["doc_id"].cast("long").eqNullSafe(asked["_id"])
    if hashed:
        match &= F.xxhash64(documents["text"].cast("binary")) == asked["_hash"]
    out = documents.join(asked, match, "left")
    new = F.coalesce(asked["_kept"], documents["text"])
    out = out.select(*[new.alias(c) if c == "text" else documents[c] for c in documents.columns])
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out
