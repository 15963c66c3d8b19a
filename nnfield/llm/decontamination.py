"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its documents into word numbers of the benchmark's vocabulary; words the benchmark doesn't have break the
text, so that a suffix array is built over what can match at all. Every suffix of every benchmark item is then
binary-searched in the array of each shard: the range that shares its first ``WINDOW`` words gives the places of a window,
and the common prefix at each place the longest verbatim match. No document is shuffled.

The benchmark reaches the tasks in blocks of at most ``BLOCK_BYTES`` of text; with several blocks the documents are read
once for each, and the hits meet by document. Nulls: a null text has no words and isn't contaminated, a null item text has
no window, a null item_id is written "null". Repeated items count once per item_id. An item of fewer words than a window,
but not none, is one window.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import keyed, same_row
from nnfield.session import cut_lineage

WINDOW = 13
BLOCK_BYTES = 16 << 20
# Words of one suffix array; a task builds several if its documents share more with the benchmark.
SHARD_WORDS = 1_000_000
# Suffixes that are searched at once.
SEARCHED = 8192

# Lower-cases A-Z, keeps 0-9, a-z and all bytes of non-ASCII characters, and turns the rest into spaces.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

_HITS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()),
                   ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64())])
_HITS_SQL = "doc_id long, text_hash long, n_words long, spans array<struct<start:int,end:int>>, items array<string>, longest long"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


class Suite:
    """A block of the benchmark: its vocabulary, its distinct word sequences and all their suffixes that begin a window."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int) -> None:
        named: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            if words := tuple(words_of(text)):
                named[words].add(item)
        self.vocabulary: dict[bytes, int] = {}
        sequences = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64) for words in named]
        self.items = [sorted(x) for x in named.values()]
        self.longest = max(map(len, sequences), default=0)
        self.least = min((min(window, len(s)) for s in sequences), default=0)
        at, owner, width = [], [], []
        base = 0
        for k, s in enumerate(sequences):
            n = min(window, len(s))
            for i in range(len(s) - n + 1):
                at.append(base + i)
                owner.append(k)
                width.append(n)
            base += len(s) + 1
        # Sequences stand apart by 0, which no text has.
        self.words = np.concatenate([np.append(s, 0) for s in sequences] or [np.zeros(0, np.int64)])
        self.words = np.append(self.words, np.zeros(max(self.longest, window), np.int64))
        self.at, self.owner, self.width = (np.array(x, np.int64) for x in (at, owner, width))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``words`` in the order of their suffixes, compared over at least ``depth`` words, by doubling."""
    n = len(words)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while True:
        key = rank * (n + 1)
        key[: n - reach] += rank[reach:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, key[order[1:]] != key[order[:-1]]))
        rank, reach = new, 2 * reach
        if reach >= depth or reach >= n or rank[order[-1]] == n - 1:
            return order


def _bound(words: np.ndarray, array: np.ndarray, suite: Suite, at: np.ndarray, width: np.ndarray, upper: bool) -> np.ndarray:
    """First place of the array whose suffix isn't less than (upper: is greater than) each searched prefix."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(array))
    steps = np.arange(width.max())
    wanted = suite.words[at[:, None] + steps]
    counted = steps < width[:, None]
    while (open_ := low < high).any():
        middle = (low + high) // 2
        there = words[array[np.minimum(middle, len(array) - 1)][:, None] + steps]
        differs = (there != wanted) & counted
        k = differs.argmax(axis=1)
        rows = np.arange(len(at))
        unlike = differs[rows, k]
        less = unlike & (there[rows, k] < wanted[rows, k])
        go = open_ & (less | ~unlike if upper else less)
        low = np.where(go, middle + 1, low)
        high = np.where(open_ & ~go, middle, high)
    return low


def _search(words: np.ndarray, length: int, suite: Suite) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, suffix, words in common) of every place where a window of the suite stands."""
    array = suffix_array(words[:length], suite.longest)
    for begin in range(0, len(suite.at), SEARCHED):
        at, width = suite.at[begin : begin + SEARCHED], suite.width[begin : begin + SEARCHED]
        low, high = (_bound(words, array, suite, at, width, upper) for upper in (False, True))
        for few in np.array_split(np.flatnonzero(high > low), max(1, int((high - low).sum() // 200_000))):
            times = (high - low)[few]
            if not times.sum():
                continue
            suffix = np.repeat(few, times)
            inside = np.arange(len(suffix)) - np.repeat(np.cumsum(times) - times, times)
            place = array[low[suffix] + inside]
            common = width[suffix].copy()
            going = np.arange(len(suffix))
            while len(going):
                ours = suite.words[at[suffix[going]] + common[going]]
                going = going[(ours == words[place[going] + common[going]]) & (ours > 0)]
                common[going] += 1
            yield place, suffix + begin, common


def _shard(held: list, suite: Suite, window: int) -> pa.RecordBatch:
    """held: (doc_id, text_hash, n_words, [(start, word numbers)])."""
    doc_of, start_of, pieces = [], [], []
    for d, (_, _, _, runs) in enumerate(held):
        for start, numbers in runs:
            doc_of += [np.full(len(numbers) + 1, d)]
            start_of += [np.arange(start, start + len(numbers) + 1)]
            # A number of its own after each run, above the vocabulary, ends every comparison.
            pieces += [numbers, np.array([len(suite.vocabulary) + 1 + len(pieces)])]
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    longest: dict[int, int] = defaultdict(int)
    if pieces:
        text, doc, place_in_doc = map(np.concatenate, (pieces, doc_of, start_of))
        padded = np.append(text, np.full(max(suite.longest, window) + 1, -1))
        for place, suffix, common in _search(padded, len(text), suite):
            d, start, end = doc[place], place_in_doc[place], place_in_doc[place] + common
            for a, b in np.unique(np.stack((d, suite.owner[suffix])), axis=1).T.tolist():
                items[a].update(suite.items[b])
            order = np.lexsort((end, start, d))
            for a, b, c in zip(d[order].tolist(), start[order].tolist(), end[order].tolist()):
                spans = hits[a]
                longest[a] = max(longest[a], c - b)
                if spans and b <= spans[-1][1] and b >= spans[-1][0]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], c))
                else:
                    spans.append((b, c))
    columns = [[h[0] for h in held], [h[1] for h in held], [h[2] for h in held],
               [[{"start": b, "end": c} for b, c in _merged(hits.get(d, []))] for d in range(len(held))],
               [sorted(items.get(d, ())) for d in range(len(held))], [longest.get(d, 0) for d in range(len(held))]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _HITS)], schema=_HITS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, c in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], c))
        else:
            out.append((b, c))
    return out


def _runs(numbers: np.ndarray, least: int) -> list[tuple[int, np.ndarray]]:
    """Stretches of at least ``least`` words that the benchmark has."""
    if not least or len(numbers) < least:
        return []
    known = np.concatenate(([False], numbers > 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1]).reshape(-1, 2)
    return [(int(a), numbers[a:b]) for a, b in edge[edge[:, 1] - edge[:, 0] >= least]]


def _matches(suite: Suite, window: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        get = suite.vocabulary.get
        for part in parts:
            for doc, text, key in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist()):
                words = words_of(text.as_py())
                runs = _runs(np.array([get(w, 0) for w in words], np.int64), suite.least)
                held.append((doc, key, len(words), runs))
                count += sum(len(x) for _, x in runs)
                if count >= SHARD_WORDS or len(held) >= 50_000:
                    yield _shard(held, suite, window)
                    held, count = [], 0
        if held:
            yield _shard(held, suite, window)

    return run


def _suites(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[Suite]:
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("binary").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length(F.col("item").cast("binary")))).first()[0] or 0
    blocks = max(1, -(-2 * size // block_bytes))
    if blocks == 1:
        yield Suite([tuple(r) for r in items.collect()], window)
        return
    # The size of a block is checked again: an item longer than a block is a block by itself.
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for k in range(blocks):
        rows = [tuple(r) for r in items.where(block == k).collect()]
        if rows:
            yield Suite(rows, window)


def matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, text_hash, n_words, spans (start and end of matched words), items, longest (words of the longest match)."""
    docs = keyed(documents)
    found = [docs.mapInArrow(_matches(s, window), _HITS_SQL) for s in _suites(benchmark, window, block_bytes)]
    if not found:
        found = [docs.mapInArrow(_matches(Suite([], window), window), _HITS_SQL)]
    if len(found) == 1:
        return found[0]

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def merged(spans: pa.Array) -> pa.Array:
        rows = [_merged([(s["start"], s["end"]) for s in x]) for x in spans.to_pylist()]
        return pa.array([[{"start": b, "end": c} for b, c in x] for x in rows], _HITS.field("spans").type)

    parts = found[0]
    for more in found[1:]:
        parts = parts.unionByName(more)
    parts = cut_lineage(parts)
    every = parts.groupBy("doc_id", "text_hash").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    rows = docs.select("doc_id", "text_hash")
    return rows.join(every, same_row(rows, every)).select(
        rows.doc_id, rows.text_hash, "n_words", merged("spans").alias("spans"), "items", "longest")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest."""
    found = matches(documents, benchmark, window, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    found = found.withColumn("n_hit", n_hit)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "longest")


def decontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, as they are."""
    found = matches(documents, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    bad = found.where((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    bad = cut_lineage(bad)
    match = documents["doc_id"].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"].cast("binary")) == bad["_hash"])
    return documents.join(bad, match, "left_anti")
