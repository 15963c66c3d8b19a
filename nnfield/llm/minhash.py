"""MinHash near-dedup by bottom-k sketches from one hash function.

A document is the set of its distinct ``SHINGLE``-word shingles; documents of equal sets are one node. A node's sketch is
its ``K`` smallest shingle hashes, or all of them. Documents are linked whose sets have a Jaccard similarity of
``PERCENT`` in a hundred or more:

1. Inverted lists of the retained values. Similar sets share ``needed`` retained values or more: exactly so where the
   sketches are whole sets, else up to a chance of ``LOSS`` per pair, by the hypergeometric tail for the set's size. So a pair
   meets already among the size - needed + 1 rarest values of each sketch, and only those are listed; values of a
   single node drop out. What many documents have in common (a line, a passage) is at the end of that order.
2. Overlaps and union sketches. In the lists, sketches are compared cell by cell; a pair is looked at in one list
   only. A node goes on if it has ``needed`` common values with another among the K smallest of both sketches together.
3. Exact Jaccard on the full sets of shingles: the texts of those nodes come to their cells, where the pairs are
   verified from the most alike on. Pairs that verified ones tie together already are left out, so that a cell gives
   fewer links than it has nodes, and no pair of different components stays unverified.

A list of up to ``BLOCK`` nodes, and no more than ``BLOCK_SHINGLES`` shingles, is one cell; of a longer one any two blocks meet. A
list of more than ``LONG`` nodes, as of a passage with very many versions, first meets ``CENTERS`` of its own nodes, block by
block: where that ties it together nothing else is compared.

Nulls: a null text has no words; without words the set is empty and linked with nothing. A null doc_id is never a
component's smallest: component_id is null if there is none, and kept is false. Repeated rows are rows of one node. Rows of one
doc_id with different texts are different documents. An empty table gives none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import batches, join_unique, keyed, stored, widest_partitions
from nnfield.llm.components import components
from nnfield.session import cut_lineage

SHINGLE = 4
PERCENT = 80
K = 64
LOSS = 1e-9
BLOCK = 256
BLOCK_SHINGLES = 500_000
LONG = 1024
CENTERS = 4
# Rows of a cell up to which pairs are compared one by one.
FEW = 12
# Bytes of sketches or bit rows looked at together, and pairs of a cell up to which sets are compared one by one.
CHUNK_BYTES = 16_000_000
FEW_PAIRS = 64
# Sets a task remembers to have seen.
SEEN_SETS = 500_000

_PRINTS_SQL = "doc_id long, text_hash long, node long, n long, needed int, sketch array<long>"
_PRINTS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("needed", pa.int32()), ("sketch", pa.list_(pa.int64()))])


def shingles(text: bytes | None, shingle: int = SHINGLE) -> list[bytes]:
    """Shingles of the lower-cased words, repeats included; the whole sequence of fewer words as one."""
    words = (text or b"").lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [joined]
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(spaces + 1).tolist()]
    ends = [*spaces.tolist()[shingle - 1 :], len(joined)]
    return [joined[s:e] for s, e in zip(starts, ends)]


@functools.lru_cache(maxsize=100_000)
def needed(n: int, k: int = K, percent: int = PERCENT, loss: float = LOSS) -> int:
    """Retained values that a set of n shingles shares with each similar set, up to a chance of ``loss``."""
    common = -(-percent * n // 100)
    union = n * 100 // percent
    if union <= k:
        return common
    # k draws without return from the largest union, of which exactly percent in a hundred are common
    while percent * union % 100:
        union += 1
    hits, tail, shared = 0, 0.0, percent * union // 100
    whole = math.log(math.comb(union, k)) if union < 4 * k else 0.0
    for hits in range(max(0, k - (union - shared)) if whole else 0, k + 1):
        if whole:
            tail += math.exp(math.log(math.comb(shared, hits)) + math.log(math.comb(union - shared, k - hits)) - whole)
        else:  # draws with return from a large one: the tail is heavier
            tail += math.comb(k, hits) * (percent / 100) ** hits * (1 - percent / 100) ** (k - hits)
        if tail > loss:
            break
    # smaller unions may be whole sketches
    return min(hits, common) if n <= k else hits


def prints(documents: DataFrame, k: int = K, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (hash of the set; 0 if empty), n (its size), needed, sketch (null where the task has seen the set)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, seen = xxhash.xxh64_intdigest, set()
        for part in parts:
            nodes, sizes, least, sketches = [], [], [], []
            for text in part.column(1):
                own = shingles(text.as_py(), shingle)
                values = np.unique(np.fromiter(map(digest, own), np.uint64, len(own)))
                node = digest(values.tobytes()) if own else 0
                sketches.append(None if node in seen else values[:k].view(np.int64))
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                sizes.append(len(values))
                least.append(needed(len(values), k, percent))
            node = pa.array(np.array(nodes, np.uint64).view(np.int64))
            columns = [part.column(0), part.column(2), node, pa.array(sizes, pa.int64()), pa.array(least, pa.int32()), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, schema=_PRINTS)

    return keyed(documents).mapInArrow(run, _PRINTS_SQL)


def members(classes: DataFrame, k: int = K) -> DataFrame:
    """node, n, needed, listed (the values in whose lists it stands), sketch (upper halves of the values, ascending)."""
    values = classes.select("node", F.explode("sketch").alias("value"))
    shared = stored(values.groupBy("value").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "shared")
    total = shared.agg(F.sum("times")).first()[0] or 0
    held = join_unique(values, shared, "value", total).groupBy("node").agg(F.collect_list(F.struct("times", "value")).alias("held"))
    listed = held.join(classes.select("node", "n", "needed", "sketch").hint("merge"), "node").where("size(held) >= needed")
    upper = "transform(sketch, v -> cast(shiftrightunsigned(v, 32) as bigint))"
    return listed.selectExpr("node", "n", "needed", "slice(array_sort(held), 1, size(held) - needed + 1).value as listed", f"{upper} as sketch")


_CELL = pa.schema([("value", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("second", pa.bool_()), ("node", pa.int64()), ("component", pa.int64()),
                   ("n", pa.int64()), ("needed", pa.int32()), ("listed", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_ROW = ["component", "n", "needed", "listed", "sketch"]


def list_lengths(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """value, times (its nodes) and blocks of every list of two nodes or more."""
    lengths = rows.select(F.explode("listed").alias("value"), "n").groupBy("value").agg(F.count(F.lit(1)).alias("times"), F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("times") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    return lengths.where("times > 1").select("value", "times", blocks.alias("blocks"))


def cells(rows: DataFrame, lengths: DataFrame, total: int) -> DataFrame:
    """List rows dealt to cells (value, i, j): any two blocks of a list meet."""
    found = join_unique(rows.withColumn("value", F.explode("listed")), lengths, "value", total)
    found = found.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = [F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second")]
    return found.select("value", *place, "node", *_ROW)


def center_cells(rows: DataFrame, lengths: DataFrame, total: int, centers: int = CENTERS) -> DataFrame:
    """The same for long lists, but every block meets a few nodes of the list only, which stand in each cell."""
    found = join_unique(rows.withColumn("value", F.explode("listed")), lengths, "value", total)
    chosen = found.groupBy("value").agg(F.max("blocks").alias("blocks"), *[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"c{i}") for i in range(centers)])
    chosen = chosen.select("value", "blocks", F.explode(F.array_distinct(F.array(*[f"c{i}" for i in range(centers)]))).alias("node"))
    chosen = chosen.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(rows.hint("merge"), "node")
    here = [F.lit(-1).alias("j"), F.lit(True).alias("second"), "node", *_ROW]
    blocks = found.select("value", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(False).alias("second"), "node", *_ROW)
    return blocks.unionByName(chosen.select("value", "i", *here))


class _Node:
    """A row of a cell."""

    def __init__(self, second: bool, node: int, component: int, n: int, needed: int, listed: list[int], sketch: list[int], text: bytes | None = None) -> None:
        self.second, self.node, self.component, self.n, self.needed, self.text = second, node, component, n, needed, text
        self.listed, self.sketch = set(listed), set(sketch)

    def hits(self, other: _Node, k: int) -> int:
        """Common values among the k smallest of both sketches together."""
        both = self.sketch & other.sketch
        union = sorted(self.sketch | other.sketch)
        return len(both) if len(union) <= k else sum(v <= union[k - 1] for v in both)


def _cell_pairs(value: int, diagonal: bool, rows: list[_Node], k: int, percent: int) -> list[tuple[int, int, int]]:
    """(hits, places of both rows) of the pairs of a cell that its list answers for and that may be similar. The
    smallest value that lists both nodes answers for them."""
    if len(rows) <= FEW:
        near = [
            (i, j) for i, x in enumerate(rows) for j, y in enumerate(rows[:i])
            if (diagonal or x.second != y.second) and x.component != y.component
            and 100 * min(x.n, y.n) >= percent * max(x.n, y.n) and min(x.listed & y.listed) == value
        ]
        found = ((rows[i].hits(rows[j], k), i, j) for i, j in near)
        return [(hits, i, j) for hits, i, j in found if hits >= max(rows[i].needed, rows[j].needed)]
    least = np.array([r.needed for r in rows])
    i, j = _near(value, diagonal, rows, percent)
    enough = np.maximum(least[i], least[j])
    held = _bits([list(r.sketch) for r in rows])
    kept = _shared(held, i, j) >= enough
    i, j, enough = i[kept], j[kept], enough[kept]
    hits = _union_hits(rows, i, j, k)
    kept = hits >= enough
    return list(zip(hits[kept].tolist(), i[kept].tolist(), j[kept].tolist()))


def _near(value: int, diagonal: bool, rows: list[_Node], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of many rows that the list of ``value`` answers for."""
    n, component, side = (np.array(x) for x in zip(*((r.n, r.component, r.second) for r in rows)))
    able = 100 * np.minimum.outer(n, n) >= percent * np.maximum.outer(n, n)
    able &= component[:, None] != component[None, :]
    if not diagonal:
        able &= side[:, None] != side[None, :]
    able = np.triu(able, 1)
    if able.any():
        able &= _common([[v for v in r.listed if v < value] for r in rows]) == 0
    return np.nonzero(able)


def _bits(lists: list[list]) -> np.ndarray:
    """A row of bits per list of distinct values, a bit per value that several lists hold."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    number: dict = {}
    column = np.fromiter((number.setdefault(v, len(number)) for x in lists for v in x), np.int64, len(owner))
    several = np.bincount(column, minlength=1) > 1
    kept = several[column] if len(column) else np.zeros(0, bool)
    place = (np.cumsum(several) - 1)[column[kept]]
    bits = np.zeros((len(lists), -(-int(several.sum()) // 64) * 8), np.uint8)
    np.bitwise_or.at(bits, (owner[kept], place >> 3), np.left_shift(1, place & 7).astype(np.uint8))
    return bits.view(np.uint64)


def _shared(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many values the lists of each pair of places share."""
    step = max(1, CHUNK_BYTES // max(8, 8 * bits.shape[1]))
    parts = [np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _union_hits(rows: list[_Node], i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """_Node.hits() of each pair of places."""
    width = max(len(r.sketch) for r in rows)
    absent = np.iinfo(np.int64).max
    held = np.full((len(rows), width), absent)
    for row, r in zip(held, rows):
        row[: len(r.sketch)] = list(r.sketch)
    out, step = [np.zeros(0, np.int64)], max(1, CHUNK_BYTES // (16 * width))
    for at in range(0, len(i), step):
        both = np.sort(np.concatenate([held[i[at : at + step]], held[j[at : at + step]]], axis=1), axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != absent)
        rank = np.arange(2, 2 * width + 1) - np.cumsum(twice, axis=1)
        out.append((twice & (rank <= k)).sum(axis=1))
    return np.concatenate(out)


def _common(lists: list[list[int]]) -> np.ndarray:
    """Matrix of the number of values that any two lists of distinct values share."""
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    if not len(owner):
        return np.zeros((len(lists), len(lists)), np.int32)
    _, column, times = np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]), return_inverse=True, return_counts=True)
    several = np.cumsum(times > 1) - 1
    kept = (times > 1)[column]
    held = np.zeros((len(lists), int((times > 1).sum())), np.float32)
    held[owner[kept], several[column[kept]]] = 1
    return (held @ held.T).astype(np.int32)


def _tied(rows: list[_Node], pairs: list[tuple[int, int, int]], percent: int, shingle: int) -> list[tuple[int, int]]:
    """(a, b) of verified pairs that tie the rows of a cell together as all similar pairs do."""
    above = {r.component: r.component for r in rows}

    def root(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    sets: dict[int, set[bytes]] = {}
    out = []
    if len(pairs) > FEW_PAIRS:
        pairs = _similar(rows, pairs, percent, shingle)
    for _, i, j in sorted(pairs, reverse=True):
        x, y = root(rows[i].component), root(rows[j].component)
        if x == y:
            continue
        for at in (i, j):
            if at not in sets:
                sets[at] = set(shingles(rows[at].text, shingle))
        common = len(sets[i] & sets[j])
        if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
            above[x] = y
            out.append((rows[i].node, rows[j].node))
    return out


def _similar(rows: list[_Node], pairs: list[tuple[int, int, int]], percent: int, shingle: int) -> list[tuple[int, int, int]]:
    """The pairs whose full sets are similar, for many pairs of a cell: the sets become rows of bits."""
    places = sorted({x for _, *pair in pairs for x in pair})
    sets = [list(dict.fromkeys(shingles(rows[at].text, shingle))) for at in places]
    size = np.array([len(x) for x in sets])
    at = np.full(len(rows), -1)
    at[places] = np.arange(len(places))
    i, j = (at[[pair[side] for pair in pairs]] for side in (1, 2))
    common = _shared(_bits(sets), i, j)
    kept = 100 * common >= percent * (size[i] + size[j] - common)
    return [pair for pair, same in zip(pairs, kept.tolist()) if same]


def _lists(column: pa.ListArray) -> Iterator[list[int]]:
    values, ends = column.flatten().to_pylist(), column.offsets.to_pylist()
    first = ends[0]
    return (values[s - first : e - first] for s, e in zip(ends, ends[1:]))


def _by_cell(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[_Node]]]:
    """((value, i, j), rows) of each cell, from rows sorted by it. Repeated rows of a node are one."""
    at, rows = None, {}
    for part in parts:
        for piece in (part.slice(k, 512) for k in range(0, part.num_rows, 512)):
            plain = [piece.column(c).to_pylist() for c in ("value", "i", "j", "second", "node", "component", "n", "needed")]
            texts = piece.column("text").to_pylist() if "text" in piece.schema.names else [None] * piece.num_rows
            for value, i, j, *own, listed, sketch, text in zip(*plain, _lists(piece.column("listed")), _lists(piece.column("sketch")), texts):
                if (value, i, j) != at:
                    if len(rows) > 1:
                        yield at, list(rows.values())
                    at, rows = (value, i, j), {}
                # of a center that stands in the block too only the center counts
                if own[0] or own[1] not in rows:
                    rows[own[1]] = _Node(*own, listed, sketch, text)
    if len(rows) > 1:
        yield at, list(rows.values())


def ties(dealt: DataFrame, texts: DataFrame, k: int = K, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Verified (a, b) that tie together, within every cell, all nodes that similar pairs connect. ``texts(node, text)``."""

    def alike(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (value, i, j), rows in _by_cell(parts):
            for at in sorted({x for _, *pair in _cell_pairs(value, i == j, rows, k, percent) for x in pair}):
                row = rows[at]
                yield value, i, j, row.second, row.node, row.component, row.n, row.needed, list(row.listed), list(row.sketch)

    def verify(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (value, i, j), rows in _by_cell(parts):
            yield from _tied(rows, _cell_pairs(value, i == j, rows, k, percent), percent, shingle)

    schema = "value long, i int, j int, second boolean, node long, component long, n long, needed int, listed array<long>, sketch array<long>"
    width = widest_partitions(dealt.sparkSession)

    def together(rows: DataFrame) -> DataFrame:
        return rows.repartition(width, "value", "i", "j").sortWithinPartitions("value", "i", "j")

    some = together(dealt).mapInArrow(lambda parts: batches(alike(parts), _CELL), schema)
    return stored(together(some.join(texts.hint("merge"), "node")).mapInArrow(lambda parts: batches(verify(parts), _LINK), "a long, b long"), "ties")


def linked_nodes(documents: DataFrame, classes: DataFrame, k: int = K, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """(node, component) of all nodes that are linked."""
    rows = stored(members(classes, k).withColumn("component", F.col("node")), "members")
    lengths = stored(list_lengths(rows, block), "lengths")
    total, longest = lengths.agg(F.coalesce(F.sum("times"), F.lit(0)), F.coalesce(F.max("times"), F.lit(0))).first()
    docs = keyed(documents).select("doc_id", "text_hash", "text")
    wanted = rows.select("node").join(classes.select("node", "first_id", "first_hash").hint("merge"), "node")
    same = docs.doc_id.eqNullSafe(wanted.first_id) & (docs.text_hash == wanted.first_hash)
    texts = stored(docs.join(wanted, same).select("node", "text").dropDuplicates(["node"]), "texts")
    if longest <= long:
        return components(ties(cells(rows, lengths, total), texts, k, percent, shingle))
    first = ties(center_cells(rows, lengths.where(F.col("times") > long), total), texts, k, percent, shingle)
    labels = stored(components(first), "labels").withColumnRenamed("component", "label")
    rows = rows.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("label", "node")).drop("label")
    # lists that are one component by now are done
    open_lists = join_unique(rows.select("component", F.explode("listed").alias("value")), lengths, "value", total)
    open_lists = open_lists.groupBy("value").agg(F.first("times").alias("times"), F.first("blocks").alias("blocks"), F.min("component").alias("x"), F.max("component").alias("y"))
    open_lists = stored(open_lists.where("x < y").select("value", "times", "blocks"), "open")
    return components(first.unionByName(ties(cells(rows, open_lists, total), texts, k, percent, shingle)))


def near_duplicates(documents: DataFrame, k: int = K, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, long: int = LONG) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document."""
    marks = stored(prints(documents, k, percent, shingle), "prints")
    classes = stored(marks.where("n > 0").groupBy("node").agg(
        F.max("n").alias("n"), F.max("needed").alias("needed"), F.first("sketch", True).alias("sketch"), F.min("doc_id").alias("least"),
        F.count(F.lit(1)).alias("times"), F.first(F.struct("doc_id", "text_hash")).alias("who"),
    ).selectExpr("*", "who.doc_id as first_id", "who.text_hash as first_hash"), "classes")
    linked = stored(linked_nodes(documents, classes, k, percent, shingle, block, long), "linked")
    smallest = classes.join(linked.hint("merge"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    tied = linked.join(smallest.hint("merge"), "component").select("node", "smallest")
    labels = classes.select("node", "least", "times").join(tied.hint("merge"), "node", "left").select(
        "node", "times", F.when(F.col("smallest").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("component_id"))
    known = marks.select("doc_id", "node", "n")
    full = join_unique(known.where("n > 0"), cut_lineage(labels), "node", known.count()).select("doc_id", "n", "component_id")
    every = full.unionByName(known.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
