"""Packing documents into training sequences: first-fit decreasing with a tournament tree, in random groups of pieces.

A document's ids, with an end id, are cut into pieces of ``LENGTH``; full pieces are sequences by themselves, the rest is
packed. Pieces are dealt into groups of about ``GROUP_PIECES`` by a hash of their row number, so that groups are alike
and bounded whatever the documents are, and each group is packed for itself: longest piece first, into the first sequence
with room. The tournament tree over the sequences' free room holds the larger of two below each node, so that the first
sequence with room is found in log2 steps. A group wastes no more than about its last sequence.

Ids are those of the whole text: words between ASCII blanks are encoded once and remembered, which the tokenizer allows,
as it drops blanks and joins nothing across them (tested against whole texts). Ids never leave their task; the pieces carry
their CRC. Nulls: a null text is empty, its one id is the end id. Repeated rows are packed once each.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.llm.common import batches, widest_partitions
from nnfield.session import cut_lineage

LENGTH = 4096
END_ID = 2
GROUP_PIECES = 4096
# Words a worker remembers, at about 200 bytes each, and as many stems at most.
CACHED_WORDS = 400_000
TOKENIZER = "word_bpe_49k.json"

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

# Signs that may follow letters; the apostrophe, digits and < > | begin pieces of their own.
SIGNS = ".,!?*&%$#;:"
# Byte-level vocabularies write a byte that can't be shown as a character from 256 on, in the order of such bytes.
_SHOWN = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}

_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.model, self.signs, self.stems = self.tokenizer.model, {}, {}
        self.bytes_of = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]

    def _plain(self, word: str) -> bytes | None:
        """Ids of Latin-1 letters with signs after them: the normaliser only lower-cases these, and they are one piece of
        letters and one of signs, so the merges can be asked directly. None for all other words."""
        letters = word.rstrip(SIGNS)
        if not letters:
            return self._signs(word)
        if not (letters.isalpha() and max(letters) < "\u0100"):
            return None
        stem = letters.lower()
        ids = self.stems.get(stem)
        if ids is None:
            ids = self.stems[stem] = self._merged(stem if stem.isascii() else stem.encode().decode("latin-1").translate(_SHOWN))
        return ids + self._signs(word[len(letters) :]) if len(letters) < len(word) else ids

    def _signs(self, signs: str) -> bytes:
        ids = self.signs.get(signs)
        if ids is None:
            if len(self.signs) >= 10_000:
                self.signs.clear()
            ids = self.signs[signs] = self._merged(signs) if signs else b""
        return ids

    def _merged(self, piece: str) -> bytes:
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(piece)])

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.known))
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known.clear()
            self.stems.clear()
            new = list(set(chain.from_iterable(words)))
        other = []
        for word in new:
            ids = self._plain(word)
            if ids is None:
                other.append(word)
            else:
                self.known[word] = ids
        for at in range(0, len(other), 20_000):
            few = other[at : at + 20_000]
            for word, found in zip(few, self.tokenizer.encode_batch(few, add_special_tokens=False)):
                self.known[word] = np.array(found.ids, "<u4").tobytes()
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def _encoder(path: str) -> Encoder:
    """One encoder a worker, kept from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(documents: DataFrame, length: int = LENGTH, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the pieces of every document."""
    path = tokenizer or tokenizer_path()
    end = np.array([END_ID], "<u4").tobytes()

    def rows(parts: Iterator[pa.RecordBatch]):
        encoder = _encoder(path)
        for part in parts:
            for at in range(0, part.num_rows, 512):
                few = part.slice(at, 512)
                texts = [t or "" for t in few.column(1).to_pylist()]
                for doc, ids in zip(few.column(0).to_pylist(), encoder.encode(texts)):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        cut = ids[4 * start : 4 * (start + length)]
                        yield doc, start, len(cut) // 4, zlib.crc32(cut), n

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda p: batches(rows(p), _PIECES), _PIECES_SQL)


class Rooms:
    """Tournament tree over the free room of sequences that all begin empty."""

    def __init__(self, most: int, room: int) -> None:
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [room] * (2 * self.leaves)

    def take(self, length: int) -> tuple[int, int]:
        """First sequence with room for ``length``, and its room before."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < length:
                node += 1
        room = tree[node]
        tree[node] = room - length
        at = node
        while at > 1:
            at //= 2
            tree[at] = max(tree[2 * at], tree[2 * at + 1])
        return node - self.leaves, room


def first_fit(lengths: list[int], room: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length, which come longest first and are no longer than a sequence."""
    rooms = Rooms(len(lengths), room)
    places = [rooms.take(n) for n in lengths]
    return [s for s, _ in places], [room - left for _, left in places]


def _pack_groups(length: int):
    """Rows sorted by group and falling length; groups are packed one after the other."""

    def pack(rows: pa.Table) -> pa.RecordBatch:
        group = rows.column("grp")[0].as_py()
        sequence, offset = first_fit(rows.column("length").to_pylist(), length)
        out = [rows.column(c).combine_chunks() for c in _PLACES[:5]]
        return pa.RecordBatch.from_arrays([*out, pa.array(np.array(sequence, np.int64) + (group << 24)), pa.array(np.array(offset, np.int64))], _PLACES)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            group = part.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != int(group[a]):
                    yield pack(pa.Table.from_batches(held))
                    held = []
                held.append(part.slice(a, b - a))
        if held:
            yield pack(pa.Table.from_batches(held))

    return run


def pack(documents: DataFrame, length: int = LENGTH, tokenizer: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    cut = cut_lineage(pieces(documents, length, tokenizer))
    groups = max(1, -(-cut.count() // group_pieces))
    # Row numbers of written rows: the same again when a task is repeated.
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    width = max(widest_partitions(documents.sparkSession), groups // 16)
    return (
        dealt.select("grp", *_PLACES[:5]).repartition(width, "grp").sortWithinPartitions("grp", F.desc("length"), "doc_id", "start")
        .mapInArrow(_pack_groups(length), _PIECES_SQL + ", sequence_id long, offset long")
    )
