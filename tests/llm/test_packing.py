"""Packing: ids of whole texts, exact round trip, gapless sequences, little padding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from nnfield.llm import packing

TEXTS = ["Hello  World's <|endoftext|> x", "a<|startoftext|>b c d", "é ́x İ ΣΣ ẞ", "tab\tnew\nline\r\nend\x0b\x0c\x1c\x85z",
         "  lead", "", " ", "12 345's don't", "日本語 テキスト", "\x00 null", "a" * 5000, "word " * 9000, "ﬁ ﬀ ½ ²"]


def test_ids_equal_whole_texts():
    rnd = random.Random(1)
    alphabet = [*"aäéßΣ 's't\n\t1!<|>́ ​"]
    texts = TEXTS + ["".join(rnd.choice(alphabet) for _ in range(60)) for _ in range(400)]
    plain = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.Encoder(packing.tokenizer_path())
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_plain_words_equal_the_tokenizer():
    plain, encoder = Tokenizer.from_file(packing.tokenizer_path()), packing.Encoder(packing.tokenizer_path())
    rnd = random.Random(4)
    letters = [chr(c) for c in range(0x100) if chr(c).isalpha()]
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 9))) + "".join(rnd.choice(packing.SIGNS) for _ in range(rnd.randint(0, 4))) for _ in range(4000)]
    words += ["".join(rnd.choice("etaonrish") for _ in range(rnd.randint(1, 12))) for _ in range(2000)] + ["", "...", "a" * 3000, "It's", "x1", "a.b"]
    for word in words:
        ids = encoder._plain(word)
        if ids is not None:
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(word, add_special_tokens=False).ids, word
    assert encoder._plain("It's") is None and encoder._plain("x1") is None and encoder._plain("word!!") is not None


def test_first_fit_is_plain_first_fit():
    rnd = random.Random(2)
    for _ in range(30):
        lengths = sorted((rnd.randint(1, 64) for _ in range(rnd.randint(1, 90))), reverse=True)
        rooms, want = [], []
        for n in lengths:
            k = next((k for k, room in enumerate(rooms) if room >= n), len(rooms))
            if k == len(rooms):
                rooms.append(64)
            want.append((k, 64 - rooms[k]))
            rooms[k] -= n
        assert list(zip(*packing.first_fit(lengths, 64))) == want


def check(rows, docs, length):
    plain = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for doc, text in docs:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        for s in range(0, len(ids), length):
            want[doc, s, len(ids[s : s + length]), zlib.crc32(np.array(ids[s : s + length], "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= length
    return sum(r.length for r in rows) / (length * len(sequences)) if rows else 1


def test_round_trip(docs_of):
    rnd = random.Random(3)
    docs = list(enumerate(TEXTS)) + [(100 + i, "word " * rnd.randint(0, 90)) for i in range(600)] + [(None, None), (None, None), (3, TEXTS[3])]
    table = docs_of(docs).repartition(3)
    assert check(packing.pack(table, 64, group_pieces=300).collect(), docs, 64) > 0.97
    check(packing.pack(table).collect(), docs, 4096)
    assert packing.pack(docs_of([])).collect() == []
