"""License scan by conditional compression.

Candidate blocks are the words around each mark of a license in a line, as far as the longest wording reaches; blocks that
overlap are one. Each block is compressed alone and with every wording as a raw zstandard dictionary; the wordings are
ranked by the bytes they save. From the top, a wording is confirmed by its exact differences from the block, word by word:
a wording of fewer than ``SHORT`` words must stand there unchanged, a longer one may differ in ``TOLERANCE`` of its words,
but in none that has a digit or that ``KEY`` names. A block has the first wording that is confirmed, or none; more than one
license in a block is found by scanning the rest of the block again.

The whole text is scanned, row by row without a shuffle. Nulls: a null or empty text has no license; a null doc_id stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from nnfield.llm.common import batches, keyed

SHORT = 12
TOLERANCE = 0.1

_BINARY = "other materials provided with the distribution"
_ENDORSE = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products"
            " derived from this software without specific prior written permission")


def _gnu(kind: str, version: str) -> str:
    return ("is free software: you can redistribute it and/or modify it under the terms of the GNU"
            f" {kind} License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version")


def _stated(name: str) -> tuple[str, str]:
    return f"Licensed under {name}", f"Released under {name}"


# Names of licenses and the wordings by which texts state them. A wording tells its license from its kin: the
# sentence that all BSD licenses share is none.
WORDINGS: dict[str, tuple[str, ...]] = {
    "AGPL-3.0": (*_stated("the GNU Affero General Public License, version 3"), _gnu("Affero General Public", "3")),
    "Apache-2.0": (
        *_stated("the Apache License, Version 2.0"),
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
        " You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-2-Clause": (
        *_stated("the BSD 2-Clause License"),
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer"
        f" in the documentation and/or {_BINARY}. This software is provided by the copyright holders and contributors \"as is\" and any"
        " express or implied warranties",
    ),
    "BSD-3-Clause": (*_stated("the BSD 3-Clause License"), f"{_BINARY}. 3. {_ENDORSE}", f"{_BINARY}. {_ENDORSE}"),
    "BSD-4-Clause": ("All advertising materials mentioning features or use of this software must display the following acknowledgement",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under CC BY version 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Licensed under CC BY-NC version 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Licensed under CC BY-SA version 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        *_stated("the GNU General Public License, version 2"),
        _gnu("General Public", "2"),
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        *_stated("the GNU General Public License, version 3"),
        _gnu("General Public", "3"),
    ),
    "ISC": (
        *_stated("the ISC License"),
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided"
        " that the above copyright notice and this permission notice appear in all copies",
    ),
    "LGPL-2.0": (_gnu("Library General Public", "2"),),
    "LGPL-2.1": (*_stated("the GNU Lesser General Public License, version 2.1"), _gnu("Lesser General Public", "2.1")),
    "LGPL-3.0": (*_stated("the GNU Lesser General Public License, version 3"), _gnu("Lesser General Public", "3")),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction',
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}
# Every wording has one of these, lower-case.
MARKS = (b"licens", b"licenc", b"redistribution and use", b"permission is hereby", b"permission to use", b"redistributions in binary", b"neither the name of", b"all advertising materials")
KEY = frozenset("apache bsd mit gnu mozilla attribution noncommercial sharealike nc sa by cc affero lesser library".split())

_WORD = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*")
_MARK = re.compile(b"|".join(map(re.escape, MARKS)))
_RESULT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("n_blocks", pa.int64()), ("n_confirmed", pa.int64()),
                     ("bytes_saved", pa.int64()), ("words_changed", pa.int64())])
_RESULT_SQL = "doc_id long, license string, n_blocks long, n_confirmed long, bytes_saved long, words_changed long"


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Wording:
    def __init__(self, license_name: str, text: str) -> None:
        self.license, self.words = license_name, words_of(text.encode())
        if not _MARK.search(text.lower().encode()):
            raise ValueError(f"no mark of a license in: {text}")
        joined = b" ".join(self.words)
        self.compressor = zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(joined, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def differences(self, block: list[bytes]) -> tuple[list[bytes], int, int] | None:
        """Words that differ where the wording fits best, and that place; None if nothing is alike."""
        matcher = SequenceMatcher(None, self.words, block, autojunk=False)
        longest = matcher.find_longest_match()
        if not longest.size:
            return None
        slack = max(2, len(self.words) // 10)
        begin = max(0, longest.b - longest.a - slack)
        end = longest.b + len(self.words) - longest.a + slack
        there = block[begin:end]
        codes = SequenceMatcher(None, self.words, there, autojunk=False).get_opcodes()
        while codes and codes[0][0] == "insert":
            codes = codes[1:]
        while codes and codes[-1][0] == "insert":
            codes = codes[:-1]
        if not codes:
            return None
        changed = [w for tag, a, b, c, d in codes if tag != "equal" for w in (*self.words[a:b], *there[c:d])]
        return changed, begin + codes[0][3], begin + codes[-1][4]

    def confirmed(self, changed: list[bytes]) -> bool:
        if len(self.words) < SHORT:
            return not changed
        strict = any(w.decode() in KEY or any(48 <= c <= 57 for c in w) for w in changed)
        return not strict and len(changed) <= TOLERANCE * len(self.words)


class Scanner:
    def __init__(self, wordings: dict[str, tuple[str, ...]] = WORDINGS) -> None:
        self.wordings = [Wording(name, text) for name, texts in wordings.items() for text in texts]
        self.reach = max(len(w.words) for w in self.wordings)
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)

    def blocks(self, text: bytes) -> list[list[bytes]]:
        """Words around the marks of each line; a wording may go over lines, so the reach does too."""
        low = text.lower()
        marks = [m.start() for m in _MARK.finditer(low)]
        if not marks:
            return []
        found = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        out: list[list[int]] = []
        at = 0
        for mark in marks:
            while at < len(found) and found[at][1] <= mark:
                at += 1
            begin, end = max(0, at - self.reach), min(len(found), at + self.reach)
            if out and begin <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([begin, end])
        return [[low[a:b] for a, b in found[begin:end]] for begin, end in out]

    def ranked(self, block: list[bytes]) -> list[tuple[int, Wording]]:
        """Wordings by the bytes they save."""
        joined = b" ".join(block)
        alone = len(self.plain.compress(joined))
        saved = [(alone - len(w.compressor.compress(joined)), k) for k, w in enumerate(self.wordings)]
        return [(s, self.wordings[k]) for s, k in sorted(saved, key=lambda x: (-x[0], x[1]))]

    def scan(self, text: bytes | None) -> tuple[str | None, int, int, int, int]:
        """Licenses joined by +, blocks, confirmed wordings, bytes saved by them, words that differ."""
        names, saved, changed_words, confirmed = set(), 0, 0, 0
        blocks = self.blocks(text or b"")
        rest = list(blocks)
        while rest:
            block = rest.pop()
            for gain, wording in self.ranked(block):
                found = wording.differences(block)
                if found and wording.confirmed(found[0]):
                    changed, begin, end = found
                    names.add(wording.license)
                    confirmed, saved, changed_words = confirmed + 1, saved + gain, changed_words + len(changed)
                    rest += [b for b in (block[:begin], block[end:]) if _MARK.search(b" ".join(b))]
                    break
        return "+".join(sorted(names)) or None, len(blocks), confirmed, saved, changed_words


def scan(documents: DataFrame, wordings: dict[str, tuple[str, ...]] = WORDINGS) -> DataFrame:
    """doc_id, license, n_blocks, n_confirmed, bytes_saved, words_changed of every document."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wordings)

        def rows():
            for part in parts:
                for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
                    yield doc, *scanner.scan(text.as_py())

        return batches(rows(), _RESULT)

    return keyed(documents).select("doc_id", "text").mapInArrow(run, _RESULT_SQL)
