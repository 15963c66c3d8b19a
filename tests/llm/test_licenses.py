"""License scan: exact wordings, small changes, wrong names, and the given lines by plain search."""

import random
import re

from nnfield.llm import licenses

APACHE, MIT = licenses.WORDINGS["Apache-2.0"], licenses.WORDINGS["MIT"]


def test_wordings_and_changes():
    rnd = random.Random(1)
    noise = lambda n: " ".join(rnd.choice(["the", "of", "licensing", "house", "tree"]) for _ in range(n))
    scanner = licenses.Scanner()
    name = lambda text: scanner.scan(text.encode())[0]
    for license_name, texts in licenses.WORDINGS.items():
        for text in texts:
            assert name(text) == license_name, text
            assert name(f"{noise(60)}\n{text.upper()}.\n{noise(200)}") == license_name, text
    long = APACHE[1]
    assert name(long.replace("may not use", "may never use")) == "Apache-2.0"
    assert name(long.replace("2.0", "3.0")) is None
    assert name("Licensed under the Apache Licence of some kind") is None
    assert name("Licensed under CC BY-ND 4.0") is None
    assert name(f"{MIT[0]}. {noise(3)} {APACHE[0]}. {licenses.WORDINGS['GPL-3.0'][0]}") == "Apache-2.0+GPL-3.0+MIT"
    assert scanner.scan(b"a license to print") [:3] == (None, 1, 0)
    assert scanner.scan(None) == scanner.scan(b"") == (None, 0, 0, 0, 0)


def test_kin_and_altered_notices():
    name = lambda text: licenses.Scanner().scan(text.encode())[0]
    start = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
    and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
    and the following disclaimer in the documentation and/or other materials provided with the distribution. """
    neither = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission. """
    end = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING'
    advert = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: Us. "
    assert name(start + end) == name((start + end).replace("must reproduce", "shall reproduce")) == "BSD-2-Clause"
    assert name(start + "3. " + neither + end) == name(start + neither + end) == "BSD-3-Clause"
    assert name(start + advert + "4. " + neither + end) == "BSD-4-Clause"
    gnu = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} License as published
    by the Free Software Foundation; either version {} of the License, or (at your option) any later version."""
    for kind, version, want in (("General Public", "2", "GPL-2.0"), ("General Public", "3", "GPL-3.0"), ("Lesser General Public", "2.1", "LGPL-2.1"), ("Lesser General Public", "3", "LGPL-3.0"), ("Affero General Public", "3", "AGPL-3.0"), ("Library General Public", "2", "LGPL-2.0")):
        assert name(gnu.format(kind, version)) == want
        assert name(gnu.format(kind, version).replace("and/or modify", "or modify")) == want
    assert name("Licensed under the MIT License.") == "MIT" and name("Licensed under CC-BY version 4.0") == "CC-BY-4.0"


def test_given_documents_by_plain_search(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = [(n, " ".join(w.decode() for w in licenses.words_of(t.encode()))) for n, texts in licenses.WORDINGS.items() for t in texts]
    found = {r.doc_id: r.license for r in licenses.scan(docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    for r in rows:
        words = " " + " ".join(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", r.text.lower())) + " "
        want = {n for n, t in short if f" {t} " in words}
        assert found[r.doc_id] == ("+".join(sorted(want)) or None)
    assert sum(v is not None for v in found.values()) > 10


def test_odd_rows(docs_of):
    rows = [(None, None), (1, ""), (1, ""), (2, "license " * 30_000), (3, "Released under the MIT License. " * 400)]
    found = licenses.scan(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.license) for r in found if r.doc_id != 1) == [("2", None), ("3", "MIT"), ("None", None)]
    assert licenses.scan(docs_of([])).collect() == []
