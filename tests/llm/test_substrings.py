"""Substring dedup against all windows in a dictionary."""

import hashlib
import random
import re

from nnfield.llm import substrings


def brute(rows, window):
    first = {}
    texts = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        texts.append((doc, words))
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            place = (-1 if doc is None else doc, i)
            first[key] = min(first.get(key, place), place)
    out = []
    for doc, words in texts:
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (-1 if doc is None else doc, i):
                gone.update(range(i, i + window))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


def planted(seed, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    passages = [[rnd.choice(words) for _ in range(rnd.randint(15, 70))] for _ in range(6)]
    rows = []
    for doc in range(n):
        text = []
        for _ in range(rnd.randint(0, 4)):
            if rnd.random() < 0.5:
                p = rnd.choice(passages)
                cut = rnd.randint(0, len(p) // 2)
                text += p[cut:]
            text += [rnd.choice(words) for _ in range(rnd.randint(0, 50))]
        rows.append((doc, " ".join(text)))
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    rows += [(2000, "a " * 300), (2001, "a b " * 90), (2002, "a b " * 40 + "c " * 45), (2003, None), (2004, ""), (2005, "\x0b\x1c \t\n"),
             (2006, "é ü " * 30), (None, rows[3][1]), (2000, "a " * 300), (2007, " ".join(passages[0] * 400))]
    # One doc_id with two texts.
    return rows if seed == 2 else [*rows, (7, "x " + rows[11][1]), (7, " ".join(passages[1]))]


def test_equals_brute_force(docs_of):
    for seed, window, chunk in ((1, 20, 1_000_000), (2, 20, 40), (3, 4, 25)):
        rows = planted(seed)
        found = rows_of(substrings.deduplicate(docs_of(rows).repartition(5), window, chunk))
        assert found == brute(rows, window)


def test_empty_table(docs_of):
    assert substrings.deduplicate(docs_of([])).collect() == []
    assert substrings.cleaned(docs_of([])).collect() == []


def test_cleaned_keeps_rows_and_columns(docs_of):
    rows = planted(5, 40)
    docs = docs_of(rows)
    out = substrings.cleaned(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    kept = {r.doc_id: r for r in out.collect()}
    for doc, n, gone, digest in brute(rows, 20):
        if doc is None or doc == 7:
            continue
        text = kept[doc].text
        if gone:
            assert hashlib.sha256(text.encode()).hexdigest() == digest
            assert kept[doc].n_chars == len(text)
        else:
            assert text == dict(rows)[doc]
