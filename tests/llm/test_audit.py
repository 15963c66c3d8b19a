"""The filter audit against applying every order of the filters to every document."""

import itertools
import random
import re

from nnfield.llm import audit


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for doc, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows) else set()
        docs.append((source or "", fails, doc in good, doc in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        first = {f: 0 for f in "ABCDE"}
        found = []
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                first[f] += len(removed)
                redundant = sum(f in d[1] and bool(set(order[: step - 1]) & d[1]) for d in mine)
                found.append([part, "".join(order), step, len(left), len(removed), redundant, sum(d[1] == {f} for d in mine),
                              sum(d[2] for d in removed), sum(d[3] for d in removed), f])
        out += [(*r[:-1], first[r[-1]]) for r in found]
    return sorted(out)


def corpus():
    rnd = random.Random(2)
    rows = [(1, None, "a"), (2, "", None), (None, "", "a"), (None, "x", "b"), (3, "x", ""), (3, "x", "b"), (4, "x", "b"), (4, "x", "b"), (5, "\xa0 Å\x0b#", "b")]
    for i in range(10, 150):
        words = [rnd.choice("abcdefgh") if rnd.random() < rnd.choice((0.3, 0.7)) else f"w{rnd.randrange(2000)}" for _ in range(rnd.randint(150, 260))]
        if rnd.random() < 0.3:
            words = [w.upper() for w in words[:40]] + words[40:]
        if rnd.random() < 0.3:
            words.append(rnd.choice(["C#", "50%", "a|b", "R&D"]))
        rows.append((i, " ".join(words), rnd.choice(["a", "b", None])))
        if rnd.random() < 0.3:
            rows.append((rnd.randrange(400), rows[-1][1], rnd.choice(["a", "c"])))
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 140, 2)] + [(10, 1, 1), (10, 0, 0), (None, 1, 1), (3, 1, 1)]
    return rows, labels


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, 1, "x", 2) for i, t, s in rows], "doc_id long, text string, source string, bits int, part string, hash int")
    return docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, source string")


def test_equals_brute_force(spark):
    rows, labels = corpus()
    want = brute(rows, labels)
    for salt in (3, audit.ROWS_PER_SALT):
        found = audit.audit(*tables(spark, rows, labels), salt)
        assert found.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        assert sorted(map(tuple, found.collect())) == want
    kinds = dict(found.dtypes)
    assert kinds["step"] == "int" and all(kinds[c] == "bigint" for c in found.columns[3:])


def test_equal_hashes_are_not_equal_texts(spark, monkeypatch):
    monkeypatch.setattr(audit.F, "xxhash64", lambda *c: audit.F.lit(7).cast("long"))
    docs, _ = tables(spark, [(1, "a", "s"), (2, "b", "s"), (3, "a", "s")], [])
    assert [r.id for r in audit.same_text_failures(docs).collect()] == [3]


def test_a_text_of_most_rows_is_dealt(spark):
    docs, labels = tables(spark, [(i, "same" if i % 3 else f"t{i}", "s") for i in range(3000)], [])
    assert sorted(r.id for r in audit.same_text_failures(docs, 100).collect()) == [i for i in range(3000) if i % 3 and i > 1]


def test_empty_tables(spark):
    docs, labels = tables(spark, [], [])
    assert audit.audit(docs, labels).collect() == []
    docs, _ = tables(spark, [(1, "x", None)], [])
    assert audit.audit(docs, labels).count() == 600
