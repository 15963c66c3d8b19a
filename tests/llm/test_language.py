"""Language ID: gradients against differences, memory against plain runs, held-out accuracy, edge cases."""

import zlib

import numpy as np

from nnfield.llm import language


def test_gradients_match_differences():
    net = language.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    codes = net.codes([b"hello", b"wxyzw", b"aaaaa"], 5)
    labels = np.array([0, 2, 1])
    _, grad = net.gradients(codes, labels)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in w.shape) if name != "E" else (int(rng.choice(list(b"helo wxyz"))), int(rng.integers(0, w.shape[1])))
            old, losses = w[at], []
            for d in (1e-3, -1e-3):
                w[at] = old + d
                losses.append(net.gradients(codes, labels)[0])
            w[at] = old
            assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 2e-4, name


def test_remembered_words_count_as_often_as_they_occur():
    net = language.Network(["a", "b"])
    labels = language._Labels(net, "test")
    words = [b"one", b"two", b"one", "é".encode() * 40, b"three"]
    want = net.words(words).sum(axis=0)
    assert np.allclose(labels.total(words), want, atol=1e-4)


def test_long_runs_are_cut_into_pieces_that_all_count():
    for text in ("中文没有空格" * 30, "донаудампфшифффартсгезельшафт", "a" * 24 + "é", "x" * 100 + " kurz " + "ß" * 25):
        pieces = language.words_of(text.encode())
        assert b"".join(pieces) == text.replace(" ", "").encode() and max(map(len, pieces)) <= language.WORD_BYTES
        assert all(p.decode() for p in pieces)
    assert b"".join(language.words_of(b"\x80" * 100)) == b"\x80" * 100


def test_text_without_blanks_outweighs_a_few_words(spark):
    rng = np.random.default_rng(1)
    signs, words = [chr(0x4E00 + k) for k in range(60)], ["the", "and", "of", "house", "river", "with"]
    rows = [(i, "".join(rng.choice(signs, 150)) if i % 2 else " ".join(rng.choice(words, 40)), ["en", "zh"][i % 2]) for i in range(120)]
    mixed = "".join(rng.choice(signs, 300))
    # Its first pieces are of the other language, and a few English words stand beside them.
    rows += [(900, "the " * 12 + mixed, None), (901, "theriverandhouse" * 2 + mixed, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.predictions(docs).collect()}
    assert found[900] == "zh" and found[901] == "zh"


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 1)
    tongue = [f"l{k:02d}" for k in range(70)]
    # 69 common ones, and one whose only rows have no doc_id or begin with many digits.
    rows = [(100 * k + i, f"{chr(97 + k % 26)}{chr(97 + k // 26)} word", x) for k, x in enumerate(tongue[:-1]) for i in range(9)]
    rows += [(None, "12 " * 2000 + "wort", tongue[-1]), (None, "12", tongue[-1]), (None, None, "none"), (1, "--", "signs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.learn(docs).languages == tongue
    few = language.sample(docs, 1)
    assert {x for _, x in few} == set(tongue) and len(few) <= 2 * 70


def test_memory_of_many_languages_is_bounded(monkeypatch):
    monkeypatch.setattr(language, "CACHED_VALUES", 12)
    net = language.Network(["a", "b", "c"])
    labels = language._Labels(net, "small")
    words = [b"w%d" % (k % 7) for k in range(50)] + [b"w1"]
    assert labels.values.shape == (4, 3) and np.allclose(labels.total(words), net.words(words).sum(axis=0), atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "lang").join(language.predictions(docs), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95


def test_edge_cases(spark, docs_of):
    rows = [(i, "the and of" if i % 2 else "der und das", ["y", "x"][i % 2]) for i in range(200)] + [(550, None, "x"), (551, "12 --", "x"), (552, "", None), (None, "der", None), (553, "ß", None), (554, "der " * 50_000, None)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, score double")
    found = {r.doc_id: r for r in language.predictions(docs).collect()}
    assert len(found) == len(rows)
    assert {found[i].lang_pred for i in (550, 551, 552)} == {"und"} and found[551].score == 0
    assert found[0].lang_pred == "y" and found[1].lang_pred == "x" and found[554].lang_pred == "y" and found[553].lang_pred in "xy"
    assert found[None].held_out is False
    assert language.predictions(docs_of([])).collect() == []
    assert language.predictions(docs_of([(1, "text without a language")])).first().lang_pred == "und"
