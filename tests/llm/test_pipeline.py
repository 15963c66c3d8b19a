"""The pipeline's stages against brute force, each on its own input."""

import re
import zlib

import corpus_pipeline
from nnfield.llm import language
from test_decontamination import brute as contaminated
from test_packing import check
from test_simhash import plain, smallest
from test_substrings import brute as repeated


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "x", 0), (90_002, "12 !!", "en", "x", 5), (None, "some words here", None, None, None), (90_003, "Tiny.", None, "x", 5)], docs.schema)
    docs = docs.unionByName(extra)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5

    out = stages[0](spark, docs, sf_dir)
    before, rows = docs.collect(), out.cache().collect()
    assert out.columns == docs.columns
    predicted = {(r.doc_id, r.text_hash): r.lang_pred for r in language.identify(docs).collect()}
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(cast(text as binary)) as h").collect()}
    want = [r.asDict() | {"lang": predicted[r.doc_id, hashes[r.doc_id, r.text]]} for r in before if re.search(r"[^\W\d_]", r.text or "")]
    assert sorted(str(r.asDict()) for r in rows) == sorted(map(str, want))
    assert any(r.lang is None for r in before) and all(r.lang not in (None, language.UNKNOWN) for r in rows)

    docs, before = out, rows
    out = stages[1](spark, docs, sf_dir).cache()
    prints = [plain(r.text) for r in before]
    distinct = sorted(set(prints))
    label = smallest(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for r, fp in zip(before, prints):
        if r.doc_id is not None:
            least[label[fp]] = min(least.get(label[fp], r.doc_id), r.doc_id)
    kept = {r.doc_id for r in out.collect()}
    assert kept == {least.get(label[fp]) for fp in prints} and out.columns == docs.columns

    docs, before = out, out.collect()
    out = stages[2](spark, docs, sf_dir).cache()
    after = {r.doc_id: r.text for r in out.collect()}
    want = repeated([(r.doc_id, r.text) for r in before], 20)
    assert len(after) == len(before) and out.columns == docs.columns
    for doc, n, gone, _ in want:
        assert len(after[doc].split()) == n - gone

    docs, before = out, out.collect()
    out = stages[3](spark, docs, sf_dir).cache()
    clean = {r[0] for r in contaminated([(r.doc_id, r.text) for r in before], [tuple(r) for r in bench]) if not r[5]}
    assert {r.doc_id for r in out.collect()} == clean and out.columns == docs.columns

    check(stages[4](spark, out, sf_dir).collect(), [(r.doc_id, r.text) for r in out.collect()], 4096)


def test_run_and_empty_table(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


def test_table_without_labels_keeps_its_documents(spark):
    # The only labelled row is held out.
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for lang in (None, "en"):
        rows = [(held, "words of one", lang, "x", 12), (1000, "ß", None, "x", 1), (1001, "12 --", None, "x", 5), (1002, None, None, "x", 0), (None, "more", None, "x", 4)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(r.text for r in corpus_pipeline.language_id(spark, docs, "").collect()) == ["more", "words of one", "ß"]
