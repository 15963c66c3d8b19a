"""Filter interaction audit: what five filters remove alone, together and in every order, per part of the corpus.

Four filters look at one text: A few words, B few distinct words, C many capitals, D special characters. E is an
existential self-join: a document fails if one of smaller doc_id has the same text. It is a left-semi join on the text's hash
and the exact text; what it meets is the smallest doc_id of each text, which exists if any smaller one does, so a text
that a third of all rows have is one row there, and its own rows are dealt under salts. Only texts whose hash repeats are
shuffled. The ids that fail E are united with those that fail the others, the bits are put together by id, and counts by
combination of bits answer every order: a filter removes in some order the combinations that hold it and none of the
filters before it.

Nulls: a null text is an empty one; a null source is the part ''; a null doc_id is neither smaller nor larger than another, so its
row never fails E and has no labels. Repeated rows count each; equal doc_ids are not smaller than each other. A doc_id with
several labels is good or toxic if one of them says so. An empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nnfield.session import cut_lineage

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SPECIAL = "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
# Rows of one text beyond which they are dealt under salts, each for about that many.
ROWS_PER_SALT = 10_000

_SAME_TEXT = 1 << FILTERS.index("E")


def own_failures(documents: DataFrame) -> DataFrame:
    """id, hash, text_bytes, part and bits (of the filters A to D that the text fails) of each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = documents.select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("body"),
    ).select("*", F.regexp_extract_all("body", F.lit(WORD), F.lit(0)).alias("words"))
    counted = words.select(
        "id", "part", "body", F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("n_distinct"),
        F.length("body").alias("n_chars"), F.length(F.regexp_replace("body", "[^A-Z]+", "")).alias("n_capitals"),
    )
    fails = [
        F.col("n") < MIN_WORDS,
        100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n"),
        100 * F.col("n_capitals") > MAX_CAPITALS_PERCENT * F.col("n_chars"),
        F.col("body").rlike(SPECIAL),
    ]
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return counted.select("id", F.xxhash64("body").alias("hash"), "part", bits.cast("int").alias("bits"))


def same_text_failures(documents: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(id, hash), distinct, of the documents whose text also is that of a smaller doc_id."""
    texts = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("body")
    ).select("id", "body", F.xxhash64("body").alias("hash"))
    repeated = texts.groupBy("hash").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("times"))
    repeated = cut_lineage(repeated.where("least < most").select("hash", F.ceil(F.col("times") / rows_per_salt).cast("int").alias("salts")))
    asked = texts.join(repeated, "hash")
    witness = asked.groupBy("hash", "body").agg(F.min("id").alias("smaller"), F.max("salts").alias("salts"))
    witness = witness.select("hash", "body", "smaller", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).alias("w")
    asked = asked.select("*", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt")).alias("d")
    same = (F.col("d.hash") == F.col("w.hash")) & (F.col("d.salt") == F.col("w.salt")) & (F.col("d.body") == F.col("w.body"))
    return asked.join(witness, same & (F.col("w.smaller") < F.col("d.id")), "left_semi").select("id", "hash").distinct()


def combinations(documents: DataFrame, labels: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """part, bits, docs, good, toxic: documents by the combination of filters they fail, and how many are labelled so."""
    own = cut_lineage(own_failures(documents))
    failures = own.where("bits > 0 and id is not null").select("id", "hash", "bits").distinct().unionByName(
        same_text_failures(documents, rows_per_salt).select("id", "hash", F.lit(_SAME_TEXT).alias("bits")))
    together = failures.groupBy("id", "hash").agg(F.bit_or("bits").alias("bits"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = own.withColumnRenamed("bits", "own").join(together, ["id", "hash"], "left").join(marked, "id", "left")
    return rows.groupBy("part", F.coalesce("bits", "own").alias("bits")).agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def _steps(filters: str) -> list[str]:
    """SQL structs (filter_order, step, bit, before) of every filter in every order; ``before`` holds the earlier ones."""
    out = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            name = "".join(filters[i] for i in order)
            out.append(f"named_struct('filter_order', '{name}', 'step', {step}, 'bit', {1 << k}, 'before', {before})")
            before |= 1 << k
    return out


def orders(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step: what is kept after it, removed in it, and by whom else."""
    total = len(_steps(filters))
    several = 1
    for k in range(2, len(filters) + 1):
        several *= k
    # A part's combinations are 2 ** len(filters) rows at most, whatever its documents.
    per_part = found.groupBy("part").agg(F.collect_list(F.struct("bits", "docs", "good", "toxic")).alias("held"))
    steps = per_part.repartition("part").select("part", "held", F.expr(f"inline(array({', '.join(_steps(filters))}))"))
    count = lambda which, what="docs": f"aggregate(filter(held, x -> {which}), 0L, (s, x) -> s + x.{what})"
    here = "x.bits & bit > 0 and x.bits & before = 0"
    columns = {
        "kept": count("x.bits & (before | bit) = 0"),
        "removed": count(here),
        "redundant": count("x.bits & bit > 0 and x.bits & before > 0"),
        "unique_fails": count("x.bits = bit"),
        "good_lost": count(here, "good"),
        "toxic_lost": count(here, "toxic"),
        # among the filters that a document fails each comes first in equally many orders
        "shapley": f"aggregate(filter(held, x -> x.bits & bit > 0), 0L, (s, x) -> s + x.docs * ({several} div bit_count(x.bits)))",
    }
    assert total == several * len(filters)
    return steps.selectExpr("part", "filter_order", "step", *[f"{text} as {name}" for name, text in columns.items()])


def audit(documents: DataFrame, labels: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return orders(combinations(documents, labels, rows_per_salt))
