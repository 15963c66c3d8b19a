"""From raw documents to packed training sequences: five stages, each one of the operators in nnfield.llm.

Every stage gets the rows its predecessor kept, written and read again. The first four return the columns of documents.
A table without rows passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nnfield.llm import decontamination, language, packing, simhash, substrings
from nnfield.llm.common import read, stored
from nnfield.session import cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, ``lang`` being the network's prediction; those that are null or have no letter go. Where
    nothing is labelled there is no network, and ``lang`` stays as it is. Null doc_ids are told apart by their text."""
    found = language.identify(docs).where("has_letter").select(
        F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.col("lang_pred").alias("_lang")).dropDuplicates(["_id", "_hash"])
    found = cut_lineage(found)
    same = docs["doc_id"].cast("long").eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"].cast("binary")) == found["_hash"])
    lang = F.when(found["_lang"] == language.UNKNOWN, docs["lang"]).otherwise(found["_lang"])
    return docs.join(found, same).select(*[lang.alias(c) if c == "lang" else docs[c] for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of smallest doc_id."""
    return simhash.representatives(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat an earlier passage; a text that loses all of them stays as an empty one."""
    return substrings.cleaned(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, by the contamination rule."""
    return decontamination.decontaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontaminate),
    ("packing", pack),
]

# Fingerprints, the network and the tokenizer have no form in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
