"""Corpus pipeline: quality rules, toxicity, SimHash near-dedup, substring
dedup, packing. Each stage reads what the stage before it wrote.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of ``docs``, whatever
their names. Rows are judged as rows, never looked up by id alone: repeated rows
and rows without an id go through every stage, and an empty table gives an empty
one. A null text counts as the empty text and stays null where it is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.llm import curve_packing, quality_rules, simhash_dedup, substring_dedup, toxicity_mil
from shipledger.llm.common import table, written

#: No SQL says what trained models and tokenisers do; tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hard counts and the trees keep. Empty and null texts go
    (under 20 words); equal texts are kept or go together; without labels only
    the hard counts decide."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or score stays below 0.7. Empty and null texts score
    0 and stay; equal texts stay or go together; without labels of both classes
    all stay."""
    return toxicity_mil.keep_clean(docs, toxicity_mil.fit(docs, table(spark, sf_dir, "labels")), 0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: the one with the smallest
    doc_id, decided row by row (rows without an id come after all others). Empty
    and null texts are one group; of equal rows any one stays."""
    return simhash_dedup.keep_one(docs, shingle=4, distance=4)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without words of 20-word windows that occur earlier; rows
    without an id come after all others. n_chars, where there is one, follows the
    text; null texts stay null, texts that lose nothing stay as they are, and
    equal rows are the same document, none earlier than the other."""
    out = substring_dedup.remove(docs)
    if "n_chars" not in out.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(
        F.length("text")).cast(kind))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens along the Hilbert curve. An empty or
    null text is its end id alone; equal rows are packed each."""
    import public_tokenizers

    return curve_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("simhash near-dedup", near_duplicates),
          ("substring dedup", substrings), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
