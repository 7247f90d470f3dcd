"""The corpus pipeline: quality, exact dedup, near dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept,
and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's rows as Parquet to the shared folder and reads them back.
SQL can't express the learnt and hashed stages, so there is no ORACLE_SQL; the
tests hold the stages against brute force.

In every stage a null text counts as empty, a very long text is read whole, an empty table gives an empty
one, and columns beside doc_id and text are carried along whatever their names. Quality
scores empty texts by the share of good rows. Of rows alike in every way exact dedup keeps one; near dedup leaves empty
texts, which stand alone, and of rows with one text and doc_id one. Rows with a null doc_id come after all others
when one of a group is to stay, and lose no words to substring dedup, which drops rows of which no word is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.common import keep, table
from fieldloom.llm.exact_dedup import drop_copies
from fieldloom.llm.ngram_join import drop_near_copies
from fieldloom.llm.packing import pack
from fieldloom.llm.quality import keep_good, quality_model
from fieldloom.llm.substring_dedup import strip_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, quality_model(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return strip_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substrings), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
