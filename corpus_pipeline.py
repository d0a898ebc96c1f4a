"""Corpus pipeline: from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes a
stage's documents to the shared folder before the next one reads them. All but the last stage
return the columns of `documents`. Models are fitted on the labelled documents that reach a stage;
if none does, the first two stages keep all that they get.

Any column may hold nulls and any stage may get an empty table, which gives an empty one. A null or
empty text is scored like a text without words, has no near duplicate, is left as it is and is packed
as the end id alone. Repeated rows are scored alike and stay or go together, since stages go by
doc_id; rows without doc_id are compared with none. Further columns ride through the first four
stages, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import jaccard, packing, quality, substrings, toxicity
from waymark.llm._common import materialise, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of 0.3 or more)."""
    model = quality.learned(quality, docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, threshold=0.3).filter("predicted = 1").select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic (score below 0.5)."""
    model = quality.learned(toxicity, docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, threshold=0.5).filter("predicted = 0").select(*docs.columns)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Rows without doc_id stay."""
    others = jaccard.join(docs).filter("doc_id != component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words and more that an earlier one has; the others' texts stay as they are."""
    found = substrings.dedup(docs, width=50)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality classifier", keep_good),
    ("toxicity", keep_clean),
    ("n-gram Jaccard join", keep_one),
    ("substring dedup", cut_repeats),
    ("best-fit packing", pack),
]

#: Trained models and packing are not SQL; tests hold the last three stages against brute force on their own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
