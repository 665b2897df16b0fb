"""A training corpus from `documents` in five stages, each written and read again before the next.

language: documents without a recognised language, or recognised with little confidence, go.
near_duplicates: of each group of near duplicates one document stays.
repeats: strings of 200 bytes that occur more than once are removed from the texts.
benchmark: documents that contain a benchmark item go.
packing: what is left is packed into token sequences.

All but the last return the columns of their input; nulls, empty tables and repeated rows have the
results that the operators define.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontamination, jaccard, langid, packing, repeats
from millrace.llm.shared import written

LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised with a score of at least LEAST_SCORE.

    A text that is null or has no letter is in no language and goes; repeated rows are judged alike; where
    no row is labelled, nothing is recognised; no row gives no rows. Other columns stay as they are, whatever their names.
    """
    machines = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.keep_recognised(docs, machines, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates, that with the smallest id (null ids last); of equal rows one.

    Null, empty and wordless texts are near nothing and stay, one of equal rows of them; no row gives no rows. Columns
    beginning with `__own_` are the stage's own.
    """
    return jaccard.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove from each text the strings of 200 bytes that occur more than once in what is left; n_chars follows.

    Null texts stay null and are empty for the search; repeated rows are occurrences of their own; a text
    may end up empty and stays; no row gives no rows. Columns beginning with `__own_` are the stage's own.
    """
    cut = repeats.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cut


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item, within one edit in ten bytes, or exactly for short items.

    Null and empty texts contain nothing and stay, as every document does where the benchmark is empty; repeated rows are judged alike.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean_documents(docs, items.select("item_id", "text"), short=True)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 4,096 tokens; a null text is an empty one, repeated rows are packed each."""
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeated_strings),
    ("benchmark", benchmark),
    ("packing", sequences),
]
#: SQL can express neither the classifier nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
