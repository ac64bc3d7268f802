"""A training corpus from the documents: five stages, each an operator of `talentweave.llm` whose decisions take effect.

Stages take (spark, docs, sf_dir) and return a DataFrame; `run` writes each result as a Parquet table in the shared folder
and reads it as the next stage's documents. All but the last return the columns of `documents`.

1. language: documents without a determinable language, or of which no language has half, are left out.
2. near_duplicates: of documents that link at a Jaccard similarity of 0.8 over five-word shingles, directly or through
   others, the one with the smallest id stays (one row of it, if rows repeat).
3. decontamination: documents that hold a benchmark item are left out.
4. mixing: sources are mixed to their target weights; a document appears as often as the mix takes it.
5. token_ids: the mix as token ids in the binary format, read back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talentweave.llm import decontamination, language, mixing, neardup, tokenids
from talentweave.llm.queries import table
from talentweave.llm.scratch import Scratch
from talentweave.shipping import ship

#: The least proportion of a document's main language.
MAIN_LANGUAGE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = language.fit(docs, F.lit(True))
    return language.with_language(docs, model, MAIN_LANGUAGE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return neardup.one_of_each(docs, Scratch(spark, "near"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.copies_of(docs, Scratch(spark, "mixed"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return tokenids.write_and_read(docs, Scratch(spark, "tokens"), public_tokenizers.path(tokenids.VOCABULARY))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("token_ids", to_token_ids),
]

#: Language models, a similarity join and a tokenizer can't be written in SQL; tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
