"""Answers of a model, asked once for each distinct prompt and kept in a table that later runs look into."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import cache_key
from ..lineage import cut

#: Prompts that are asked before their answers are kept, and prompts of one call.
ROUND = 100_000
BATCH = 64
SCHEMA = "key string, answer string"


def kept(spark: SparkSession, path: str) -> DataFrame:
    """(key, answer): what is in the table so far; the first answer by value should two runs have asked at once."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    rows = spark.read.schema(SCHEMA).parquet(path) if there else spark.createDataFrame([], SCHEMA)
    return rows.groupBy("key").agg(F.min("answer").alias("answer"))


def answered(prompts: DataFrame, parts: list[str], ask: Callable[[list[tuple]], list[str | None]], path: str, round_rows: int = ROUND, batch: int = BATCH) -> DataFrame:
    """`prompts` with their `key` and `answer`. The key is a hash over `parts` (model, system text, prompt ..).

    Each distinct key that the table at `path` lacks is asked once: `ask` gets up to `batch` tuples of parts and returns as
    many answers. Rounds of about `round_rows` prompts are appended one after the other, so a run that fails keeps what the
    rounds before have brought, and the next run asks for the rest. Null and blank answers aren't kept, so they are asked
    again by the next run; a null part is empty. Other columns stay as they are.
    """
    spark = prompts.sparkSession
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]
    keyed = prompts.withColumn("key", cache_key(*texts))
    distinct = keyed.select("key", F.struct(*(t.alias(f"p{k}") for k, t in enumerate(texts))).alias("parts")).groupBy("key").agg(F.first("parts").alias("parts"))
    misses = cut(distinct.join(kept(spark, path), "key", "left_anti"))
    rounds = -(-misses.count() // round_rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch):
                some = frame.iloc[first : first + batch]
                answers = ask([tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in some["parts"]])
                if len(answers) != len(some):
                    raise ValueError(f"{len(answers)} answers to {len(some)} prompts")
                yield pd.DataFrame({"key": some["key"], "answer": answers})

    for k in range(rounds):
        own = misses.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == k)
        new = own.mapInPandas(run, SCHEMA)
        new.where("trim(coalesce(answer, '')) <> ''").write.mode("append").parquet(path)
    return keyed.join(kept(spark, path), "key", "left")
