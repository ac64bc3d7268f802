"""The registered queries of the operators of this subpackage, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fingerprints, language, mixing, neardup, periodicruns, sortmeans, substrings, tokencounts, tokenids, toxicity
from .scratch import Scratch
from .secrets import BASE, RULES, find_secrets
from ..shipping import ship


#: Tokens above which a document is said to be over the limit.
TOKEN_LIMIT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, folds: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document that the mix of all sources takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), Scratch(spark, "op2"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("p").alias("inclusion"), F.col("quotient").alias("pareto_quotient"))


def op3_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings that also start elsewhere."""
    rows = substrings.remove_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["begin"])
    return rows.select(substrings.original_id(F.col("key")).alias("doc_id"), "n_bytes", size.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents hold, with their best windows; documents without one are not listed."""
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "op4"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies of every document."""
    rows = neardup.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))
    return rows.select(neardup.original_id(F.col("key")).alias("doc_id"), "n_shingles", neardup.original_id(F.col("component")).alias("component_id"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    rows = fingerprints.with_edits(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.as_string(F.col("signature")).alias("fingerprint"),
        fingerprints.as_string(F.col("edited_signature")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        fingerprints.likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as token ids, written in the binary format and read back."""
    import public_tokenizers

    return tokenids.write_and_read(table(spark, sf_dir, "documents"), Scratch(spark, "op7"), public_tokenizers.path(tokenids.VOCABULARY))


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as the chosen one of a preference pair."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rejected = chat.with_other_answers(turns, Scratch(spark, "op8"))
    return chat.format_preferences(turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text"), rejected)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = language.identify(docs, language.fit(docs, ~held_out))
    return found.withColumnRenamed("id", "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and a digest of the base kinds, and all spans."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind.isin(*(r.kind for r in RULES[:BASE])))
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(r.kind) for r in RULES[:BASE]]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, huge ones spliced from overlapping chunks."""
    import public_tokenizers

    rows = tokencounts.count_tokens(table(spark, sf_dir, "documents"), Scratch(spark, "op11"), public_tokenizers.path(tokencounts.VOCABULARY))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds of sort-means."""
    rows = sortmeans.with_inertia(*sortmeans.cluster(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12")))
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", sortmeans.digest(F.col("centroid")).alias("centroid_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, a tenth of which repeat part of themselves, and what is left without them."""
    runs = periodicruns.find_runs(periodicruns.with_repetitions(table(spark, sf_dir, "documents")), "id")
    best = periodicruns.strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = runs.select("id", "runs", "collapsed", best.alias("best"), lines.alias("lines"))
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_mixing": op2_mixing,
    "op3_repeated_substrings": op3_repeated_substrings,
    "op4_decontamination": op4_decontamination,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_ids": op7_token_ids,
    "op8_preferences": op8_preferences,
    "op9_language": op9_language,
    "op10_secret_scan": op10_secret_scan,
    "op11_token_counts": op11_token_counts,
    "op12_sort_means": op12_sort_means,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE,
    "op8_preferences": chat.ORACLE,
    "op12_sort_means": sortmeans.ORACLE,
}
