"""Activity vocabulary: phrases, TF-IDF vectors, clusters, assignment and its quality."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..lineage import consecutive, cut
from . import hierarchy, linkage, similarity, svd

#: Clusters that one task may link to the end; more are merged round by round before.
CLUSTER_ROWS = 3000


def phrase_counts(phrases: DataFrame, least: int = 1) -> DataFrame:
    """(phrase, n, label): rows of each phrase and its most frequent label, the first seen on ties."""
    labels = phrases.groupBy("phrase", "label").agg(F.count("*").alias("k"), F.min("seq").alias("first"))
    best = labels.groupBy("phrase").agg(F.sum("k").alias("n"), F.max_by("label", F.struct("k", -F.col("first"))).alias("label"))
    return best.where(F.col("n") >= least)


def tfidf(texts: DataFrame, key: str, text: str, components: int = 256) -> DataFrame:
    """(key, vector) at unit length: sublinear term frequencies of words and word pairs times inverse frequencies, on their
    `components` leading singular directions (signs are arbitrary), fewer for small tables.

    All terms count. A text without terms, and a null one, has a zero vector; keys are distinct.
    """
    from pyspark.ml.feature import NGram, RegexTokenizer, StopWordsRemover

    rows = texts.select(F.col(key).alias("row"), F.coalesce(text, F.lit("")).alias("_text"))
    for step in (RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2), StopWordsRemover(inputCol="_words", outputCol="_kept"), NGram(n=2, inputCol="_kept", outputCol="_pairs")):
        rows = step.transform(rows)
    counts = rows.select("row", F.explode(F.concat("_kept", "_pairs")).alias("column")).groupBy("row", "column").agg((1 + F.log(F.count("*"))).alias("tf"))
    counts, n = cut(counts), texts.count()
    idf = cut(counts.groupBy("column").agg((F.log((1 + F.lit(n)) / (1 + F.count("*"))) + 1).alias("idf")))
    weighted = counts.join(idf, "column").select("row", "column", (F.col("tf") * F.col("idf")).alias("value"))
    own = Window.partitionBy("row")  # the terms of a text
    unit = cut(weighted.withColumn("value", F.col("value") / F.sqrt(F.sum(F.col("value") * F.col("value")).over(own))))
    terms = idf.count()
    size = min(components, max(2, min(n, terms) - 1))
    vectors = svd.truncated(unit, n, terms, size)[0]
    zero = F.array_repeat(F.lit(0.0), size)
    return rows.select("row").join(vectors, "row", "left").select(F.col("row").alias(key), scoring.unit(F.coalesce("vector", zero)).alias("vector"))


def clustered(vectors: DataFrame, key: str, target: int, local_rows: int = CLUSTER_ROWS) -> DataFrame:
    """(key, cluster): average linkage over cosine distance into min(target, max(2, n / 3)) clusters; see `linkage`.

    Of the tree's n - 1 merges the lowest are made, as if pairs had been merged in this order.
    """
    rows = cut(consecutive(vectors.select(key, "vector"), key, name="id", after=-1))
    n = rows.count()
    wanted = min(target, max(2, n // 3))
    merges = linkage.merges(rows.select("id", "vector"), n, local_rows)
    made = consecutive(merges, "height", "id", name="place").where(F.col("place") <= max(0, n - wanted))
    above = made.select(F.explode(F.array("a", "b")).alias("code"), F.col("id").alias("parent_code"))
    nodes = rows.select(F.col("id").alias("code")).unionByName(made.select(F.col("id").alias("code"))).join(above, "code", "left")
    text = lambda c: F.col(c).cast("string").alias(c)
    roots = hierarchy.depths(nodes.select(text("code"), text("parent_code"))).select(F.col("code").cast("long").alias("id"), F.col("root").alias("cluster"))
    return rows.select(key, "id").join(roots, "id").select(key, "cluster")


def build_vocabulary(members: DataFrame) -> DataFrame:
    """(activity_id, cluster, label, members, raw_count, singletons, rare, least, most) of (cluster, phrase, label, n).

    Larger clusters come first; a cluster is named by its most frequent phrase, and clusters of the same name are one.
    """
    named = members.groupBy("cluster").agg(F.max_by("label", F.struct("n", F.col("phrase"))).alias("label"), F.sum("n").alias("size"))
    rows = members.drop("label").join(named, "cluster")
    merged = rows.groupBy("label").agg(
        F.min("cluster").alias("cluster"),
        F.count("*").alias("members"),
        F.sum("n").alias("raw_count"),
        F.count_if(F.col("n") == 1).alias("singletons"),
        F.count_if(F.col("n") <= 2).alias("rare"),
        F.min("n").alias("least"),
        F.max("n").alias("most"),
    )
    numbered = consecutive(merged, F.desc("raw_count"), F.col("label"), name="place", after=-1)
    number = F.col("place").cast("string")
    return numbered.withColumn("activity_id", F.concat(F.lit("a"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))).drop("place")


def shortlist(roles: DataFrame, activities: DataFrame, k: int = 60) -> DataFrame:
    """(role_id, activity_id, place, similarity): the k nearest activities of each role, by products of blocks."""
    asked = roles.select(F.col("role_id").alias("vec_id"), "vector")
    near = similarity.nearest(asked, activities.select(F.col("activity_id").alias("vec_id"), "vector"), k, others=False)
    return near.select(F.col("query_id").alias("role_id"), F.col("vec_id").alias("activity_id"), "place", "similarity")


def assigned(shortlists: DataFrame, choose: Callable[[list[str]], list[str]] | None = None, fallback: int = 8, most: int = 14, valid: set[str] | None = None, again: Callable[[list[str]], list[str]] | None = None, tries: int = 3) -> DataFrame:
    """(role_id, activity_rank, activity_id, fallback_used, retry_count): chosen activities in order, without repeats, at
    most `most`.

    `choose` may call a model with a role's shortlist. Of an answer the activities of the vocabulary count (`valid`, a few
    hundred ids; without it those of the shortlist). An answer without any, and a call that fails, is asked again with
    `again`, which may add a reminder, up to `tries` calls in all; then the first `fallback` of the shortlist are taken.
    """
    lists = shortlists.groupBy("role_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "activity_id"))), lambda x: x["activity_id"]).alias("options"))
    kind = shortlists.schema["role_id"].dataType.simpleString()
    if choose is None:
        rows = lists.select("role_id", F.slice("options", 1, min(fallback, most)).alias("chosen"), F.lit(True).alias("fallback_used"), F.lit(0).alias("retry_count"))
    else:

        def asked(options: list[str]) -> tuple[list[str], int]:
            known, failed = valid if valid is not None else set(options), 0
            while failed < tries:
                try:
                    answer = (again or choose)(options) if failed else choose(options)
                except Exception:  # a call that fails is one that has said nothing
                    answer = []
                if picks := [x for x in dict.fromkeys(answer) if x in known]:
                    return picks[:most], failed
                failed += 1
            return [], failed

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found = [asked(list(o)) for o in frame["options"]]
                chosen = [p or list(o)[: min(fallback, most)] for (p, _), o in zip(found, frame["options"], strict=True)]
                yield pd.DataFrame({"role_id": frame["role_id"], "chosen": chosen, "fallback_used": [not p for p, _ in found], "retry_count": [n for _, n in found]})

        rows = lists.mapInPandas(run, f"role_id {kind}, chosen array<string>, fallback_used boolean, retry_count int")
    rows = rows.select("role_id", F.posexplode("chosen").alias("p", "activity_id"), "fallback_used", "retry_count")
    return rows.select("role_id", (F.col("p") + 1).alias("activity_rank"), "activity_id", "fallback_used", "retry_count")


def vocabulary_usage(links: DataFrame, vocabulary: DataFrame, roles: DataFrame) -> DataFrame:
    """(activity, role_count, share) of the whole vocabulary, unused activities at 0."""
    total = roles.agg(F.count("*").alias("n"))
    counts = links.groupBy("activity").agg(F.countDistinct("role_id").alias("role_count"))
    rows = vocabulary.select("activity").join(counts, "activity", "left").crossJoin(total)
    return rows.select("activity", F.coalesce("role_count", F.lit(0)).alias("role_count"), F.round(F.coalesce("role_count", F.lit(0)) / F.col("n"), 6).alias("share"))


def matrix(links: DataFrame, activities: list[str]) -> DataFrame:
    """A row for each role with 1 or 0 for each of the given activities; the list is given, so no pass finds it."""
    return links.groupBy("role_id").pivot("activity", activities).agg(F.max(F.lit(1))).fillna(0)


def role_summary(links: DataFrame) -> DataFrame:
    """(role_id, n, activities joined by ` | ` in rank order)."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("activity_rank", "activity"))), lambda x: x["activity"])
    return links.groupBy("role_id").agg(F.count("*").alias("n"), F.array_join(ordered, " | ").alias("activities"))


def profile_quality(links: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row on how well activities tell roles apart: distinct sets, their share, sizes, unused and very common ones."""
    sets = links.groupBy("role_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_set("activity")), "|"), 256).alias("profile"), F.countDistinct("activity").alias("size"))
    per = sets.groupBy("profile").agg(F.count("*").alias("roles"), F.min("size").alias("size"))
    sums = per.agg(F.sum("roles").alias("roles"), F.count("*").alias("distinct_profiles"), F.sum(F.when(F.col("roles") > 1, F.col("roles")).otherwise(0)).alias("roles_sharing"))
    sizes = sets.agg(F.min("size").alias("least"), F.expr("percentile(size, 0.5)").alias("median"), F.max("size").alias("most"))
    used = links.groupBy("activity").agg(F.countDistinct("role_id").alias("n"))
    unused = vocabulary.join(used, "activity", "left_anti").agg(F.count("*").alias("unused"))
    total = sums.crossJoin(sizes).crossJoin(unused)
    common = used.crossJoin(sums.select("roles")).agg(F.count_if(F.col("n") > 0.6 * F.col("roles")).alias("very_common"))
    share = F.round(100 * F.col("distinct_profiles") / F.col("roles"), 6)
    return total.crossJoin(common).withColumn("distinct_percent", share).withColumn("verdict", F.when(share >= 70, "good").otherwise("review"))


def run_summary(assigned_roles: DataFrame) -> DataFrame:
    """Least and most activities of a role, retries and fallbacks, over (role_id, n, retries, fallback_used)."""
    return assigned_roles.agg(F.count("*").alias("roles"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("retries").alias("retries"), F.count_if("fallback_used").alias("fallbacks"))
