"""Nested payloads of roles for applications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested(rows: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """(key, name): the rows of each key as a sorted array of structs."""
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def role_payloads(roles: DataFrame, links: DataFrame, capabilities: DataFrame, edges: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(role_id, payload): a JSON document for each role with activities, capabilities and neighbours."""
    parts = [
        nested(links, "role_id", "activities", "activity_rank", "activity"),
        nested(capabilities, "role_id", "capabilities", "capability", "level"),
        nested(edges, "role_id", "neighbours", "neighbour_rank", "neighbour_role_id", "score"),
    ]
    rows = roles
    for p in parts:
        rows = rows.join(p, "role_id", "left")
    if paths is not None:
        rows = rows.join(paths, "code", "left")
    manager = F.col("title").rlike(r"(?i)\b(manager|director|chief|lead)\b")
    shown = [c for c in rows.columns if c != "role_id"]
    return rows.select("role_id", F.to_json(F.struct(F.col("role_id"), *shown, manager.alias("is_manager"))).alias("payload"))


def explorer_summary(roles: DataFrame) -> DataFrame:
    return roles.agg(F.count("*").alias("roles"), F.countDistinct("family").alias("families"), F.countDistinct("rung").alias("grades"))


def reference_tables(roles: DataFrame, links: DataFrame, capabilities: DataFrame, edges: DataFrame, adjacency: DataFrame, families: DataFrame) -> dict[str, DataFrame]:
    """The tables of the explorer's reference contract; the tier of unknown pairs is 2 there, and -1 on the diagonal."""
    pairs = families.select(F.col("family").alias("source")).crossJoin(families.select(F.col("family").alias("target")))
    tier = F.when(F.col("source") == F.col("target"), -1).otherwise(F.coalesce("tier", F.lit(2)))
    total = roles.agg(F.count("*").alias("n"))
    idf = capabilities.groupBy("capability").agg(F.countDistinct("role_id").alias("roles")).crossJoin(total)
    return {
        "roles": roles,
        "edges": edges.select("role_id", "neighbour_role_id", F.bround("score", 4).alias("score")),
        "activities": links.select("activity").distinct(),
        "rarity": idf.select("capability", F.bround(1 - F.col("roles") / F.col("n"), 3).alias("rarity")),
        "adjacency": pairs.join(adjacency, ["source", "target"], "left").select("source", "target", tier.alias("tier")),
    }


def published_fan(pools: DataFrame, versions: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_role_id, candidate_role_id, place, provisional): the pool of the newest published version, or, while none
    is published, the provisional neighbours, marked as such."""
    newest = versions.where("status = 'published'").agg(F.max("version").alias("version")).where("version is not null")
    final = pools.join(newest, "version").select("source_role_id", "candidate_role_id", F.col("rank_default").alias("place"), F.lit(False).alias("provisional"))
    fallback = edges.select(F.col("role_id").alias("source_role_id"), F.col("neighbour_role_id").alias("candidate_role_id"), F.col("neighbour_rank").alias("place"), F.lit(True).alias("provisional"))
    return final.where("place is not null").unionByName(fallback if not newest.head(1) else fallback.limit(0))
