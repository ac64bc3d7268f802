"""Features of roles and the rarity of what they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def activity_rarity(links: DataFrame, roles: DataFrame) -> DataFrame:
    """(activity, role_count, share, rarity): share is over active roles, while all roles count as users."""
    active = roles.where("status = 'active'").agg(F.count("*").alias("active_roles"))
    counts = links.groupBy("activity").agg(F.countDistinct("role_id").alias("role_count"))
    share = F.round(F.col("role_count") / F.col("active_roles"), 12)
    rows = counts.crossJoin(active).withColumn("share", F.when(F.col("active_roles") > 0, share).otherwise(0.0))
    return rows.select("activity", "role_count", "share", F.round(1 - F.col("share"), 12).alias("rarity"))


def activity_statistics(rarity: DataFrame) -> DataFrame:
    return rarity.select("activity", "role_count", "share", "rarity").distinct()


def capability_profile(capabilities: DataFrame) -> DataFrame:
    """(role_id, capability, level): the highest level of each focus capability."""
    return capabilities.where("focus and level is not null").groupBy("role_id", "capability").agg(F.max("level").alias("level"))


def capability_levels(capabilities: DataFrame) -> DataFrame:
    """(role_id, capability, level, focus_level): highest level over all and over focus rows."""
    return capabilities.groupBy("role_id", "capability").agg(F.max("level").alias("level"), F.max(F.when(F.col("focus"), F.col("level"))).alias("focus_level"))


def last_focus_level(capabilities: DataFrame, order: str) -> DataFrame:
    """The level of the last focus row of each role and capability."""
    return capabilities.where("focus").groupBy("role_id", "capability").agg(F.max_by("level", order).alias("level"))


def capability_rarity(capabilities: DataFrame, roles: DataFrame) -> DataFrame:
    """(capability, role_count, rarity = 1 - n / N)."""
    total = roles.agg(F.count("*").alias("n_roles"))
    counts = capabilities.groupBy("capability").agg(F.countDistinct("role_id").alias("role_count"))
    return counts.crossJoin(total).select("capability", "role_count", F.round(1 - F.col("role_count") / F.col("n_roles"), 6).alias("rarity"))


def level_rules(assignments: DataFrame) -> DataFrame:
    """(framework, raw_level, normalized_level, assignment_count, interpretation_status) of raw level labels."""
    counts = assignments.groupBy("framework", "raw_level", "normalized_level").agg(F.count("*").alias("assignment_count"))
    return counts.withColumn("interpretation_status", F.when(F.col("normalized_level").isNull(), "review_required").otherwise("mapped"))


def capability_applicability(roles: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(role_id, has_capabilities, has_focus, applicability_status)."""
    flags = capabilities.groupBy("role_id").agg(F.bool_or("focus").alias("has_focus"))
    rows = roles.select("role_id").join(flags.withColumn("known", F.lit(True)), "role_id", "left")
    rows = rows.select("role_id", F.coalesce("known", F.lit(False)).alias("has_capabilities"), F.coalesce("has_focus", F.lit(False)).alias("has_focus"))
    return rows.withColumn("applicability_status", F.when(F.col("has_capabilities"), "applicable").otherwise("review_required"))


def grade_ranks(roles: DataFrame) -> DataFrame:
    """(rung, grade_rank): 0-based order of the distinct rungs. The window sees one row for each rung."""
    rungs = roles.where("rung is not null").select("rung").distinct()
    return rungs.withColumn("grade_rank", F.row_number().over(Window.orderBy("rung")) - 1)


def cluster_weights(links: DataFrame, roles: DataFrame) -> DataFrame:
    """(cluster, roles, weight = max(0.25, ln(N / max(1, roles)))) over the clusters of activities."""
    total = roles.agg(F.count("*").alias("n_roles"))
    counts = links.groupBy("cluster").agg(F.countDistinct("role_id").alias("roles"))
    weight = F.greatest(F.lit(0.25), F.log(F.col("n_roles") / F.greatest(F.lit(1), F.col("roles"))))
    return counts.crossJoin(total).select("cluster", "roles", F.round(weight, 6).alias("weight"))
