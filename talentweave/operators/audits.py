"""Readable joins of roles with what was computed for them, and lookups that keep or remove fan-out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_grades(roles: DataFrame, grades: DataFrame) -> DataFrame:
    """Roles with their grade's display label and cohort; labels are few and broadcast, unknown ones give null."""
    return roles.join(grades, "rung", "left")


def with_rank_one(roles: DataFrame, mappings: DataFrame) -> DataFrame:
    """Roles with their rank-1 mappings; a role with two of them appears twice, one without stays."""
    first = mappings.where("mapping_rank = 1").select(F.col("position_id").alias("role_id"), "code")
    return roles.join(first, "role_id", "left")


def with_primary_name(roles: DataFrame, mappings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Roles with the name of their first mapped code, one row each: the scalar lookup is aggregated before the join."""
    named = mappings.join(nodes.select("code", "name"), "code")
    first = named.groupBy(F.col("position_id").alias("role_id")).agg(F.min_by("name", F.struct("mapping_rank", "id")).alias("primary_name"))
    return roles.join(first, "role_id", "left")


def neighbour_audit(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges with the titles of both ends."""
    title = lambda key, name: roles.select(F.col("role_id").alias(key), F.col("title").alias(name))
    return edges.join(title("role_id", "title"), "role_id").join(title("neighbour_role_id", "neighbour_title"), "neighbour_role_id")


def activity_audit(roles: DataFrame, links: DataFrame, statistics: DataFrame) -> DataFrame:
    """Roles, their activities, and the activities' shares where they are known."""
    return roles.select("role_id", "title").join(links, "role_id").join(statistics.select("activity", "share"), "activity", "left")


def capability_audit(roles: DataFrame, capabilities: DataFrame) -> DataFrame:
    return roles.select("role_id", "title").join(capabilities, "role_id")


def overview(roles: DataFrame, links: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(role_id, title, activities, capabilities): counts, 0 where there is nothing; counted before the join."""
    a = links.groupBy("role_id").agg(F.count("*").alias("activities"))
    c = capabilities.groupBy("role_id").agg(F.count("*").alias("capabilities"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return roles.join(a, "role_id", "left").join(c, "role_id", "left").select("role_id", "title", zero("activities"), zero("capabilities"))


def identified(positions: DataFrame, identity: DataFrame) -> DataFrame:
    """Positions with the id and status of the identity table; status is `active` where that has none."""
    rows = positions.join(identity.select("position_id", "role_id", "record_status"), "position_id", "left")
    return rows.withColumn("record_status", F.coalesce("record_status", F.lit("active")))


def unique_in_order(items):
    """An array without repeats, the first of each staying where it is."""
    return F.array_distinct(items)


def table_statistics(**tables: DataFrame) -> DataFrame:
    """(name, rows, distinct_rows) of each table; distinct rows are counted by hash."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.countDistinct(F.sha2(F.to_json(F.struct(*df.columns)), 256)).alias("distinct_rows")).select(F.lit(name).alias("name"), "rows", "distinct_rows")
        out = one if out is None else out.unionByName(one)
    return out
