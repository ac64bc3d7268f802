"""Grouped summaries, searches and lookups over positions and their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str) -> DataFrame:
    """(key, used): facts of each dimension row, those without any at 0; facts are counted before the join."""
    counts = facts.groupBy(F.col(fact_key).alias(key)).agg(F.count("*").alias("used"))
    return dimension.select(key).join(counts, key, "left").select(key, F.coalesce("used", F.lit(0)).alias("used"))


def framework_usage(assignments: DataFrame) -> DataFrame:
    """(framework, definitions, assignments) of frameworks that are in use."""
    return assignments.groupBy("framework").agg(F.countDistinct("definition").alias("definitions"), F.count("assignment").alias("assignments")).where("assignments > 0")


def child_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Distinct children of each kind for every parent; each kind is counted alone, so that they don't multiply."""
    out = parents.select(key)
    for name, rows in children.items():
        counts = rows.groupBy(key).agg(F.countDistinct("child").alias(name))
        out = out.join(counts, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def repeated(rows: DataFrame, key: str, other: str, least: int = 2) -> DataFrame:
    """(key, n, distinct_other) of keys with several rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct(other).alias("distinct_other")).where(F.col("n") >= least)


def coverage(parents: DataFrame, key: str, cohort: str, **children: DataFrame) -> DataFrame:
    """(cohort, total, and for each kind the parents that have a child of it)."""
    rows = parents.select(key, cohort)
    for name, child in children.items():
        rows = rows.join(child.select(key).distinct().withColumn(name, F.lit(1)), key, "left")
    return rows.groupBy(cohort).agg(F.count("*").alias("total"), *(F.count(n).alias(n) for n in children))


def progress(documents: DataFrame, key: str, *steps: tuple[str, DataFrame], otherwise: str) -> DataFrame:
    """(key, status): the first step that has a row for the document."""
    rows = documents.select(key)
    status = None
    for name, done in steps:
        flag = f"__{name}"
        rows = rows.join(done.select(key).distinct().withColumn(flag, F.lit(True)), key, "left")
        status = F.when(F.col(flag), name) if status is None else status.when(F.col(flag), name)
    return rows.select(key, status.otherwise(otherwise).alias("status"))


def joined_texts(parents: DataFrame, key: str, rows: DataFrame, order: str, text: str, separator: str = "; ") -> DataFrame:
    """(key, texts): the texts of each parent's rows in order, joined; null without rows."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    lists = rows.groupBy(key).agg(F.array_join(ordered, separator).alias("texts"))
    return parents.select(key).join(lists, key, "left")


def keyword_search(rows: DataFrame, word: str, columns: list[str], order: list[Column | str], limit: int = 50) -> DataFrame:
    """Rows with the word in any of the columns, whatever its case; a blank word finds all. The limit is the feature."""
    if word.strip():
        found = None
        for c in columns:
            hit = F.col(c).ilike(f"%{word.strip()}%")
            found = hit if found is None else found | hit
        rows = rows.where(found)
    return rows.orderBy(*order).limit(limit)


def resolve(rows: DataFrame, identifier: str) -> DataFrame:
    """At most one row: `12345` or `12345-01` by number, exact or as a prefix, the newest version first; else by id."""
    import re

    text = identifier.strip()
    if re.fullmatch(r"\d{5}(-\d{2})?", text):
        found = rows.where((F.col("number") == text) | F.col("number").startswith(f"{text}-"))
        return found.orderBy(F.desc("number"), F.desc("id")).limit(1)
    return rows.where(F.col("id") == int(text)).limit(1) if text.isdigit() else rows.limit(0)


def newest_versions(rows: DataFrame) -> DataFrame:
    """The newest version of every base number: (base, number, id)."""
    base = F.split("number", "-")[0]
    order = Window.partitionBy("base").orderBy(F.desc("number"), F.desc("id"))
    return rows.withColumn("base", base).withColumn("place", F.row_number().over(order)).where("place = 1").select("base", "number", "id")


def find_id(rows: DataFrame, identifier: str) -> DataFrame:
    """The smallest id whose id, number or file name prefix is the identifier, one row."""
    hit = (F.col("id").cast("string") == identifier) | (F.col("number") == identifier) | F.col("filename").startswith(identifier)
    return rows.where(hit).agg(F.min("id").alias("id"))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; the aggregate keeps one row for each key and task, so frequent keys don't gather."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("last")).select(key, "last.*")


def multiplicity(left: DataFrame, right: DataFrame, on: str, key: str, value: str) -> DataFrame:
    """(key, candidates, status, match): exact for one candidate, ambiguous for several, unresolved for none."""
    counts = right.groupBy(on).agg(F.countDistinct(value).alias("candidates"), F.min(value).alias("match"))
    rows = left.join(counts, on, "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    status = F.when(F.col("candidates") == 0, "unresolved").when(F.col("candidates") == 1, "exact").otherwise("ambiguous")
    return rows.select(key, "candidates", status.alias("status"), F.when(F.col("candidates") == 1, F.col("match")).alias("match"))


def count_rows(**tables: DataFrame) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def tally(rows: DataFrame, ok: str) -> DataFrame:
    return rows.agg(F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"))
