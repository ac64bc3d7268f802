"""Statements of documents: boilerplate, mapping texts, wrapped lines, roles with their statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, fingerprint, strip_bullet

# Reasons and patterns of boilerplate statements, in the order in which they apply.
BOILERPLATE = (
    ("customer-centred decision boilerplate", r"(?i)\bplace the customer at the centre of all decision making\b"),
    ("safety leadership boilerplate", r"(?i)\b(safety excellence|safety leadership|safe workplace|safety systems and procedures)\b"),
    ("high-performance team boilerplate", r"(?i)\b(high[- ]performance team|core values of integrity,\s*collaboration,\s*excellence|through effective leadership,\s*support and feedback)\b"),
    (
        "performance review/development plan boilerplate",
        r"(?i)\b(individual performance management and development plans|performance management and development plans|regular review of meaningful individual performance)\b",
    ),
)


def boilerplate_reason(text: Column, mandatory: Column, patterns: bool = True) -> Column:
    """Why a statement is boilerplate, or null: it is a mandatory one (a flag), else the first pattern that it matches."""
    reason = F.when(mandatory, "mandatory boilerplate")
    for name, pattern in BOILERPLATE if patterns else ():
        reason = reason.when(collapse(text).rlike(pattern), name)
    return reason


def split_boilerplate(statements: DataFrame, mandatory: DataFrame, text: str = "text", patterns: bool = True) -> DataFrame:
    """Adds `reason`: null for statements to keep. `mandatory` has (text); statements are compared by fingerprint."""
    known = mandatory.select(fingerprint(F.col(text)).alias("_print")).where("_print <> ''").distinct().withColumn("_known", F.lit(True))
    rows = statements.withColumn("_print", fingerprint(F.col(text))).join(known, "_print", "left")
    return rows.withColumn("reason", boilerplate_reason(F.col(text), F.col("_known"), patterns)).drop("_print", "_known")


def mapping_texts(statements: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, full_text, kept, excluded): kept statements as a dashed list in order, and a list of the excluded ones.

    `statements` has (key, sequence, text, reason).
    """
    line = F.struct("sequence", F.concat(F.lit("- "), collapse(F.col("text"))).alias("line"))
    kept = F.sort_array(F.collect_list(F.when(F.col("reason").isNull() & (collapse(F.col("text")) != ""), line)))
    gone = F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("sequence", "reason"))))
    return statements.groupBy(key).agg(
        F.array_join(F.transform(kept, lambda x: x["line"]), "\n").alias("full_text"), F.size(kept).alias("kept"), F.array_join(F.transform(gone, lambda x: F.concat_ws(":", x["sequence"], x["reason"])), "|").alias("excluded")
    )


def section_text(sections: DataFrame, headings: dict[str, str], key: str = "role_id") -> DataFrame:
    """(key, text): the given sections with their headings, in the given order; blank sections are left out."""
    order = F.create_map(*(x for k, n in enumerate(headings) for x in (F.lit(n), F.lit(k))))
    title = F.create_map(*(x for n, h in headings.items() for x in (F.lit(n), F.lit(h))))
    rows = sections.where(F.col("section_name").isin(*headings) & (F.trim("section_text") != ""))
    part = F.struct(order[F.col("section_name")].alias("k"), F.concat(title[F.col("section_name")], F.lit("\n"), F.trim("section_text")).alias("t"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("text"))


def framework_text(nodes: DataFrame) -> DataFrame:
    """(code, text) to embed a node: code, name, level and three definitions; exclusions stay out on purpose."""
    parts = ["code", "name", "level", "main_definition", "supp_definition_1", "supp_definition_2"]
    return nodes.select("code", F.concat_ws("\n", *(F.nullif(F.trim(c), F.lit("")) for c in parts)).alias("text"))


def rejoined(lines: DataFrame, key: str = "doc_id", order: str = "sequence", text: str = "text") -> DataFrame:
    """(key, item, text): a line that begins in lower case continues the line before if that has no closing mark."""
    within = Window.partitionBy(key).orderBy(order)
    before = F.lag(text).over(within)
    continues = before.isNotNull() & ~F.rtrim(before).rlike(r"[.;:!?]$") & F.col(text).rlike(r"^\s*\p{Ll}")
    item = F.sum(F.when(continues, 0).otherwise(1)).over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("item", item)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, F.trim(text).alias("t")))), lambda x: x["t"])
    return rows.groupBy(key, "item").agg(F.array_join(ordered, " ").alias("text"))


def role_statements(roles: DataFrame, items: DataFrame, mandatory: DataFrame) -> DataFrame:
    """(role_id, statements, excluded): cleaned statements of each role without boilerplate; roles without any are left out."""
    rows = split_boilerplate(items, mandatory).withColumn("clean", strip_bullet(F.col("text")))
    keep = F.col("reason").isNull() & F.col("clean").isNotNull()
    texts = F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("sequence", "clean")))), lambda x: x["clean"])
    grouped = rows.groupBy("role_id").agg(texts.alias("statements"), F.count_if(F.col("reason").isNotNull()).alias("excluded"))
    return roles.join(grouped.where(F.size("statements") > 0), "role_id")
