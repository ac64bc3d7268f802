"""Validation of a release: differences, rule catalogue, inventories and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (missing, added): distinct rows of only one side, compared as text with null as empty."""
    text = lambda df: df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in a.columns))
    a, b = text(a), text(b)
    missing, added = a.subtract(b).agg(F.count("*").alias("missing")), b.subtract(a).agg(F.count("*").alias("added"))
    return missing.crossJoin(added)


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(change, n) of added, removed, changed and unchanged keys; the other columns tell whether a row changed."""
    row = lambda df, n: df.select(key, F.struct(*(c for c in df.columns if c != key)).alias(n))
    both = row(before, "old").join(row(after, "new"), key, "full")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("changed")
    return both.groupBy(kind.alias("change")).agg(F.count("*").alias("n"))


def _issue(rows: DataFrame, kind: str, severity: Column | str, key: str, description: Column | str) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(F.lit(kind).alias("issue_type"), as_column(severity).alias("severity"), F.col(key).cast("string").alias("record_key"), as_column(description).alias("description"))


def release_issues(roles: DataFrame, nodes: DataFrame, mappings: DataFrame, applicability: DataFrame, rules: DataFrame, grades: DataFrame | None = None, outputs: DataFrame | None = None, release: str | None = None) -> DataFrame:
    """Everything that needs a decision before a release: one rule after the other, as one table.

    `roles` has (role_id, number, title, grade), `nodes` a hierarchy, `mappings` codes of positions, `applicability` and
    `rules` as in `features`, `grades` the known grade labels, `outputs` (name, source_release) of generated tables.
    """
    ids = roles.groupBy("role_id").agg(F.count("*").alias("n"))
    numbers = roles.where("coalesce(number, '') <> ''").groupBy("number").agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))
    parents = nodes.select(F.col("code").alias("parent_code"))
    found = [
        _issue(ids.where("role_id is null or n > 1"), "stable_role_id", "error", "role_id", "the id is blank or used twice"),
        _issue(roles.where("coalesce(number, '') = ''"), "missing_number", "warning", "role_id", "the document number is missing"),
        _issue(numbers.where("n > 1"), "duplicate_number", F.when(F.col("titles") > 1, "error").otherwise("warning"), "number", F.concat(F.lit("used by "), F.col("n").cast("string"), F.lit(" roles"))),
        _issue(applicability.where("applicability_status = 'review_required'"), "capability_applicability", "error", "role_id", "no capability is recorded"),
        _issue(rules.where("interpretation_status = 'review_required'"), "unknown_capability_level", "warning", "raw_level", F.concat(F.lit("used "), F.col("assignment_count").cast("string"), F.lit(" times"))),
        _issue(nodes.where("coalesce(parent_code, '') <> ''").join(parents, "parent_code", "left_anti"), "unknown_parent", "error", "code", "the parent code is unknown"),
        _issue(mappings.join(nodes, "code", "left_anti").select("code").distinct(), "unknown_mapping_code", "warning", "code", "a mapped code is not in the hierarchy"),
    ]
    if grades is not None:
        found.append(_issue(roles.where("grade is not null").join(grades, "grade", "left_anti").select("grade").distinct(), "unknown_grade", "warning", "grade", "the grade label is unknown"))
    if outputs is not None:
        found.append(_issue(outputs.where(~F.col("source_release").eqNullSafe(F.lit(release))), "stale_output", "error", "name", "made from another release"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def issue_summary(issues: DataFrame) -> DataFrame:
    """(issue_type, severity, n)."""
    return issues.groupBy("issue_type", "severity").agg(F.count("*").alias("n"))


def release_status(issues: DataFrame) -> DataFrame:
    """One row (errors, warnings, status): blocked by any error, to be reviewed for warnings, else ready."""
    sums = issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return sums.withColumn("status", F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "review").otherwise("ready"))


def inventory(expected: dict[str, int], **tables: DataFrame) -> DataFrame:
    """(name, expected, actual, difference); the expected counts are a parameter."""
    from .summaries import count_rows

    want = F.create_map(*(x for k, v in expected.items() for x in (F.lit(k), F.lit(v).cast("long"))))
    rows = count_rows(**tables).withColumn("expected", want[F.col("name")])
    return rows.select("name", "expected", F.col("rows").alias("actual"), (F.col("rows") - F.col("expected")).alias("difference"))


def dataset_roles(**tables: DataFrame) -> DataFrame:
    """(name, rows, roles): rows and distinct roles of each data set."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.countDistinct("role_id").alias("roles")).withColumn("name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out.select("name", "rows", "roles")


def unresolved_ends(edges: DataFrame, roles: DataFrame) -> DataFrame:
    """Edges of which either end is unknown."""
    known = lambda c: roles.select(F.col("role_id").alias(c), F.lit(True).alias(f"{c}_known"))
    rows = edges.join(known("role_id"), "role_id", "left").join(known("neighbour_role_id"), "neighbour_role_id", "left")
    return rows.where("role_id_known is null or neighbour_role_id_known is null").select(edges.columns)


def missing_grades(roles: DataFrame, rungs: DataFrame) -> DataFrame:
    """(grade, n): labels in use without a rung."""
    return roles.join(rungs, "grade", "left_anti").groupBy("grade").agg(F.count("*").alias("n"))


def same_release(*tables: DataFrame) -> bool:
    """Whether all tables carry one and the same release and version."""
    out = tables[0].select("source_release", "build_version")
    for t in tables[1:]:
        out = out.unionByName(t.select("source_release", "build_version"))
    return out.distinct().limit(2).count() <= 1


def missing_objects(present: list[str], required: list[str]) -> list[str]:
    return sorted(set(required) - set(present))


def matrix_issues(cells: DataFrame) -> DataFrame:
    """(source, target, issue) of a square tier matrix: unknown tiers, a diagonal that isn't 0, holes, asymmetry."""
    kind = F.when(~F.col("tier").isin(0, 1, 2), "unknown_tier").when((F.col("source") == F.col("target")) & (F.col("tier") != 0), "diagonal")
    bad = cells.select("source", "target", kind.alias("issue")).where("issue is not null")
    flipped = cells.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("tier").alias("back"))
    uneven = cells.join(flipped, ["source", "target"], "left").where("not (tier <=> back)")
    return bad.unionByName(uneven.select("source", "target", F.when(F.col("back").isNull(), "hole").otherwise("asymmetric").alias("issue")))
