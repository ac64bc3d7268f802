"""Governed reference data: workbooks of a framework with its mappings and adjacency matrix, document imports, embeddings,
activity links, crosswalks, grade references, and payloads made of them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import consecutive, cut
from . import hierarchy
from .releases import replace_children

#: Codes of a role's mappings, by rank.
SLOTS = ("primary_code", "secondary_code", "secondary_2_code")
#: Positions that share a copy of a roster's text in payloads.
PER_COPY = 50


def _filled(column: str) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) != ""


# --- workbooks --------------------------------------------------------------------------------------------------------


def workbook_issues(framework: DataFrame, cells: DataFrame, mappings: DataFrame, numbers: DataFrame) -> DataFrame:
    """(rule, severity, record): everything that is wrong with a workbook, all rules as one table.

    `framework` has (sequence, code, name, level, parent_code), `cells` (row, column, source, target, tier) of the matrix,
    rows and columns counted from 1, `mappings` (pd_id, the three slots), `numbers` (number) of known documents. Blank
    codes are empty or null. Errors refuse the workbook, warnings don't.
    """
    known = framework.where(_filled("code")).select("code").distinct()
    families = framework.where(F.lower(F.trim("level")) == "job family").select("sequence", "code")
    order = Window.orderBy("sequence")  # of job families: a few rows
    families = families.withColumn("place", F.row_number().over(order)).select("place", "code")
    heads = {"column_order": cells.where("row = 1").select(F.col("column").alias("place"), F.col("target").alias("head")), "row_order": cells.where("column = 1").select(F.col("row").alias("place"), F.col("source").alias("head"))}
    slots = mappings.select("pd_id", F.explode(F.array(*SLOTS)).alias("code")).where(_filled("code"))
    pair = F.concat_ws(" > ", "source", "target")
    last = cells.groupBy("source", "target").agg(F.max_by("tier", F.struct("row", "column")).alias("tier"))
    back = last.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("tier").alias("back"))
    base = numbers.where(_filled("number")).select(F.split("number", "-")[0].alias("pd_id")).distinct()
    n_families, n_cells = families.agg(F.count("*").alias("n")), cells.agg(F.count("*").alias("cells"))
    found = {
        ("duplicate_code", "error"): framework.groupBy("code").count().where("count > 1").select("code"),
        ("incomplete_row", "error"): framework.where(~(_filled("code") & _filled("name") & _filled("level"))).select(F.col("sequence").cast("string")),
        ("unknown_parent", "error"): framework.where(_filled("parent_code")).join(known.withColumnRenamed("code", "parent_code"), "parent_code", "left_anti").select("code"),
        ("cycle", "error"): hierarchy.endless(framework.where(_filled("parent_code"))).select("code"),
        ("no_family", "error"): n_families.where("n = 0").select(F.lit("")),
        **{(rule, "error"): families.join(head, "place", "full").where("not (code <=> head)").select(F.col("place").cast("string")) for rule, head in heads.items()},
        ("cell_count", "error"): n_families.crossJoin(n_cells).where("cells <> n * n").select(F.col("cells").cast("string")),
        ("duplicate_cell", "error"): cells.groupBy("source", "target").count().where("count > 1").select(pair),
        ("unknown_tier", "error"): cells.where("tier is null or tier not in (0, 1, 2)").select(pair),
        ("diagonal", "error"): cells.where("source = target and not (tier <=> 0)").select(pair),
        ("asymmetric", "warning"): last.join(back, ["source", "target"]).where("source < target and back in (0, 1, 2) and not (tier <=> back)").select(pair),
        ("duplicate_mapping", "error"): mappings.where(_filled("pd_id")).groupBy("pd_id").count().where("count > 1").select("pd_id"),
        ("mapping_without_id", "error"): mappings.where(~_filled("pd_id")).select(F.lit("")),
        ("no_primary", "error"): mappings.where(~_filled("primary_code")).select("pd_id"),
        ("repeated_code", "error"): slots.groupBy("pd_id", "code").count().where("count > 1").select("pd_id").distinct(),
        ("unknown_code", "error"): slots.join(known, "code", "left_anti").select(F.concat_ws(":", "pd_id", "code")),
        ("unlinked", "warning"): mappings.where(_filled("pd_id")).select("pd_id").distinct().join(base, "pd_id", "left_anti").select("pd_id"),
    }
    tables = [df.toDF("record").select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.coalesce("record", F.lit("")).alias("record")) for (rule, severity), df in found.items()]
    return reduce(DataFrame.unionByName, tables)


def sheet_changes(sheet: str, current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """(sheet, current, incoming, added, removed, changed): rows of one sheet by key; columns beside the keys tell whether a
    row changed. Of repeated keys one row counts."""
    side = lambda df, name: df.dropDuplicates(keys).select(*keys, F.struct(F.lit(True).alias("there"), *(c for c in df.columns if c not in keys)).alias(name))
    both = side(current, "a").join(side(incoming, "b"), keys, "full")
    old, new = F.col("a").isNotNull(), F.col("b").isNotNull()
    counts = {"current": old, "incoming": new, "added": new & ~old, "removed": old & ~new, "changed": old & new & ~F.col("a").eqNullSafe(F.col("b"))}
    return both.agg(*(F.count_if(c).alias(name) for name, c in counts.items())).select(F.lit(sheet).alias("sheet"), *counts)


def workbook_preview(current: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> DataFrame:
    """What applying a workbook would change, a row for each of its sheets: `framework` by code, `mappings` as the set of
    (position, rank, code), `adjacency` by source and target. Both sides name their tables by sheet; blank mapping codes
    are no assignments."""
    assigned = lambda df: df.where(_filled("code")).select("position_id", "mapping_rank", "code")
    rows = sheet_changes("framework", current["framework"], incoming["framework"], ["code"])
    rows = rows.unionByName(sheet_changes("mappings", assigned(current["mappings"]), assigned(incoming["mappings"]), ["position_id", "mapping_rank", "code"]))
    return rows.unionByName(sheet_changes("adjacency", current["adjacency"], incoming["adjacency"], ["source", "target"]))


def apply_workbook(framework: DataFrame, cells: DataFrame, mappings: DataFrame, positions: DataFrame, batch_id: int, last_entry: int = 0, last_mapping: int = 0) -> dict[str, DataFrame]:
    """The tables that an accepted workbook replaces the active ones with.

    `entries` and `mappings` are numbered on behind the last ids, in workbook order; a mapped role goes to every position
    whose number begins with its id, or to none (a null position). `assigned` is empty: manual overrides end with an import.
    """
    batch = F.lit(batch_id).cast("long").alias("batch_id")
    entries = framework.select((F.col("sequence") + last_entry).cast("long").alias("id"), batch, "sequence", "code", "name", "level", F.nullif("parent_code", F.lit("")).alias("parent_code"))
    label = F.coalesce(F.nullif("number", F.lit("")), "filename", F.lit(""))
    targets = positions.select("position_id", F.split(label, "-")[0].alias("pd_id"))
    slot = F.explode(F.array(*(F.struct(F.lit(k).alias("mapping_rank"), F.col(c).alias("code")) for k, c in enumerate(SLOTS, 1))))
    rows = mappings.join(targets, "pd_id", "left").select("sequence", "pd_id", "position_id", "validated", slot.alias("slot")).select("*", "slot.*").where(_filled("code"))
    rows = rows.join(framework.select("code", "name", "level"), "code")
    rows = consecutive(rows, F.col("sequence"), F.col("position_id"), F.col("mapping_rank"), after=last_mapping)
    return {
        "entries": entries,
        "mappings": rows.select("id", batch, "position_id", "pd_id", "mapping_rank", "code", "name", "level", "validated", F.lit(1).alias("code_valid")),
        "adjacency": cells.select(batch, "source", "target", "tier"),
        "assigned": rows.select("position_id", "mapping_rank", "code").limit(0),
    }


# --- links, crosswalks, comparisons -----------------------------------------------------------------------------------


def read_links(rows: DataFrame, roles: DataFrame) -> dict[str, DataFrame]:
    """Activity links of a sheet (place, pd_id, activity_id, label, activity_rank) against `roles` (position_id, role_id).

    Rows without an activity are skipped. `activities`: the first row of each activity gives its label; `links`: rows whose
    position is a known whole number; `unresolved`: the other position ids, as often as they come.
    """
    rows = rows.where(_filled("activity_id"))
    activities = rows.groupBy("activity_id").agg(F.min_by("label", "place").alias("label"))
    number = F.regexp_extract(F.trim("pd_id"), r"^([+-]?[0-9]+)$", 1)
    typed = rows.withColumn("position_id", F.nullif(number, F.lit("")).try_cast("long"))
    both = typed.join(roles.select("position_id", "role_id"), "position_id", "left")
    return {
        "activities": activities,
        "links": both.where("role_id is not null").select("place", "role_id", "position_id", "activity_id", "activity_rank"),
        "unresolved": both.where("role_id is null").select("place", "pd_id"),
    }


def crosswalk(legacy: DataFrame, positions: DataFrame) -> DataFrame:
    """(legacy_id, title, role_id, match_status): exact where a legacy row's id and title are those of one position.

    `legacy` has (place, pd_id, title); of rows with the same id the last one counts.
    """
    last = legacy.groupBy("pd_id").agg(F.max_by("title", "place").alias("title"))
    number = F.when(F.col("pd_id").rlike("^[0-9]+$"), F.col("pd_id").try_cast("long"))
    known = positions.select(F.col("position_id").alias("number"), F.col("title").alias("known_title"), F.col("role_id").alias("known_role"))
    exact = F.coalesce(F.col("title") == F.col("known_title"), F.lit(False))
    rows = last.withColumn("number", number).join(known, "number", "left")
    return rows.select(F.col("pd_id").alias("legacy_id"), "title", F.when(exact, F.col("known_role")).alias("role_id"), F.when(exact, "exact").otherwise("unresolved").alias("match_status"))


def compared_outputs(before: DataFrame | None, after: DataFrame, edges_before: int | None, edges_after: int) -> DataFrame:
    """(name, change, edge_change): outputs (name, hash) that changed, are new or were removed, with the difference in edges;
    without a release before, all are changed and the difference is null."""
    delta = F.lit(None if before is None or edges_before is None else edges_after - edges_before).cast("long").alias("edge_change")
    if before is None:
        return after.select("name", F.lit("changed").alias("change"), delta)
    both = before.select("name", F.col("hash").alias("old")).join(after.select("name", F.col("hash").alias("new")), "name", "full")
    change = F.when(F.col("new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select("name", change.alias("change"), delta).where("change is not null")


# --- grade references -------------------------------------------------------------------------------------------------


def seeded_labels(positions: DataFrame, references: DataFrame, label: str = "grade") -> DataFrame:
    """(raw_label, usage_count, is_new): labels in use that aren't blank, most used first; new ones have no reference yet."""
    used = positions.where(_filled(label)).groupBy(F.col(label).alias("raw_label")).agg(F.count("*").alias("usage_count"))
    known = references.select("raw_label", F.lit(False).alias("is_new"))
    return used.join(known, "raw_label", "left").withColumn("is_new", F.coalesce("is_new", F.lit(True))).orderBy(F.desc("usage_count"), "raw_label")


def listed_references(references: DataFrame, positions: DataFrame, label: str = "grade") -> DataFrame:
    """References with their usage, zero kept: known orders first, in order, then by label."""
    used = positions.groupBy(F.col(label).alias("raw_label")).agg(F.count("*").alias("usage_count"))
    rows = references.join(used, "raw_label", "left").withColumn("usage_count", F.coalesce("usage_count", F.lit(0)))
    return rows.orderBy(F.asc_nulls_last("seniority_order"), "display_label", "raw_label")


def updated_references(references: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(backup, updated): the references as JSON lines as they were, and with the edits of the same label taken over.

    Edited texts are trimmed, a missing `active` is 1; edits of unknown labels change nothing; of repeated edits the last
    `place` counts.
    """
    backup = references.select(F.to_json(F.struct(*references.columns), {"ignoreNullFields": "false"}).alias("json"))
    texts = [c for c in references.columns if c not in ("raw_label", "active") and references.schema[c].dataType.typeName() == "string"]
    others = [c for c in references.columns if c not in ("raw_label", "active", *texts)]
    last = edits.groupBy(F.trim("raw_label").alias("raw_label")).agg(F.max_by(F.struct(*texts, *others, "active"), "place").alias("edit"))
    rows = references.join(last, "raw_label", "left")
    new = {c: F.trim(F.coalesce(F.col(f"edit.{c}"), F.lit(""))) for c in texts} | {c: F.col(f"edit.{c}") for c in others} | {"active": F.coalesce("edit.active", F.lit(1)).cast(references.schema["active"].dataType)}
    taken = [F.when(F.col("edit").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in references.columns]
    return backup, rows.select(taken)


def capability_order(capabilities: DataFrame) -> DataFrame:
    """(name, first_id): names that aren't empty in the order of their first id."""
    return capabilities.where("coalesce(name, '') <> ''").groupBy("name").agg(F.min("capability_id").alias("first_id")).orderBy("first_id")


def by_title(roles: DataFrame) -> DataFrame:
    """Roles with an id by lower-case title, then by id."""
    return roles.where("coalesce(cast(role_id as string), '') <> ''").orderBy(F.lower("title"), "role_id")


# --- documents, embeddings, extraction --------------------------------------------------------------------------------

CHILDREN = ("fields", "items", "relationships", "capabilities", "issues")


def import_documents(current: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """The document tables after an import of extracted records (path, arrived, title, status, sections, the CHILDREN arrays).

    A document keeps its id for as long as its path stays the same; of records of one path the last one counts. Children
    are replaced as a whole, also by none. `drafts` (document_id, extracted, draft, status, edited): the extraction is
    renewed always, the draft only while nobody has touched or validated it. Twice the same import gives the same.
    """
    arrays = [c for c in CHILDREN if c in records.columns]
    last = records.groupBy("path").agg(F.max_by(F.struct("title", "status", "sections", *arrays), "arrived").alias("r")).select("path", "r.*")
    known = current["documents"].select("path", F.col("document_id"))
    top = current["documents"].agg(F.coalesce(F.max("document_id"), F.lit(0))).first()[0]
    new = consecutive(last.join(known, "path", "left_anti").select("path"), "path", name="document_id", after=top)
    rows = cut(last.join(known.unionByName(new.select("path", "document_id")), "path"))
    out = {"documents": replace_children(current["documents"], rows.select(current["documents"].columns), "path")}
    ids = rows.select("document_id")

    def replaced(name: str, fresh: DataFrame) -> DataFrame:
        return current[name].join(ids, "document_id", "left_anti").unionByName(fresh.select(current[name].columns))

    out["sections"] = replaced("sections", rows.select("document_id", F.explode("sections").alias("section_name", "section_text")).where(_filled("section_text")))
    for name in arrays:
        out[name] = replaced(name, rows.select("document_id", F.explode(name).alias("x")).select("document_id", "x.*"))
    extracted = rows.select("document_id", F.to_json(F.struct(*(c for c in rows.columns if c != "document_id"))).alias("new"))
    both = extracted.join(current["drafts"], "document_id", "left")
    touched = (F.col("status") != "Not validated") | (F.coalesce("edited", F.lit("[]")) != "[]")
    fresh = both.select("document_id", F.col("new").alias("extracted"), F.when(touched, F.col("draft")).otherwise(F.col("new")).alias("draft"), F.coalesce("status", F.lit("Not validated")).alias("status"), F.coalesce("edited", F.lit("[]")).alias("edited"))
    out["drafts"] = replaced("drafts", fresh)
    return out


def embedding_sources(rows: DataFrame, text: str = "full_text") -> DataFrame:
    """Rows whose text isn't blank."""
    return rows.where(_filled(text))


def embedded(stored: DataFrame, sources: DataFrame, encode: Callable[[list[str]], list], model: str, batch: int = 32) -> DataFrame:
    """`stored` (source_type, source_id, model, dimension, text_hash, vector) with vectors of `sources` (source_type, source_id,
    text) by `encode`, in batches; an entry of the same source and model is replaced. Vectors are kept at length 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch].reset_index(drop=True)
                vectors = [[float(y) for y in x] for x in encode(part["text"].tolist())]
                norms = [sum(y * y for y in x) ** 0.5 or 1.0 for x in vectors]
                yield part.assign(vector=[[y / n for y in x] for x, n in zip(vectors, norms, strict=True)])

    last = sources.dropDuplicates(["source_type", "source_id"])
    kinds = {c: sources.schema[c].dataType.simpleString() for c in ("source_type", "source_id", "text")}
    fresh = last.select("source_type", "source_id", "text").mapInPandas(run, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", vector array<double>")
    fresh = fresh.select("source_type", "source_id", F.lit(model).alias("model"), F.size("vector").alias("dimension"), F.sha2("text", 256).alias("text_hash"), "vector")
    keys = ["source_type", "source_id", "model"]
    gone = last.select("source_type", "source_id", F.lit(model).alias("model"))
    return stored.join(gone, keys, "left_anti").unionByName(fresh.select(stored.columns))


def clean_activities(answer: str | None) -> list[dict]:
    """Activities of a model's answer: labels trimmed, the match label in lower case; without one an activity is dropped."""
    text = answer or ""
    try:
        found = json.loads(text[text.index("{") : text.rindex("}") + 1]).get("activities") or []
    except (ValueError, AttributeError):
        return []
    out = []
    for x in found if isinstance(found, list) else ():
        label = str((x or {}).get("match_label") or "").strip().lower() if isinstance(x, dict) else ""
        if label:
            out.append({"match_label": label, "plain_label": str(x.get("plain_label") or "").strip() or label})
    return out


def extracted_activities(prompts: DataFrame, complete: Callable[[str], str], reminder: str, retries: int = 2) -> DataFrame:
    """(role_id, retry_count, activities): answers to (role_id, prompt); an answer without activities is asked again with the
    reminder behind the prompt, `retries` times at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for role, prompt in zip(frame["role_id"], frame["prompt"], strict=True):
                found, tries = clean_activities(complete(prompt)), 0
                while not found and tries < retries:
                    tries += 1
                    found = clean_activities(complete(f"{prompt}\n\n{reminder}"))
                out.append((role, tries, found))
            yield pd.DataFrame(out, columns=["role_id", "retry_count", "activities"])

    kind = prompts.schema["role_id"].dataType.simpleString()
    return prompts.select("role_id", "prompt").mapInPandas(run, f"role_id {kind}, retry_count int, activities array<struct<match_label:string,plain_label:string>>")


# --- facts and payloads -----------------------------------------------------------------------------------------------


def capability_facts(assignments: DataFrame, positions: DataFrame, definitions: DataFrame, frameworks: DataFrame, identities: DataFrame, rules: DataFrame) -> DataFrame:
    """Capabilities of roles: assignments with their position, definition, framework and identity, all of which must exist,
    and the rule for a framework's level, which need not. An identity names its definition as text."""
    rows = assignments.join(positions.select("position_id", "role_id"), "position_id").join(definitions, "definition_id").join(frameworks, "framework_id")
    named = identities.select(F.col("source_capability_id").try_cast("long").alias("definition_id"), "capability_id")
    known = rules.select("framework_name", F.col("raw_level").alias("required_level"), "normalized_level")
    rows = rows.join(named, "definition_id").join(known, ["framework_name", "required_level"], "left")
    return rows.select("role_id", "capability_id", "assignment_id", "framework_name", "capability_name", "required_level", "normalized_level")


def yes_no(flag: Column) -> Column:
    return F.when(flag == 1, "Yes").otherwise("No")


def export_counters(roles: DataFrame, capabilities: DataFrame, statements: DataFrame, grades: DataFrame) -> DataFrame:
    """One row: roles, and how many have focus capabilities, key statements and a grade with an order; and the levels in use,
    null first, joined by commas."""
    ids = roles.select("role_id").distinct()
    having = lambda df, n: df.select("role_id").distinct().join(ids, "role_id", "left_semi").agg(F.count("*").alias(n))
    ordered = roles.join(grades.where("seniority_order is not null").select("grade").distinct(), "grade", "left_semi")
    levels = F.array_join(F.sort_array(F.collect_set(F.coalesce("level", F.lit("")))), ",")
    used = capabilities.join(ids, "role_id", "left_semi").agg(levels.alias("levels"))
    total = roles.agg(F.count("*").alias("roles"))
    parts = [having(capabilities.where(F.lower("kind") == "focus"), "with_focus"), having(statements, "with_statements"), ordered.agg(F.count("*").alias("with_order")), used]
    return reduce(DataFrame.crossJoin, parts, total)  # one row each


def explorer_rows(positions: DataFrame, primary: DataFrame, references: DataFrame, paths: DataFrame, purposes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """One row for each position: grade, primary mapping, names along its path, purpose, and focus capabilities in order,
    each once. `paths` is what `hierarchy.paths` gives; unmapped positions have the family name `Unmapped`."""
    levels = hierarchy.names_by_level(paths).join(hierarchy.path_text(paths).select("code", "path"), "code")
    first = capabilities.where(F.lower(F.coalesce("kind", F.lit(""))).contains("focus") & _filled("name")).groupBy("position_id", "name").agg(F.min("sequence").alias("sequence"))
    lists = first.groupBy("position_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sequence", "name"))), lambda x: x["name"]).alias("capabilities"))
    grade = references.select(F.col("raw_label").alias("grade"), "display_label", "abbreviation", "seniority_order")
    rows = positions.join(grade, "grade", "left").join(primary.select("position_id", "code"), "position_id", "left").join(levels, "code", "left").join(purposes.select("position_id", "purpose"), "position_id", "left").join(lists, "position_id", "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    label = F.coalesce(F.nullif("display_label", F.lit("")), F.nullif("abbreviation", F.lit("")), F.col("grade"), F.lit(""))
    return rows.select(
        "position_id",
        "title",
        label.alias("grade_label"),
        "seniority_order",
        empty("code"),
        F.coalesce("family_name", F.lit("Unmapped")).alias("family_name"),
        empty("sub_family_name"),
        empty("path"),
        F.col("title").rlike(r"(?i)\b(manager|director|chief|lead)\b").alias("manager_role"),
        empty("purpose"),
        F.coalesce("capabilities", F.array().cast("array<string>")).alias("capabilities"),
    )


def assistant_payloads(positions: DataFrame, assigned: DataFrame, paths: DataFrame, tree: DataFrame, roster: DataFrame, executive: str = "(?i)executive", per_copy: int = PER_COPY) -> DataFrame:
    """(position_id, payload): for each position its own mapping as names from the root, whether it is an executive one, the
    guide's families with the nodes under them, and the roles that are under these codes already, as one JSON document.

    `assigned` has (position_id, code) of the first mapping, `tree` is what `guide_tree` gives (query_id is the position),
    `roster` what `similarity.roster` gives, `executive` the pattern of executive cohorts and grades. Families come by place; a code without roles isn't in the roster.

    Positions that show the same codes share one roster: its text is made once, and joined last, a copy for every `per_copy`
    positions. So what is shuffled grows with the rosters that differ, not with the payloads.
    """
    current = assigned.join(hierarchy.path_text(paths).select("code", F.regexp_replace("path", " > ", " → ").alias("current")), "code", "left").select("position_id", "current")
    tree, roster = cut(tree), cut(roster)
    node = F.struct("place", "node", "score")
    families = tree.groupBy(F.col("query_id").alias("position_id"), "family", "family_place").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    families = families.groupBy("position_id").agg(F.sort_array(F.collect_list(F.struct("family_place", "family", "nodes"))).alias("families"))
    codes = tree.select(F.col("query_id").alias("position_id"), F.explode(F.array("family", "node")).alias("code")).join(roster.select("code"), "code", "left_semi")
    lists = cut(codes.groupBy("position_id").agg(F.array_sort(F.collect_set("code")).alias("codes")))
    sets = lists.groupBy("codes").agg(F.ceil(F.count("*") / per_copy).alias("copies"))
    texts = sets.select("codes", F.explode("codes").alias("code")).join(roster, "code").groupBy("codes").agg(F.to_json(F.sort_array(F.collect_list(F.struct("code", "total", "roles")))).alias("roster"))
    texts = texts.join(sets, "codes").select("codes", "roster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    lists = lists.join(sets, "codes").select("position_id", "codes", F.pmod(F.xxhash64("position_id"), F.col("copies")).alias("copy"))
    rows = positions.join(current, "position_id", "left").join(families, "position_id", "left").join(lists, "position_id", "left")
    is_executive = F.concat_ws("\n", "cohort", "grade").rlike(executive)
    shown = F.struct("position_id", "title", F.coalesce("grade", F.lit("")).alias("grade"), F.coalesce("current", F.lit("Unmapped")).alias("current"), is_executive.alias("executive"), "families")
    rows = rows.select("position_id", "codes", "copy", F.to_json(shown).alias("own")).join(texts.hint("merge"), ["codes", "copy"], "left")
    with_roster = F.concat(F.expr("left(own, length(own) - 1)"), F.lit(',"roster":'), "roster", F.lit("}"))
    return rows.select("position_id", F.coalesce(with_roster, "own").alias("payload"))


def cluster_payload(activities: DataFrame, links: DataFrame, total_roles: int) -> dict[str, DataFrame]:
    """Of the explorer's reference contract: `vocabulary` (activity_id, label, share), `clusters` (cluster, label, roles,
    weight), the label being that of its first activity and rare clusters weighing more, and `role_clusters` (role_id, clusters) in order of rank."""
    share = links.groupBy("activity_id").agg((F.countDistinct("role_id") / total_roles).alias("share"))
    vocabulary = activities.join(share, "activity_id", "left").select("activity_id", "label", F.bround(F.coalesce("share", F.lit(0.0)), 4).alias("share"))
    clustered = activities.where("cluster is not null")
    labels = clustered.groupBy("cluster").agg(F.min_by("label", "activity_id").alias("label"))
    both = links.join(clustered.select("activity_id", "cluster"), "activity_id")
    roles = both.groupBy("cluster").agg(F.countDistinct("role_id").alias("roles"))
    clusters = labels.join(roles, "cluster", "left").select("cluster", "label", F.coalesce("roles", F.lit(0)).alias("roles"))
    rarity = F.log(F.lit(float(total_roles)) / F.greatest(F.lit(1), F.col("roles")))
    clusters = clusters.withColumn("weight", F.round(F.greatest(F.lit(0.25), rarity), 3))
    first = both.groupBy("role_id", "cluster").agg(F.min("activity_rank").alias("rank"))
    lists = first.groupBy("role_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cluster"))), lambda x: x["cluster"]).alias("clusters"))
    return {"vocabulary": vocabulary, "clusters": clusters, "role_clusters": lists}
