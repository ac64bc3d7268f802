"""Queries of the reference data operators over stand-in workbooks, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, shared_folder
from ..operators import answers, hierarchy, mappings, reconcile, reference, search, similarity
from .binding import Domain, ctes
from .queries import EDGES, GUIDE, edges_of, guide_of, query

# --- workbooks --------------------------------------------------------------------------------------------------------

WORKBOOK = f"""{ctes("hierarchy", "adjacency")},
  numbered AS (SELECT *, CAST(row_number() OVER (ORDER BY code) AS INT) AS sequence FROM hierarchy),
  framework AS (SELECT sequence, code, CASE WHEN code LIKE '%-N2' THEN '' ELSE name END AS name, level,
      CASE WHEN code LIKE '%-N0' THEN code || '-S0' WHEN code LIKE '%-N1' THEN 'X9' ELSE parent_code END AS parent_code FROM numbered
    UNION ALL SELECT sequence + 1000, code, name, level, parent_code FROM numbered WHERE code LIKE '%-N4'),
  cells AS (SELECT a.r_regionkey + 1 AS row, CASE b.r_regionkey WHEN 3 THEN 5 WHEN 4 THEN 4 ELSE b.r_regionkey + 1 END AS col, 'R' || a.r_regionkey AS source, 'R' || b.r_regionkey AS target,
      CASE WHEN a.r_regionkey = 2 AND b.r_regionkey = 2 THEN 1 WHEN a.r_regionkey = 1 AND b.r_regionkey = 3 THEN 0 ELSE tier END AS tier
    FROM region a CROSS JOIN region b LEFT JOIN adjacency x ON x.source = a.r_regionkey AND x.target = b.r_regionkey UNION ALL SELECT 9, 9, 'R1', 'R2', 1),
  mapped AS (SELECT c_custkey AS sequence, CASE WHEN c_custkey % 50 = 0 THEN '' WHEN c_custkey % 41 = 0 THEN CAST(c_custkey - 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS pd_id,
      CASE WHEN c_custkey % 60 = 0 THEN '' WHEN c_custkey % 61 = 0 THEN 'ZZ' ELSE 'R' || c_custkey % 5 END AS primary_code,
      CASE WHEN c_custkey % 7 = 0 THEN 'R' || c_custkey % 5 WHEN c_custkey % 3 = 0 THEN 'R' || (c_custkey + 1) % 5 ELSE '' END AS secondary_code FROM customer)"""


def workbook(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A framework, a matrix and mappings with a fault for every rule."""
    numbered = d.hierarchy().withColumn("sequence", F.row_number().over(Window.orderBy("code")))  # a framework of some hundred rows
    like = lambda n: F.col("code").like(f"%-N{n}")
    parent = F.when(like(0), F.concat("code", F.lit("-S0"))).when(like(1), "X9").otherwise(F.col("parent_code"))
    framework = numbered.withColumns({"name": F.when(like(2), "").otherwise(F.col("name")), "parent_code": parent}).unionByName(numbered.where(like(4)).withColumn("sequence", F.col("sequence") + 1000))
    a, b = (d.t("region").select(F.col("r_regionkey").alias(n)) for n in ("source", "target"))
    tier = F.when(F.expr("source = 2 and target = 2"), 1).when(F.expr("source = 1 and target = 3"), 0).otherwise(F.col("tier"))
    cells = a.crossJoin(b).join(d.adjacency(), ["source", "target"], "left").withColumn("tier", tier)
    column = F.when(F.col("target") == 3, 5).when(F.col("target") == 4, 4).otherwise(F.col("target") + 1)
    cells = cells.select((F.col("source") + 1).cast("int").alias("row"), column.cast("int").alias("column"), F.concat(F.lit("R"), "source").alias("source"), F.concat(F.lit("R"), "target").alias("target"), F.col("tier").cast("int").alias("tier"))
    cells = cells.unionByName(d.spark.createDataFrame([(9, 9, "R1", "R2", 1)], cells.schema))
    key = F.col("c_custkey")
    own, next_one = F.concat(F.lit("R"), (key % 5).cast("string")), F.concat(F.lit("R"), ((key + 1) % 5).cast("string"))
    mapped = d.t("customer").select(
        key.alias("sequence"),
        F.when(key % 50 == 0, "").when(key % 41 == 0, (key - 1).cast("string")).otherwise(key.cast("string")).alias("pd_id"),
        F.when(key % 60 == 0, "").when(key % 61 == 0, "ZZ").otherwise(own).alias("primary_code"),
        F.when(key % 7 == 0, own).when(key % 3 == 0, next_one).otherwise("").alias("secondary_code"),
        F.lit("").alias("secondary_2_code"),
        F.lit("Yes").alias("validated"),
    )
    return framework, cells, mapped


@query(
    f"""WITH RECURSIVE {WORKBOOK},
    walk AS (SELECT code, code AS at, 0 AS steps FROM framework UNION SELECT w.code, f.parent_code, w.steps + 1 FROM walk w JOIN framework f ON f.code = w.at AND f.parent_code <> '' WHERE w.steps < 300),
    codes AS (SELECT DISTINCT code FROM framework),
    families AS (SELECT CAST(row_number() OVER (ORDER BY sequence) AS INT) AS place, code FROM framework WHERE lower(level) = 'job family'),
    last AS (SELECT source, target, arg_max(tier, row * 100 + col) AS tier FROM cells GROUP BY 1, 2),
    slots AS (SELECT pd_id, primary_code AS code FROM mapped WHERE primary_code <> '' UNION ALL SELECT pd_id, secondary_code FROM mapped WHERE secondary_code <> '')
    SELECT 'duplicate_code' AS rule, 'error' AS severity, code AS record FROM framework GROUP BY code HAVING count(*) > 1
    UNION ALL SELECT 'incomplete_row', 'error', CAST(sequence AS VARCHAR) FROM framework WHERE code = '' OR name = '' OR level = ''
    UNION ALL SELECT 'unknown_parent', 'error', code FROM framework WHERE parent_code <> '' AND parent_code NOT IN (SELECT code FROM codes)
    UNION ALL SELECT DISTINCT 'cycle', 'error', code FROM walk WHERE steps = 300
    UNION ALL SELECT 'no_family', 'error', '' WHERE NOT EXISTS (SELECT 1 FROM families)
    UNION ALL SELECT 'column_order', 'error', CAST(coalesce(f.place, h.col) AS VARCHAR) FROM families f FULL JOIN (SELECT * FROM cells WHERE row = 1) h ON h.col = f.place WHERE f.code IS DISTINCT FROM h.target
    UNION ALL SELECT 'row_order', 'error', CAST(coalesce(f.place, h.row) AS VARCHAR) FROM families f FULL JOIN (SELECT * FROM cells WHERE col = 1) h ON h.row = f.place WHERE f.code IS DISTINCT FROM h.source
    UNION ALL SELECT 'cell_count', 'error', CAST(count(*) AS VARCHAR) FROM cells HAVING count(*) <> (SELECT count(*) * count(*) FROM families)
    UNION ALL SELECT 'duplicate_cell', 'error', source || ' > ' || target FROM cells GROUP BY source, target HAVING count(*) > 1
    UNION ALL SELECT 'unknown_tier', 'error', source || ' > ' || target FROM cells WHERE tier IS NULL OR tier NOT IN (0, 1, 2)
    UNION ALL SELECT 'diagonal', 'error', source || ' > ' || target FROM cells WHERE source = target AND tier IS DISTINCT FROM 0
    UNION ALL SELECT 'asymmetric', 'warning', a.source || ' > ' || a.target FROM last a JOIN last b ON a.source = b.target AND a.target = b.source WHERE a.source < a.target AND b.tier IN (0, 1, 2) AND a.tier IS DISTINCT FROM b.tier
    UNION ALL SELECT 'duplicate_mapping', 'error', pd_id FROM mapped WHERE pd_id <> '' GROUP BY pd_id HAVING count(*) > 1
    UNION ALL SELECT 'mapping_without_id', 'error', '' FROM mapped WHERE pd_id = ''
    UNION ALL SELECT 'no_primary', 'error', pd_id FROM mapped WHERE primary_code = ''
    UNION ALL SELECT DISTINCT 'repeated_code', 'error', pd_id FROM (SELECT pd_id, code FROM slots GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'unknown_code', 'error', pd_id || ':' || code FROM slots WHERE code NOT IN (SELECT code FROM codes)
    UNION ALL SELECT DISTINCT 'unlinked', 'warning', pd_id FROM mapped WHERE pd_id <> '' AND pd_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"""
)
def workbook_validation(d: Domain) -> DataFrame:
    return reference.workbook_issues(*workbook(d), d.t("supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("-01")).alias("number")))


def applied(d: Domain) -> dict[str, DataFrame]:
    _, cells, mapped = workbook(d)
    framework = d.hierarchy().withColumn("sequence", F.row_number().over(Window.orderBy("code")))  # some hundred rows
    key = F.col("s_suppkey")
    number = F.concat(F.expr("cast(s_suppkey div 2 as string)"), F.lit("-0"), (key % 2).cast("string"))
    positions = d.t("supplier").select(key.alias("position_id"), F.when(key % 9 != 0, number).alias("number"), F.concat(number, F.lit(".docx")).alias("filename"))
    return reference.apply_workbook(framework, cells, mapped, positions, 7, 500, 9000)


@query(
    f"""WITH {WORKBOOK}, slots AS (SELECT sequence, pd_id, 1 AS mapping_rank, primary_code AS code FROM mapped UNION ALL SELECT sequence, pd_id, 2, secondary_code FROM mapped),
    rows AS (SELECT x.sequence, x.pd_id, x.mapping_rank, x.code, s_suppkey AS position_id, n.name, n.level FROM slots x LEFT JOIN supplier ON CAST(s_suppkey // 2 AS VARCHAR) = x.pd_id JOIN numbered n ON n.code = x.code)
    SELECT 9000 + row_number() OVER (ORDER BY sequence, position_id NULLS FIRST, mapping_rank) AS id, CAST(7 AS BIGINT) AS batch_id, position_id, pd_id, mapping_rank, code, name, level, 'Yes' AS validated, 1 AS code_valid FROM rows"""
)
def workbook_apply_mappings(d: Domain) -> DataFrame:
    return applied(d)["mappings"]


@query(f"WITH {WORKBOOK} SELECT CAST(sequence + 500 AS BIGINT) AS id, CAST(7 AS BIGINT) AS batch_id, sequence, code, name, level, nullif(parent_code, '') AS parent_code FROM numbered")
def workbook_apply_entries(d: Domain) -> DataFrame:
    return applied(d)["entries"]


@query(f"WITH {WORKBOOK} SELECT 7::BIGINT AS batch_id, source, target, tier::INT AS tier, (SELECT count(*) FROM customer WHERE false) AS assigned FROM cells")
def workbook_apply_adjacency(d: Domain) -> DataFrame:
    tables = applied(d)
    return tables["adjacency"].crossJoin(tables["assigned"].agg(F.count("*").alias("assigned")))


# --- links, crosswalks, comparisons -----------------------------------------------------------------------------------

LINKS = """sheet AS (SELECT l_orderkey * 10 + l_linenumber AS place, CASE WHEN l_partkey % 11 = 0 THEN 'n/a' ELSE CAST(l_suppkey + CASE WHEN l_partkey % 13 = 0 THEN 1000000 ELSE 0 END AS VARCHAR) END AS pd_id,
    CASE WHEN l_linenumber = 7 THEN ' ' ELSE 'a' || l_partkey END AS activity_id, 'L' || l_linenumber AS label, l_linenumber AS activity_rank FROM lineitem)"""


def sheet_links(d: Domain) -> dict[str, DataFrame]:
    part, far = F.col("l_partkey"), F.when(F.col("l_partkey") % 13 == 0, 1000000).otherwise(0)
    sheet = d.t("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"),
        F.when(part % 11 == 0, "n/a").otherwise((F.col("l_suppkey") + far).cast("string")).alias("pd_id"),
        F.when(F.col("l_linenumber") == 7, " ").otherwise(F.concat(F.lit("a"), part.cast("string"))).alias("activity_id"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("label"),
        F.col("l_linenumber").alias("activity_rank"),
    )
    return reference.read_links(sheet, d.roles().select(F.col("role_id").alias("position_id"), F.concat(F.lit("r"), F.col("role_id").cast("string")).alias("role_id")))


@query(f"WITH {LINKS} SELECT role_id, activity_id, count(*) AS n, min(place) AS first FROM (SELECT s.*, 'r' || pd_id AS role_id FROM sheet s JOIN supplier ON CAST(s_suppkey AS VARCHAR) = pd_id WHERE trim(activity_id) <> '') GROUP BY 1, 2")
def activity_links(d: Domain) -> DataFrame:
    return sheet_links(d)["links"].groupBy("role_id", "activity_id").agg(F.count("*").alias("n"), F.min("place").alias("first"))


@query(f"WITH {LINKS} SELECT pd_id, count(*) AS n FROM sheet WHERE trim(activity_id) <> '' AND pd_id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier) GROUP BY 1")
def activity_links_unresolved(d: Domain) -> DataFrame:
    return sheet_links(d)["unresolved"].groupBy("pd_id").agg(F.count("*").alias("n"))


@query(f"WITH {LINKS} SELECT activity_id, arg_min(label, place) AS label FROM sheet WHERE trim(activity_id) <> '' GROUP BY 1")
def activity_first_labels(d: Domain) -> DataFrame:
    return sheet_links(d)["activities"]


@query(
    """WITH legacy AS (SELECT o_custkey AS k, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN 'other' ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END, o_orderkey) AS title FROM orders GROUP BY 1)
    SELECT CASE WHEN k % 17 = 0 THEN 'x' || k ELSE CAST(k AS VARCHAR) END AS legacy_id, title, CASE WHEN k % 17 <> 0 AND title = c_name THEN 'r' || k END AS role_id,
      CASE WHEN k % 17 <> 0 AND title = c_name THEN 'exact' ELSE 'unresolved' END AS match_status FROM legacy LEFT JOIN customer ON c_custkey = k"""
)
def legacy_crosswalk(d: Domain) -> DataFrame:
    key = F.col("o_custkey")
    legacy = d.t("orders").select(
        F.col("o_orderkey").alias("place"),
        F.when(key % 17 == 0, F.concat(F.lit("x"), key.cast("string"))).otherwise(key.cast("string")).alias("pd_id"),
        F.when(F.col("o_orderkey") % 3 == 0, "other").otherwise(F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))).alias("title"),
    )
    positions = d.t("customer").select(F.col("c_custkey").alias("position_id"), F.col("c_name").alias("title"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("role_id"))
    return reference.crosswalk(legacy, positions)


@query(
    """SELECT 'p' || p_partkey AS name, CASE WHEN p_partkey % 5 = 0 THEN 'removed' ELSE 'changed' END AS change, CAST(12 AS BIGINT) AS edge_change FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0"""
)
def output_comparison(d: Domain) -> DataFrame:
    key = F.col("p_partkey")
    rows = d.t("part").select(F.concat(F.lit("p"), key.cast("string")).alias("name"), key.alias("k"), F.col("p_name").alias("hash"))
    before = rows.where("k % 7 <> 0 or k % 5 = 0").select("name", "hash")
    after = rows.where("k % 5 <> 0").select("name", F.when(F.col("k") % 11 == 0, "new").otherwise(F.col("hash")).alias("hash"))
    return reference.compared_outputs(before, after, 30, 42)


# --- grade references -------------------------------------------------------------------------------------------------

LABELS = "positions AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE c_mktsegment END AS grade FROM customer), refs AS (SELECT DISTINCT c_mktsegment AS raw_label FROM customer WHERE c_mktsegment < 'F')"


def labels_of(d: Domain) -> tuple[DataFrame, DataFrame]:
    positions = d.t("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_mktsegment")).alias("grade"))
    known = d.t("customer").select(F.col("c_mktsegment").alias("raw_label")).distinct()
    order = F.when(F.length("raw_label") > 8, F.length("raw_label").cast("double"))
    return positions, known.select("raw_label", F.lower("raw_label").alias("display_label"), order.alias("seniority_order"), F.lit(1).alias("active"))


@query(f"WITH {LABELS} SELECT grade AS raw_label, count(*) AS usage_count, grade NOT IN (SELECT raw_label FROM refs) AS is_new FROM positions WHERE trim(grade) <> '' GROUP BY 1")
def classification_seeds(d: Domain) -> DataFrame:
    positions, known = labels_of(d)
    return reference.seeded_labels(positions, known.where("raw_label < 'F'"))


@query(
    f"""WITH {LABELS}, used AS (SELECT grade, count(*) AS n FROM positions GROUP BY 1), known AS (SELECT DISTINCT c_mktsegment AS raw_label FROM customer)
    SELECT raw_label, lower(raw_label) AS display_label, CASE WHEN length(raw_label) > 8 THEN CAST(length(raw_label) AS DOUBLE) END AS seniority_order, 1 AS active, coalesce(n, 0) AS usage_count FROM known LEFT JOIN used ON grade = raw_label"""
)
def classification_list(d: Domain) -> DataFrame:
    positions, known = labels_of(d)
    return reference.listed_references(known, positions)


@query(
    """WITH known AS (SELECT DISTINCT c_mktsegment AS l FROM customer)
    SELECT l AS raw_label, CASE WHEN l < 'C' THEN 'second' ELSE lower(l) END AS display_label, CASE WHEN l < 'C' THEN 2 WHEN length(l) > 8 THEN length(l) END::DOUBLE AS seniority_order, CASE WHEN l < 'C' THEN 0 ELSE 1 END AS active, (SELECT count(*) FROM known) AS backed_up FROM known"""
)
def classification_update(d: Domain) -> DataFrame:
    _, known = labels_of(d)
    some = known.where("raw_label < 'C'").select(F.concat(F.lit(" "), "raw_label").alias("raw_label"))
    edits = some.select("raw_label", F.lit("first").alias("display_label"), F.lit(1.0).alias("seniority_order"), F.lit(None).cast("int").alias("active"), F.lit(1).alias("place"))
    edits = edits.unionByName(some.select("raw_label", F.lit(" second ").alias("display_label"), F.lit(2.0).alias("seniority_order"), F.lit(0).alias("active"), F.lit(2).alias("place")))
    edits = edits.unionByName(edits.limit(1).withColumn("raw_label", F.lit("unknown")))
    backup, updated = reference.updated_references(known, edits)
    return updated.crossJoin(backup.agg(F.count("*").alias("backed_up")))


@query("SELECT p_type AS name, min(p_partkey) AS first_id FROM part WHERE p_size > 3 GROUP BY 1")
def capability_order(d: Domain) -> DataFrame:
    return reference.capability_order(d.t("part").select(F.when(F.col("p_size") > 3, F.col("p_type")).otherwise("").alias("name"), F.col("p_partkey").alias("capability_id")))


@query(f"WITH {ctes('roles')} SELECT role_id, title, row_number() OVER (ORDER BY lower(title), role_id) AS place FROM roles WHERE role_id % 6 <> 0")
def roles_by_title(d: Domain) -> DataFrame:
    from ..lineage import consecutive

    kept = reference.by_title(d.roles().select(F.when(F.col("role_id") % 6 != 0, F.col("role_id")).alias("role_id"), "title"))
    return consecutive(kept, F.lower("title"), F.col("role_id"), name="place")


# --- documents, embeddings, extraction --------------------------------------------------------------------------------


def imported(d: Domain) -> dict[str, DataFrame]:
    """Two imports: all customers with their orders, then every fifth one with its even orders under a new title."""
    spark = d.spark
    item = "struct<section:string,sequence:bigint,text:string>"
    orders = d.t("orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.lit("orders").alias("section"), F.col("o_orderkey").alias("sequence"), F.col("o_orderpriority").alias("text"))).alias("items"))
    rows = d.t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    path = F.concat(F.lit("doc"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("path")
    sections = F.create_map(F.lit("purpose"), F.col("c_mktsegment"), F.lit("blank"), F.lit(" ")).alias("sections")
    items = F.coalesce("items", F.array().cast(f"array<{item}>"))
    first = rows.select("c_custkey", path, F.lit(1).alias("arrived"), F.col("c_name").alias("title"), F.lit("Extraction complete").alias("status"), sections, items.alias("items"))
    again = first.where("c_custkey % 5 = 0").withColumns({"arrived": F.lit(2), "title": F.lit("again"), "items": F.filter("items", lambda x: x["sequence"] % 2 == 0)})
    again = again.unionByName(again.withColumns({"arrived": F.lit(1), "title": F.lit("older")}))
    empty = {"documents": "document_id long, path string, title string, status string", "sections": "document_id long, section_name string, section_text string", "items": "document_id long, section string, sequence long, text string", "drafts": "document_id long, extracted string, draft string, status string, edited string"}
    tables = reference.import_documents({k: spark.createDataFrame([], v) for k, v in empty.items()}, first.drop("c_custkey"))
    edited = F.when(F.col("document_id") % 2 == 0, '["title"]').otherwise(F.col("edited"))
    tables["drafts"] = tables["drafts"].withColumn("edited", edited)
    return reference.import_documents(tables, again.drop("c_custkey"))


@query(
    """WITH ids AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS document_id FROM customer)
    SELECT document_id, 'orders' AS section, o_orderkey AS sequence, o_orderpriority AS text FROM ids JOIN orders ON o_custkey = k WHERE k % 5 <> 0 OR o_orderkey % 2 = 0"""
)
def document_import_items(d: Domain) -> DataFrame:
    return imported(d)["items"]


@query(
    """WITH ids AS (SELECT c_custkey AS k, c_name, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS document_id FROM customer)
    SELECT document_id, CASE WHEN k % 5 = 0 THEN 'again' ELSE c_name END AS title, c_mktsegment AS purpose, CASE WHEN k % 5 = 0 THEN 'again' ELSE c_name END AS extracted_title,
      CASE WHEN k % 5 = 0 AND document_id % 2 = 1 THEN 'again' ELSE c_name END AS draft_title FROM ids"""
)
def document_import_drafts(d: Domain) -> DataFrame:
    t = imported(d)
    title = lambda c: F.get_json_object(c, "$.title").alias(f"{c}_title")
    drafts = t["drafts"].select("document_id", title("extracted"), title("draft"))
    purposes = t["sections"].select("document_id", F.col("section_text").alias("purpose"))
    return t["documents"].select("document_id", "title").join(purposes, "document_id").join(drafts, "document_id")


def lengths(texts: list[str]) -> list[list[float]]:
    return [[float(len(x)), 1.0] for x in texts]


@query(
    """SELECT 'part' AS source_type, p_partkey AS source_id, CASE WHEN p_partkey % 4 = 0 THEN 'old' ELSE 'lengths' END AS model, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 2 END AS dimension, length(p_name) AS n,
      CASE WHEN p_partkey % 4 = 0 THEN 'none' ELSE sha256(p_name) END AS text_hash, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE round(length(p_name) / sqrt(length(p_name) * length(p_name) + 1), 6) END::DOUBLE AS first
    FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0 UNION ALL
    SELECT 'part', p_partkey, 'old', 1, length(p_name), 'none', 1 FROM part WHERE p_partkey % 4 = 0 AND (p_partkey % 3 <> 0 OR p_partkey % 7 = 0) UNION ALL
    SELECT 'part', p_partkey, 'lengths', 2, length(p_name), sha256(p_name), round(length(p_name) / sqrt(length(p_name) * length(p_name) + 1), 6) FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 4 = 0"""
)
def embedding_upsert(d: Domain) -> DataFrame:
    part = d.t("part").select(F.lit("part").alias("source_type"), F.col("p_partkey").alias("source_id"), F.col("p_name").alias("text"))
    old = lambda where, model: part.where(where).select("source_type", "source_id", F.lit(model).alias("model"), F.lit(1).alias("dimension"), F.lit("none").alias("text_hash"), F.array(F.lit(1.0)).alias("vector"))
    stored = old("source_id % 4 = 0", "old").unionByName(old("source_id % 3 = 0 and source_id % 7 <> 0", "lengths"))
    sources = reference.embedding_sources(part.where("source_id % 3 = 0").withColumn("full_text", F.when(F.col("source_id") % 7 == 0, " ").otherwise(F.col("text"))))
    rows = reference.embedded(stored, sources, lengths, "lengths").join(part.select("source_id", F.length("text").cast("long").alias("n")), "source_id")
    return rows.select("source_type", "source_id", "model", "dimension", "n", "text_hash", F.round(F.col("vector")[0], 6).alias("first"))


def stand_in_model(prompt: str) -> str:
    """Answers like a model that fails on every third role until it is reminded, and on every seventh for good."""
    number = int(prompt.split()[0])
    if number % 7 == 0 or number % 3 == 0 and "reminder" not in prompt:
        return "I can't say {"
    return f'```json\n{{"activities": [{{"match_label": " Plan {number} ", "plain_label": ""}}, {{"match_label": ""}}]}}\n```'


@query(
    """SELECT s_suppkey AS role_id, CASE WHEN s_suppkey % 7 = 0 THEN 2 WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS retry_count,
      CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'plan ' || s_suppkey END AS match_label, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'plan ' || s_suppkey END AS plain_label FROM supplier"""
)
def extraction_retries(d: Domain) -> DataFrame:
    prompts = d.t("supplier").select(F.col("s_suppkey").alias("role_id"), F.concat(F.col("s_suppkey").cast("string"), F.lit(" name the activities")).alias("prompt"))
    found = reference.extracted_activities(prompts, stand_in_model, "a reminder")
    return found.select("role_id", "retry_count", F.explode_outer("activities").alias("a")).select("role_id", "retry_count", "a.*")


# --- facts and payloads -----------------------------------------------------------------------------------------------


@query(
    """SELECT l_suppkey AS role_id, 'c' || p_partkey AS capability_id, count(*) AS n, p_brand AS framework_name, p_type AS capability_name, CAST(l_linenumber AS VARCHAR) AS required_level,
      CASE WHEN l_linenumber % 2 = 0 AND p_brand < 'Brand#4' THEN l_linenumber END AS normalized_level
    FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 5 <> 0 AND l_suppkey % 4 <> 0 GROUP BY ALL"""
)
def capability_facts(d: Domain) -> DataFrame:
    part, lines = d.t("part"), d.t("lineitem")
    rows = lines.select(F.monotonically_increasing_id().alias("assignment_id"), F.col("l_suppkey").alias("position_id"), F.col("l_partkey").alias("definition_id"), F.col("l_linenumber").cast("string").alias("required_level"))
    positions = d.t("supplier").where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("position_id"), F.col("s_suppkey").alias("role_id"))
    definitions = part.select(F.col("p_partkey").alias("definition_id"), F.col("p_brand").alias("framework_id"), F.col("p_type").alias("capability_name"))
    frameworks = part.select(F.col("p_brand").alias("framework_id"), F.col("p_brand").alias("framework_name")).distinct()
    identities = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").cast("string").alias("source_capability_id"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("capability_id"))
    levels = frameworks.where("framework_name < 'Brand#4'").select("framework_name", F.explode(F.array(*(F.lit(k) for k in (2, 4, 6)))).alias("normalized_level"))
    rules = levels.select("framework_name", F.col("normalized_level").cast("string").alias("raw_level"), "normalized_level")
    found = reference.capability_facts(rows, positions, definitions, frameworks, identities, rules)
    return found.groupBy("role_id", "capability_id", "framework_name", "capability_name", "required_level", "normalized_level").agg(F.count("*").alias("n"))


@query(
    f"""WITH {ctes("roles", "role_capabilities")}, ranked AS (SELECT * FROM roles WHERE rung % 2 = 0)
    SELECT (SELECT count(*) FROM roles) AS roles, (SELECT count(DISTINCT role_id) FROM role_capabilities WHERE focus) AS with_focus, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_quantity > 49) AS with_statements,
      (SELECT count(*) FROM ranked) AS with_order, (SELECT string_agg(level, ',' ORDER BY level) FROM (SELECT DISTINCT CAST(CAST(level AS INT) AS VARCHAR) AS level FROM role_capabilities)) AS levels"""
)
def export_counters(d: Domain) -> DataFrame:
    roles = d.roles().select("role_id", F.col("rung").alias("grade"))
    capabilities = d.role_capabilities().select("role_id", F.when(F.col("focus"), "Focus").otherwise("other").alias("kind"), F.col("level").cast("int").cast("string").alias("level"))
    grades = roles.select("grade", F.when(F.col("grade") % 2 == 0, F.col("grade")).alias("seniority_order")).distinct()
    return reference.export_counters(roles, capabilities, d.t("lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("role_id")), grades)


@query(
    f"""WITH {ctes("hierarchy")}, caps AS (SELECT k, string_agg(p_type, '|' ORDER BY s, p_type) AS capabilities FROM (SELECT l_suppkey AS k, p_type, min(l_orderkey * 10 + l_linenumber) AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 GROUP BY 1, 2) GROUP BY 1)
    SELECT s_suppkey AS position_id, CASE WHEN s_suppkey % 4 = 0 THEN 'Lead ' ELSE '' END || s_name AS title, CASE WHEN s_suppkey % 3 = 0 THEN 'display' WHEN s_suppkey % 3 = 1 THEN 'g1' ELSE 'G2' END AS grade_label, coalesce(h.code, '') AS code,
      CASE WHEN h.code IS NULL THEN 'Unmapped' ELSE r_name END AS family_name, coalesce(h.name, '') AS sub_family_name, coalesce(r_name || ' > ' || h.name, '') AS path, s_suppkey % 4 = 0 AS manager_role, coalesce(capabilities, '') AS capabilities, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE s_name || ' serves ' || n_name END AS purpose
    FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN hierarchy h ON h.code = 'R' || n_regionkey || '-N' || n_nationkey AND s_suppkey % 5 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey AND h.code IS NOT NULL LEFT JOIN caps ON k = s_suppkey"""
)
def explorer_roles(d: Domain) -> DataFrame:
    key = F.col("s_suppkey")
    positions = d.t("supplier").select(key.alias("position_id"), F.concat(F.when(key % 4 == 0, "Lead ").otherwise(""), "s_name").alias("title"), F.concat(F.lit("G"), (key % 3).cast("string")).alias("grade"))
    nation = d.t("supplier").join(d.t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    primary = nation.where("s_suppkey % 5 <> 0").select(key.alias("position_id"), F.concat(F.lit("R"), "n_regionkey", F.lit("-N"), "n_nationkey").alias("code"))
    references = d.spark.createDataFrame([("G0", "display", "g0", 3.0), ("G1", "", "g1", 2.0)], "raw_label string, display_label string, abbreviation string, seniority_order double")
    lines = d.t("lineitem").where("l_linenumber = 1").join(d.t("part"), F.col("p_partkey") == F.col("l_partkey"))
    capabilities = lines.select(F.col("l_suppkey").alias("position_id"), F.lit("Focus").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"), F.col("p_type").alias("name"))
    purposes = nation.where("s_suppkey % 6 <> 0").select(key.alias("position_id"), F.concat("s_name", F.lit(" serves "), "n_name").alias("purpose"))
    rows = reference.explorer_rows(positions, primary, references, hierarchy.paths(d.hierarchy()), purposes, capabilities)
    return rows.drop("seniority_order").withColumn("capabilities", F.array_join("capabilities", "|"))


@query(
    f"""WITH {GUIDE}, {ctes("hierarchy")}, top AS (SELECT query_id, node AS family, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS family_place FROM guide WHERE level = 'family'),
    under AS (SELECT g.query_id, t.family, t.family_place, g.node, g.score, row_number() OVER (PARTITION BY g.query_id, t.family ORDER BY g.score DESC, g.node) AS place
      FROM guide g JOIN top t ON t.query_id = g.query_id AND t.family = split_part(g.node, '-', 1) AND t.family_place <= 4 WHERE g.level = 'sub' AND g.score >= 0.30)
    SELECT query_id, family, CAST(family_place AS INT) AS family_place, node, CAST(place AS INT) AS place, score FROM under WHERE place <= 3"""
)
def guide_limits(d: Domain) -> DataFrame:
    nodes, parents = guide_of(d)
    return similarity.guide_tree(nodes, parents, 4, 3, 0.30)


@query(
    f"""WITH {GUIDE}, {ctes("hierarchy")}, top AS (SELECT query_id, node AS family, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS family_place FROM guide WHERE level = 'family'),
    under AS (SELECT g.query_id, t.family, t.family_place, g.node, row_number() OVER (PARTITION BY g.query_id, t.family ORDER BY g.score DESC, g.node) AS place
      FROM guide g JOIN top t ON t.query_id = g.query_id AND t.family = split_part(g.node, '-', 1) AND t.family_place <= 4 WHERE g.level = 'sub'),
    shown AS (SELECT query_id, string_agg(family || '/' || node, '|' ORDER BY family_place, place) AS nodes FROM under WHERE place <= 4 GROUP BY 1),
    said AS (SELECT l_suppkey AS k, l_returnflag || l_linestatus AS statement, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS place FROM lineitem WHERE l_quantity > 48),
    heads AS (SELECT k, count(*) AS total, string_agg(statement, '+' ORDER BY place) FILTER (place <= 3) AS head FROM said GROUP BY 1),
    members AS (SELECT 'F' || n_regionkey % 3 AS code, count(*) AS n, string_agg(s_suppkey || '=' || coalesce(total, 0) || '=' || coalesce(head, ''), ';' ORDER BY s_suppkey) AS roles
      FROM supplier JOIN nation ON n_nationkey = s_nationkey LEFT JOIN heads ON k = s_suppkey GROUP BY 1),
    listed AS (SELECT query_id, string_agg(code || ':' || n || ':' || roles, '|' ORDER BY code) AS roster FROM (SELECT DISTINCT query_id, family AS code FROM under WHERE place <= 4) JOIN members USING (code) GROUP BY 1)
    SELECT vec_id AS position_id, CASE WHEN label % 2 = 0 THEN r_name || ' → ' || n_name ELSE 'Unmapped' END AS current, label % 3 = 0 AS executive, nodes, roster
    FROM embeddings JOIN nation ON n_nationkey = label % 25 JOIN region ON r_regionkey = n_regionkey LEFT JOIN shown ON shown.query_id = vec_id LEFT JOIN listed ON listed.query_id = vec_id"""
)
def assistant_payload(d: Domain) -> DataFrame:
    nodes, parents = guide_of(d)
    tree = similarity.guide_tree(nodes, parents)
    v = d.vectors().select(F.col("vec_id").alias("position_id"), F.col("code").alias("label"))
    positions = v.select("position_id", F.lit("t").alias("title"), F.when(F.col("label") % 3 == 0, "Exec Band 1").otherwise("G").alias("grade"), F.lit("").alias("cohort"))
    place = d.t("nation").select(F.col("n_nationkey").alias("n"), F.concat(F.lit("R"), "n_regionkey", F.lit("-N"), "n_nationkey").alias("code"))
    assigned = v.where("label % 2 = 0").join(place, F.col("label") % 25 == F.col("n")).select("position_id", "code")
    roles = d.roles().select("role_id", "title", F.concat(F.lit("F"), (F.col("family") % 3).cast("string")).alias("code"))
    said = d.t("lineitem").where("l_quantity > 48").select(F.col("l_suppkey").alias("role_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"), F.concat("l_returnflag", "l_linestatus").alias("statement"))
    roster = similarity.roster(roles, said)
    rows = reference.assistant_payloads(positions, assigned, hierarchy.paths(d.hierarchy()), tree, roster, "(?i)executive|exec band")
    shape = "current string, executive boolean, families array<struct<family_place:int,family:string,nodes:array<struct<place:int,node:string,score:double>>>>, roster array<struct<code:string,total:bigint,roles:array<struct<role_id:bigint,statement_total:bigint,head:array<string>>>>>"
    x = rows.select("position_id", F.from_json("payload", shape).alias("p")).select("position_id", "p.*")
    listed = F.flatten(F.transform("families", lambda f: F.transform(f["nodes"], lambda n: F.concat(f["family"], F.lit("/"), n["node"]))))
    member = lambda m: F.concat_ws("=", m["role_id"].cast("string"), F.coalesce(m["statement_total"], F.lit(0)).cast("string"), F.array_join(F.coalesce(m["head"], F.array().cast("array<string>")), "+"))
    shown = F.transform("roster", lambda r: F.concat_ws(":", r["code"], r["total"].cast("string"), F.array_join(F.transform(r["roles"], member), ";")))
    return x.select("position_id", "current", "executive", F.array_join(listed, "|").alias("nodes"), F.array_join(shown, "|").alias("roster"))


def clustered(d: Domain) -> dict[str, DataFrame]:
    activity = F.concat_ws("|", "p_brand", "p_type")
    activities = d.t("part").groupBy(activity.alias("activity_id")).agg(F.min("p_name").alias("label"), F.max("p_size").alias("s"))
    activities = activities.select("activity_id", "label", F.when(F.col("s") % 5 != 0, F.col("s") % 7).alias("cluster"))
    return reference.cluster_payload(activities, d.role_activities().withColumnRenamed("activity", "activity_id"), d.roles().count())


CLUSTERED = f"""{ctes("role_activities", "roles")}, total AS (SELECT count(*) AS n FROM roles),
  acts AS (SELECT p_brand || '|' || p_type AS activity, min(p_name) AS label, CASE WHEN max(p_size) % 5 <> 0 THEN max(p_size) % 7 END AS cluster FROM part GROUP BY 1)"""


@query(
    f"""WITH {CLUSTERED}, named AS (SELECT cluster, arg_min(label, activity) AS label FROM acts WHERE cluster IS NOT NULL GROUP BY 1),
    used AS (SELECT cluster, count(DISTINCT role_id) AS roles FROM role_activities JOIN acts USING (activity) WHERE cluster IS NOT NULL GROUP BY 1)
    SELECT cluster, label, coalesce(roles, 0) AS roles, round(greatest(0.25::DOUBLE, ln(n / greatest(1, coalesce(roles, 0))::DOUBLE)), 3) AS weight FROM named LEFT JOIN used USING (cluster) CROSS JOIN total"""
)
def explorer_clusters(d: Domain) -> DataFrame:
    return clustered(d)["clusters"]


@query(
    f"""WITH {CLUSTERED}, firsts AS (SELECT role_id, cluster, min(activity_rank) AS r FROM role_activities JOIN acts USING (activity) WHERE cluster IS NOT NULL GROUP BY 1, 2)
    SELECT role_id, string_agg(cluster, ',' ORDER BY r, cluster) AS clusters FROM firsts GROUP BY 1"""
)
def explorer_role_clusters(d: Domain) -> DataFrame:
    return clustered(d)["role_clusters"].select("role_id", F.array_join(F.transform("clusters", lambda x: x.cast("string")), ",").alias("clusters"))


@query(f"WITH {CLUSTERED} SELECT activity AS activity_id, label, round_even(coalesce(c, 0) / n::DOUBLE, 4) AS share FROM acts LEFT JOIN (SELECT activity, count(DISTINCT role_id) AS c FROM role_activities GROUP BY 1) USING (activity) CROSS JOIN total")
def explorer_vocabulary(d: Domain) -> DataFrame:
    return clustered(d)["vocabulary"]


@query(f"WITH {ctes('imported')}, chosen AS (SELECT * FROM (VALUES (1, 'old', false), (2, 'new', true)) b(batch_id, source, is_active)) SELECT position_id, i.id, code, source FROM imported i JOIN chosen ON batch_id = 1 + i.id % 2 WHERE is_active")
def active_batch(d: Domain) -> DataFrame:
    batches = mappings.with_new_batch(d.spark.createDataFrame([(1, "old", True)], "id long, source string, is_active boolean"), 2, "new")
    rows = d.mappings().withColumn("batch_id", 1 + F.col("id") % 2)
    return mappings.of_active_batch(rows, batches).select("position_id", "id", "code", "source")


# --- previews and search ----------------------------------------------------------------------------------------------


@query(
    f"""WITH {ctes("hierarchy", "adjacency", "imported")}, f AS (SELECT h.code IS NOT NULL AS old, n.code IS NOT NULL AS new, (h.name, h.level, h.parent_code) IS DISTINCT FROM (n.name, n.level, n.parent_code) AS other FROM hierarchy h
      FULL JOIN (SELECT code, CASE WHEN code LIKE '%-S1' THEN upper(name) || '!' ELSE name END AS name, level, parent_code FROM hierarchy WHERE code NOT LIKE '%-S2' UNION ALL SELECT 'Z' || code, name, level, parent_code FROM hierarchy WHERE level = 'Job Family') n USING (code)),
    was AS (SELECT DISTINCT position_id, mapping_rank, code FROM imported WHERE code <> ''),
    now AS (SELECT DISTINCT position_id, mapping_rank, CASE WHEN position_id % 11 = 0 THEN '' WHEN position_id % 13 = 0 THEN code || 'x' ELSE code END AS code FROM imported),
    m AS (SELECT a.code IS NOT NULL AS old, b.code IS NOT NULL AS new, FALSE AS other FROM was a FULL JOIN (SELECT * FROM now WHERE code <> '') b USING (position_id, mapping_rank, code)),
    c AS (SELECT a.tier IS NOT NULL AS old, b.tier IS NOT NULL AS new, a.tier <> b.tier AS other FROM adjacency a FULL JOIN (SELECT source, target, CASE WHEN source = 1 THEN 2 - tier ELSE tier END AS tier FROM adjacency WHERE target <> 3 UNION ALL SELECT 0, 4, 1) b USING (source, target))
    SELECT sheet, count_if(old) AS current, count_if(new) AS incoming, count_if(new AND NOT old) AS added, count_if(old AND NOT new) AS removed, count_if(old AND new AND other) AS changed
    FROM (SELECT 'framework' AS sheet, * FROM f UNION ALL SELECT 'mappings', * FROM m UNION ALL SELECT 'adjacency', * FROM c) GROUP BY 1"""
)
def workbook_preview(d: Domain) -> DataFrame:
    tree, cells, mapped = d.hierarchy(), d.adjacency(), d.mappings()
    renamed = tree.where("code not like '%-S2'").withColumn("name", F.when(F.col("code").endswith("-S1"), F.concat(F.upper("name"), F.lit("!"))).otherwise(F.col("name")))
    renamed = renamed.unionByName(tree.where("level = 'Job Family'").withColumn("code", F.concat(F.lit("Z"), "code")))
    code = F.when(F.col("position_id") % 11 == 0, "").when(F.col("position_id") % 13 == 0, F.concat("code", F.lit("x"))).otherwise(F.col("code"))
    turned = cells.where("target <> 3").withColumn("tier", F.when(F.col("source") == 1, 2 - F.col("tier")).otherwise(F.col("tier")))
    turned = turned.unionByName(d.t("region").where("r_regionkey = 0").select(F.col("r_regionkey").alias("source"), (F.col("r_regionkey") + 4).alias("target"), F.lit(1).alias("tier")))
    return reference.workbook_preview({"framework": tree, "mappings": mapped, "adjacency": cells}, {"framework": renamed, "mappings": mapped.withColumn("code", code), "adjacency": turned})


@query("SELECT item, doc_id FROM (SELECT 'document' AS item, doc_id AS doc_id, lower(text) AS t FROM documents UNION ALL SELECT 'page', page_id, lower(url) FROM pages) WHERE contains(t, 'the wh') OR contains(t, 'ple.co')")
def indexed_search(d: Domain) -> DataFrame:
    """Documents with a phrase, and pages by a part of their address, by indexes of trigrams."""
    folder, found = f"{shared_folder(d.spark)}/trigrams-{uuid.uuid4().hex}", None
    for item, table, key, column in (("document", "documents", "doc_id", "text"), ("page", "pages", "page_id", "url")):
        rows = d.t(table).select(F.lit(item).alias("item"), F.col(key).alias("doc_id"), column)
        search.build(rows, "doc_id", [column], f"{folder}/{table}")
        for word in (" The WH", "ple.CO "):
            hits = search.keyword_search(rows, "doc_id", [column], word.strip(), f"{folder}/{table}").select("item", "doc_id")
            found = hits if found is None else found.unionByName(hits)
    return found.distinct()


# --- answers and reconciliation ---------------------------------------------------------------------------------------


@query(
    """SELECT substr(sha256('label' || chr(0) || p_type), 1, 32) AS key, upper(p_type) AS answer, count(*) AS prompts, 1::BIGINT AS kept, 0::BIGINT AS asked_again FROM part GROUP BY p_type"""
)
def cached_answers(d: Domain) -> DataFrame:
    """Two runs over one table of answers: the first asks for the types of small parts, the second for the others only. The
    answers are the prompts in capitals, with the run that asked in front, which the table keeps."""
    path = f"{shared_folder(d.spark)}/answers-{uuid.uuid4().hex}"
    prompts = d.t("part").select(F.lit("label").alias("system"), F.col("p_type").alias("prompt"), "p_size")
    asked = lambda run: lambda batch: [f"{run}:{prompt.upper()}" for _, prompt in batch]
    first = answers.answered(prompts.where("p_size <= 10"), ["system", "prompt"], asked(1), path, round_rows=50)
    known = cut(first.select("key").distinct())
    rows = answers.answered(prompts, ["system", "prompt"], asked(2), path, round_rows=50)
    stored = d.spark.read.schema(answers.SCHEMA).parquet(path).groupBy("key").agg(F.count("*").alias("kept"))
    again = F.count_if(F.col("known").isNotNull() & (F.substring("answer", 1, 1) == "2")).alias("asked_again")
    found = rows.join(known.withColumn("known", F.lit(True)), "key", "left").groupBy("key").agg(F.max(F.substring_index("answer", ":", -1)).alias("answer"), F.count("*").alias("prompts"), again)
    return found.join(stored, "key").select("key", "answer", "prompts", "kept", "asked_again")


@query(
    """WITH later AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 97 <> 0
      UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderkey % 101 = 0),
    earlier AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders)
    SELECT *, 1::BIGINT AS old_rows, 0::BIGINT AS new_rows FROM (FROM earlier EXCEPT ALL FROM later) UNION ALL SELECT *, 0, 1 FROM (FROM later EXCEPT ALL FROM earlier)"""
)
def reconciled_tables(d: Domain) -> DataFrame:
    """Rows in which two versions of the orders differ, by trees of hashes."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"]
    earlier = d.t("orders").select(columns)
    later = earlier.where("o_orderkey % 97 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 89 == 0, "X").otherwise(F.col("o_orderstatus")))
    later = later.unionByName(earlier.where("o_orderkey % 101 = 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    return reconcile.differences(earlier, later, ["o_orderkey"])


@query(
    f"""WITH {EDGES}, earlier AS (SELECT a, b, neighbour_rank AS k FROM edges WHERE neighbour_rank <= 5), later AS (SELECT a, b, neighbour_rank AS k FROM edges WHERE neighbour_rank <= CASE a % 7 WHEN 0 THEN 6 WHEN 1 THEN 4 ELSE 5 END)
    SELECT a AS role_id, b AS neighbour_role_id, 'removed' AS change FROM (SELECT a, b FROM earlier EXCEPT SELECT a, b FROM later) UNION ALL SELECT a, b, 'added' FROM (SELECT a, b FROM later EXCEPT SELECT a, b FROM earlier)"""
)
def edge_delta(d: Domain) -> DataFrame:
    """Edges that a build adds and removes, as edges."""
    edges = cut(edges_of(d).select("role_id", "neighbour_role_id", "neighbour_rank"))
    most = F.when(F.col("role_id") % 7 == 0, 6).when(F.col("role_id") % 7 == 1, 4).otherwise(5)
    pair = ["role_id", "neighbour_role_id"]
    return reconcile.changes(edges.where("neighbour_rank <= 5").select(pair), edges.where(F.col("neighbour_rank") <= most).select(pair), pair)
