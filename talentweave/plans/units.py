"""Queries of single functions and small operators that the other queries don't reach, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers, text
from ..lineage import consecutive
from ..operators import extraction, graph, hierarchy, mappings, payloads, quality, releases, similarity, statements, summaries, vocabulary
from ..sources.files import wide_matrix
from .binding import Domain, ctes
from .queries import EDGES, ORACLES, edges_of, issues_of, query

# --- text -------------------------------------------------------------------------------------------------------------


@query(
    r"""SELECT p_partkey, contains(lower(p_type), 'econ') AS has_level, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END AS first_filled,
      coalesce(TRY_CAST(p_size || CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE '.5' END AS DOUBLE), 0) AS number, trim(regexp_replace(lower(p_brand || ' -- ' || p_type || '!'), '[^a-z0-9]+', ' ', 'g')) AS label_key,
      p_name AS name, CASE WHEN p_partkey % 2 = 0 THEN 'AB' || p_partkey ELSE '' END AS code,
      CASE WHEN length(p_name || ' ' || p_type) > 12 THEN p_name || ' ' || p_type END AS without_bullet, '/x?user=a&Password=***&t=1' AS redacted FROM part"""
)
def text_labels(d: Domain) -> DataFrame:
    key = F.col("p_partkey")
    coded = F.concat("p_name", F.when(key % 2 == 0, F.concat(F.lit(" (AB"), key.cast("string"), F.lit(")"))).otherwise(""))
    mark = F.element_at(F.array(*(F.lit(x) for x in ("- ", " (3) ", "12. ", "•"))), (key % 4 + 1).cast("int"))
    parts = text.split_name_code(coded)
    return d.t("part").select(
        key,
        text.has_level(F.col("p_type"), "Econ").alias("has_level"),
        text.first_filled(F.when(key % 3 == 0, "").otherwise(F.col("p_name")), F.lit(None).cast("string"), F.col("p_brand")).alias("first_filled"),
        text.tolerant_double(F.concat(F.col("p_size").cast("string"), F.when(key % 4 == 0, "x").otherwise(".5"))).alias("number"),
        text.label_key(F.concat("p_brand", F.lit(" -- "), "p_type", F.lit("!"))).alias("label_key"),
        parts["name"].alias("name"),
        parts["code"].alias("code"),
        text.strip_bullet(F.concat(mark, "p_name", F.lit("  "), "p_type")).alias("without_bullet"),
        text.redacted(F.concat(F.lit("/x?user=a&Password="), F.col("p_brand"), F.lit("&t=1"))).alias("redacted"),
    )


@query("SELECT p_partkey, p_name AS title FROM part")
def file_titles(d: Domain) -> DataFrame:
    number = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    name = F.concat_ws("_", F.when(F.col("p_partkey") % 3 != 0, number), F.translate("p_name", " ", "_"), F.when(F.col("p_partkey") % 2 == 0, F.upper("p_brand")))
    return d.t("part").select("p_partkey", text.title_from_filename(F.concat(name, F.lit(".docx")), number, F.col("p_brand")).alias("title"))


@query(
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(p_name) WHEN 1 THEN 'café ' || lower(p_brand) WHEN 2 THEN 'a-b-' || p_partkey WHEN 3 THEN 'strasse ' || p_partkey END AS matched FROM part"""
)
def matching_texts(d: Domain) -> DataFrame:
    key = F.col("p_partkey")
    raw = F.when(key % 5 == 0, F.concat(F.lit("\t "), F.upper("p_name"), F.lit(" \n"))).when(key % 5 == 1, F.concat(F.lit("cafÃ© "), "p_brand")).when(key % 5 == 2, F.concat(F.lit("A–B‑"), key.cast("string"))).when(key % 5 == 3, F.concat(F.lit("Straße "), key.cast("string")))
    return d.t("part").select(key, text.match_text(raw).alias("matched"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_size END::INT AS a, CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS b FROM part")
def model_answers(d: Domain) -> DataFrame:
    body = F.concat(F.lit('{"a": '), F.col("p_size").cast("string"), F.lit(', "b": "'), "p_brand", F.lit('"}'))
    answer = F.when(F.col("p_partkey") % 5 == 0, "there is none").when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("So: "), body, F.lit(" that's it")))
    return d.t("part").select("p_partkey", text.lenient_json(answer, "a int, b string").alias("x")).select("p_partkey", "x.*")


# --- identifiers ------------------------------------------------------------------------------------------------------


@query(
    """SELECT p_partkey, left(sha256(p_brand || chr(0) || p_name), 32) AS cache_key, CASE WHEN p_partkey % 4 = 0 THEN 'new' ELSE p_brand END AS kept,
      substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::INT & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('part:' || p_partkey)) AS h FROM part)"""
)
def stable_keys(d: Domain) -> DataFrame:
    name = F.concat(F.lit("part:"), F.col("p_partkey").cast("string"))
    kept = identifiers.kept_or_new(F.when(F.col("p_partkey") % 8 == 0, "").when(F.col("p_partkey") % 4 != 0, F.col("p_brand")), F.lit("new"))
    return d.t("part").select("p_partkey", identifiers.cache_key(F.col("p_brand"), F.col("p_name")).alias("cache_key"), kept.alias("kept"), identifiers.uuid5(uuid.NAMESPACE_URL, name).alias("uuid"))


ORACLES["uuid5_ids"] = f"""WITH {ctes("roles")} SELECT role_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::INT & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT role_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('role:' || role_id)) AS h FROM roles)"""


@query(f"SELECT CAST(sum(n) FILTER (severity = 'error') AS BIGINT) AS errors, CAST(sum(n) FILTER (severity = 'warning') AS BIGINT) AS warnings, 'blocked' AS status FROM ({ORACLES['exception_rules']})")
def release_state(d: Domain) -> DataFrame:
    return quality.release_status(issues_of(d))


@query(
    """SELECT arg_max(id, id) AS id, '00010-02' AS number FROM (SELECT c_custkey AS id, lpad(CAST(c_custkey // 3 AS VARCHAR), 5, '0') || '-' || lpad(CAST(c_custkey % 3 AS VARCHAR), 2, '0') AS number FROM customer)
    WHERE number = (SELECT max(lpad(CAST(c_custkey // 3 AS VARCHAR), 5, '0') || '-' || lpad(CAST(c_custkey % 3 AS VARCHAR), 2, '0')) FROM customer WHERE c_custkey // 3 = 10)"""
)
def identifier_resolve(d: Domain) -> DataFrame:
    from .queries import numbered

    return summaries.resolve(numbered(d), "00010")


PARTS = """parts AS (SELECT a, b, round(0.55::DOUBLE * readiness, 12) + round(0.30::DOUBLE * work, 12) + round(0.10::DOUBLE * CAST(same_sub AS INT), 12) + round(0.05::DOUBLE * gp, 12) AS total,
    round(raw, 12) + CASE WHEN b % 10 = 0 THEN 0.5 ELSE 0 END::DOUBLE AS score FROM edges)"""


@query(f"WITH {EDGES}, {PARTS} SELECT count(*) AS edges, count_if(abs(score - total) > 2e-6) AS unreconciled FROM parts")
def neighbour_score_reconciliation(d: Domain) -> DataFrame:
    """Every edge whose parts don't make its score; the scores of some neighbours are wrong here on purpose."""
    wrong = F.when(F.col("neighbour_role_id") % 10 == 0, 0.5).otherwise(0.0)
    e = edges_of(d).withColumn("score", F.col("score") + wrong)
    return e.agg(F.count("*").alias("edges")).crossJoin(graph.unreconciled(e).agg(F.count("*").alias("unreconciled")))


@query("SELECT DISTINCT p_type || p_size AS activity FROM part EXCEPT SELECT p_type || p_size FROM part WHERE p_size > 9")
def missing_activities(d: Domain) -> DataFrame:
    part = d.t("part").select(F.concat("p_type", F.col("p_size").cast("string")).alias("activity"), "p_size")
    return part.select("activity").subtract(part.where("p_size > 9").select("activity"))


# --- statements -------------------------------------------------------------------------------------------------------

#: A statement for each reason, in upper case and with other blanks as people write them, and two to keep.
SAMPLES = [
    ("PLACE the customer  at the centre of all decision making in every project", "customer-centred decision boilerplate"),
    ("Promote safety leadership across all sites", "safety leadership boilerplate"),
    ("Build a high-performance team through coaching", "high-performance team boilerplate"),
    ("Carry out performance management and development plans", "performance review/development plan boilerplate"),
    ("Comply with all policies", "mandatory boilerplate"),
    ("Deliver the yearly programme of works", None),
    ("short", None),
]


def sample_items(d: Domain) -> tuple[DataFrame, DataFrame]:
    samples = F.array(*(F.lit(s) for s, _ in SAMPLES))
    rows = d.t("customer").select((F.col("c_custkey") % 40).alias("role_id"), F.col("c_custkey").alias("sequence"), F.element_at(samples, (F.col("c_custkey") % len(SAMPLES) + 1).cast("int")).alias("text"))
    return rows.withColumn("text", F.concat(F.lit("• "), "text")), d.spark.createDataFrame([("• comply with  ALL policies.",)], "text string")


CASES = "CASE c_custkey % 7 " + " ".join(f"WHEN {k} THEN '{reason}'" for k, (_, reason) in enumerate(SAMPLES) if reason) + " END"


@query(f"SELECT c_custkey AS sequence, {CASES} AS reason FROM customer")
def boilerplate_patterns(d: Domain) -> DataFrame:
    items, mandatory = sample_items(d)
    return statements.split_boilerplate(items, mandatory).select("sequence", "reason")


@query(
    f"""SELECT c_custkey % 40 AS role_id, string_agg('Deliver the yearly programme of works', '|') FILTER (c_custkey % 7 = 5) AS statements, count_if({CASES} IS NOT NULL) AS excluded
    FROM customer WHERE c_custkey % 40 IN (SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING count_if(c_custkey % 7 = 5) > 0"""
)
def role_statement_lists(d: Domain) -> DataFrame:
    items, mandatory = sample_items(d)
    rows = statements.role_statements(d.t("supplier").select(F.col("s_suppkey").alias("role_id")), items, mandatory)
    return rows.select("role_id", F.array_join("statements", "|").alias("statements"), "excluded")


@query("SELECT s_suppkey AS role_id, 'Purpose' || chr(10) || s_name || CASE WHEN s_suppkey % 3 <> 0 THEN chr(10) || chr(10) || 'About' || chr(10) || 'N' || s_nationkey ELSE '' END AS text FROM supplier")
def section_texts(d: Domain) -> DataFrame:
    about = F.when(F.col("s_suppkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" N"), F.col("s_nationkey").cast("string"), F.lit(" ")))
    rows = d.t("supplier").select(F.col("s_suppkey").alias("role_id"), F.explode(F.create_map(F.lit("about"), about, F.lit("purpose"), F.col("s_name"), F.lit("other"), F.lit("x"))).alias("section_name", "section_text"))
    return statements.section_text(rows, {"purpose": "Purpose", "about": "About"})


@query(f"WITH {ctes('hierarchy')} SELECT code, concat_ws(chr(10), code, name, level, 'Main ' || code, CASE WHEN level = 'Sub-family' THEN 'More' END) AS text FROM hierarchy")
def framework_texts(d: Domain) -> DataFrame:
    more = F.when(F.col("level") == "Sub-family", "More").otherwise(" ")
    nodes = d.hierarchy().withColumns({"main_definition": F.concat(F.lit("Main "), "code"), "supp_definition_1": more, "supp_definition_2": F.lit(None).cast("string"), "exclusions": F.lit("never")})
    return statements.framework_text(nodes)


# --- mappings, matrices, releases -------------------------------------------------------------------------------------


@query(f"WITH {ctes('imported')} SELECT position_id, id, code FROM imported WHERE mapping_rank = 1")
def rank_one_mappings(d: Domain) -> DataFrame:
    return mappings.any_rank_one(d.mappings()).select("position_id", "id", "code")


@query(
    """SELECT p_partkey, CAST(k AS INT) AS mapping_rank, code, name FROM (SELECT p_partkey, 1 AS k, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_brand END AS code, p_name AS name FROM part
      UNION ALL SELECT p_partkey, 2, '', CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '' END FROM part) WHERE code <> '' OR name <> ''"""
)
def mapping_slots_by_name(d: Domain) -> DataFrame:
    """A slot with a name but no code counts too."""
    key = F.col("p_partkey")
    rows = d.t("part").withColumns({"c1": F.when(key % 2 == 0, "").otherwise(F.col("p_brand")), "c2": F.lit(""), "n2": F.when(key % 3 == 0, F.col("p_name")).otherwise("")})
    return mappings.unpivot_slots(rows, "p_partkey", [("c1", "p_name"), ("c2", "n2")], need_code=False)


MATRIX = """cells AS (SELECT a.n_nationkey AS source, b.n_nationkey AS target, CASE WHEN a.n_nationkey = b.n_nationkey THEN CASE WHEN a.n_nationkey = 3 THEN 1 ELSE 0 END WHEN a.n_nationkey = 5 AND b.n_nationkey > 20 THEN 7
    ELSE (a.n_nationkey * b.n_nationkey + CASE WHEN a.n_nationkey = 8 THEN 1 ELSE 0 END) % 3 END AS tier FROM nation a CROSS JOIN nation b WHERE a.n_nationkey <> 11 OR b.n_nationkey < 20)"""


def matrix(d: Domain) -> DataFrame:
    a, b = (d.t("nation").select(F.col("n_nationkey").alias(n)) for n in ("source", "target"))
    x, y = F.col("source"), F.col("target")
    tier = F.when(x == y, F.when(x == 3, 1).otherwise(0)).when((x == 5) & (y > 20), 7).otherwise((x * y + F.when(x == 8, 1).otherwise(0)) % 3)
    return a.crossJoin(b).where("source <> 11 or target < 20").select("source", "target", tier.cast("int").alias("tier"))


@query(
    f"""WITH {MATRIX}, flipped AS (SELECT a.source, a.target, a.tier, b.tier AS back FROM cells a LEFT JOIN cells b ON a.source = b.target AND a.target = b.source)
    SELECT source, target, CASE WHEN tier NOT IN (0, 1, 2) THEN 'unknown_tier' ELSE 'diagonal' END AS issue FROM cells WHERE tier NOT IN (0, 1, 2) OR source = target AND tier <> 0
    UNION ALL SELECT source, target, CASE WHEN back IS NULL THEN 'hole' ELSE 'asymmetric' END FROM flipped WHERE tier IS DISTINCT FROM back"""
)
def matrix_faults(d: Domain) -> DataFrame:
    return quality.matrix_issues(matrix(d))


@query(f"WITH {MATRIX} SELECT source, max(tier) FILTER (target = 0) AS \"0\", max(tier) FILTER (target = 1) AS \"1\", max(tier) FILTER (target = 24) AS \"24\" FROM cells GROUP BY 1")
def matrix_wide(d: Domain) -> DataFrame:
    return wide_matrix(matrix(d), [0, 1, 24])


@query("SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'new' ELSE 'old' END AS v FROM orders WHERE o_custkey % 5 <> 0 OR o_custkey % 10 = 0 AND o_orderkey % 2 = 0")
def children_replaced(d: Domain) -> DataFrame:
    """Children of every fifth parent are new; of the odd ones among them nothing is left."""
    rows = d.t("orders").select("o_custkey", "o_orderkey", F.lit("old").alias("v"))
    new = rows.where("o_custkey % 10 = 0 and o_orderkey % 2 = 0").withColumn("v", F.lit("new"))
    gone = rows.where("o_custkey % 5 = 0").select("o_custkey").distinct()
    kept = releases.replace_children(rows, gone.select("o_custkey", F.lit(None).cast("long").alias("o_orderkey"), F.lit(None).cast("string").alias("v")), "o_custkey")
    return releases.replace_children(kept.where("v is not null"), new, "o_custkey")


@query(
    """WITH last AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS draft, arg_max(o_orderstatus, o_orderkey) AS status FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT c_custkey AS position_id, c_name AS extracted, coalesce(l.draft, c_name) AS draft, coalesce(l.status, 'Not validated') AS status FROM customer LEFT JOIN last l ON k = c_custkey"""
)
def drafts_kept(d: Domain) -> DataFrame:
    records = d.t("customer").select(F.col("c_custkey").alias("position_id"), F.col("c_name").alias("extracted"), F.col("c_name").alias("draft"), F.lit("Not validated").alias("status"))
    edits = d.t("orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("position_id"), F.col("o_orderpriority").alias("draft"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("edited_at"))
    return releases.drafts(records, edits, "position_id")


@query(
    f"""WITH a AS (SELECT o_orderstatus AS source_release, CAST(o_orderdate AS VARCHAR)[1:4] AS build_version, o_custkey % 8 AS part FROM orders),
    sets AS (SELECT part, count(DISTINCT source_release || build_version) AS n FROM a WHERE part < 4 AND source_release = 'F' AND build_version = (SELECT min(build_version) FROM a) OR part >= 4 GROUP BY 1)
    SELECT name, rows, roles, (SELECT max(n) = 1 FROM sets WHERE part < 4) AS same, (SELECT count(DISTINCT source_release || build_version) = 1 FROM a WHERE part >= 4) AS mixed,
      (SELECT string_agg(n_name, '|' ORDER BY n_name) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)) AS missing FROM ({ORACLES['dataset_reconciliation']})"""
)
def release_checks(d: Domain) -> DataFrame:
    """Data sets by roles; whether orders of one status and year, and all orders, are of one release; and nations (the
    required objects) without a rich supplier (those present)."""
    rows = quality.dataset_roles(activities=d.role_activities(), capabilities=d.role_capabilities())
    year = F.substring(F.col("o_orderdate").cast("string"), 1, 4)
    tagged = d.t("orders").select(F.col("o_orderstatus").alias("source_release"), year.alias("build_version"), (F.col("o_custkey") % 8).alias("part"))
    first = tagged.agg(F.min("build_version")).first()[0]
    of_one = tagged.where((F.col("source_release") == "F") & (F.col("build_version") == first))
    same = quality.same_release(*(of_one.where(F.col("part") == k) for k in range(4)))
    mixed = quality.same_release(*(tagged.where(F.col("part") == k) for k in range(4, 8)))
    nations = d.t("nation").select("n_nationkey", "n_name")
    present = nations.join(d.t("supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_semi")
    names = lambda df: [r["n_name"] for r in df.select("n_name").collect()]  # noqa: E731  of nations
    missing = "|".join(quality.missing_objects(names(present), names(nations))) or None  # nothing missing is null, as in SQL
    return rows.withColumns({"same": F.lit(same), "mixed": F.lit(mixed), "missing": F.lit(missing).cast("string")})


# --- frameworks, summaries, fans --------------------------------------------------------------------------------------


@query(
    """WITH hits AS (SELECT l_suppkey AS doc, p_brand AS framework, count(DISTINCT p_type || p_size) AS shared FROM lineitem JOIN part ON p_partkey = l_partkey
      JOIN (SELECT DISTINCT p_brand AS b, p_type || p_size AS t FROM part) ON b = p_brand AND t = p_type || p_size WHERE l_quantity > 45 GROUP BY 1, 2)
    SELECT doc, framework, shared FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY shared DESC, framework) AS k FROM (
      SELECT n.doc, s.b AS framework, count(*) AS shared FROM (SELECT DISTINCT l_suppkey AS doc, p_type || p_size AS t FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45) n JOIN (SELECT DISTINCT p_brand AS b, p_type || p_size AS t FROM part) s USING (t) GROUP BY 1, 2)) WHERE k = 1"""
)
def framework_detected(d: Domain) -> DataFrame:
    name = F.concat("p_type", F.col("p_size").cast("string")).alias("name")
    names = d.t("lineitem").where("l_quantity > 45").join(d.t("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("l_suppkey").alias("doc"), name)
    signatures = d.t("part").select("p_brand", name).distinct()
    brands = d.t("part").groupBy(F.col("p_brand").alias("framework")).count()
    places = brands.join(brands.select(F.col("framework").alias("other")), F.col("other") <= F.col("framework")).groupBy("framework").agg(F.count("*").alias("place"))
    return extraction.best_framework(names, signatures.withColumnRenamed("p_brand", "framework").join(places, "framework"))


@query(f"WITH {ctes('role_activities')}, sizes AS (SELECT role_id, count(*) AS n FROM role_activities GROUP BY 1) SELECT count(*) AS roles, min(n) AS least, max(n) AS most, CAST(sum(role_id % 3) AS BIGINT) AS retries, count_if(role_id % 10 = 0) AS fallbacks FROM sizes")
def run_totals(d: Domain) -> DataFrame:
    sizes = d.role_activities().groupBy("role_id").agg(F.count("*").alias("n"))
    return vocabulary.run_summary(sizes.withColumns({"retries": F.col("role_id") % 3, "fallback_used": F.col("role_id") % 10 == 0}))


def fans(d: Domain, status: str) -> DataFrame:
    edges = edges_of(d).select("role_id", "neighbour_role_id", "neighbour_rank")
    pools = edges.where("neighbour_rank <= 4").select(F.col("role_id").alias("source_role_id"), F.col("neighbour_role_id").alias("candidate_role_id"), F.when(F.col("neighbour_rank") > 1, F.col("neighbour_rank") - 1).alias("rank_default"))
    pools = pools.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    versions = d.spark.createDataFrame([(1, "published"), (2, status), (3, "draft")], "version int, status string").where("version > 1 or status <> 'published' or 'draft' <> '" + status + "'")
    return payloads.published_fan(pools, versions, edges)


@query(f"WITH {EDGES} SELECT a AS source_role_id, b AS candidate_role_id, CAST(neighbour_rank - 1 AS INT) AS place, FALSE AS provisional FROM edges WHERE neighbour_rank BETWEEN 2 AND 4")
def fan_published(d: Domain) -> DataFrame:
    return fans(d, "published")


@query(f"WITH {EDGES} SELECT a AS source_role_id, b AS candidate_role_id, CAST(neighbour_rank AS INT) AS place, TRUE AS provisional FROM edges")
def fan_provisional(d: Domain) -> DataFrame:
    return fans(d, "draft")


DEEP = f"""{ctes("hierarchy")}, numbered AS (SELECT CAST(o_orderkey AS VARCHAR) AS code, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders),
    deep AS (SELECT a.code, coalesce(b.code, '') AS parent_code FROM numbered a LEFT JOIN numbered b ON b.n = a.n - 3
      UNION ALL SELECT code, CASE WHEN parent_code = '' THEN (SELECT code FROM numbered ORDER BY n DESC LIMIT 1) ELSE parent_code END FROM hierarchy)"""


@query(f"""WITH RECURSIVE {DEEP}, down AS (SELECT code, 1 AS depth, code AS root FROM deep WHERE parent_code = '' UNION ALL SELECT deep.code, depth + 1, root FROM down JOIN deep ON parent_code = down.code)
    SELECT code, CAST(depth AS BIGINT) AS depth, root FROM down""")
def deep_hierarchy(d: Domain) -> DataFrame:
    """Three chains, each of a third of all orders, and the hierarchy under the end of one: the depth of every code."""
    orders = consecutive(d.t("orders").select("o_orderkey"), "o_orderkey", name="n")
    numbered = orders.select(F.col("o_orderkey").cast("string").alias("code"), "n")
    above = numbered.select(F.col("code").alias("parent_code"), (F.col("n") + 3).alias("n"))
    chains = numbered.join(above.hint("merge"), "n", "left").select("code", F.coalesce("parent_code", F.lit("")).alias("parent_code"))
    last = numbered.orderBy(F.desc("n")).limit(1).select(F.col("code").alias("last"))
    tree = d.hierarchy().crossJoin(F.broadcast(last)).select("code", F.when(F.col("parent_code") == "", F.col("last")).otherwise(F.col("parent_code")).alias("parent_code"))
    return hierarchy.depths(chains.unionByName(tree))


RINGS = """customers AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS n FROM customer),
    rings AS (SELECT a.k AS code, b.k AS parent_code FROM customers a LEFT JOIN customers b ON b.n = CASE WHEN a.n % 128 < 127 THEN a.n + 1 WHEN a.n // 128 % 2 = 0 THEN a.n - 127 ELSE a.n - 255 END)"""


def rings(d: Domain) -> DataFrame:
    """Customers in blocks of 128, each under the next one. The last of every other block is under its first, which closes
    a cycle; the last of the blocks between is under the first of the block before. A short block ends."""
    numbered = consecutive(d.t("customer").select("c_custkey"), "c_custkey", name="n").select(F.col("c_custkey").alias("code"), (F.col("n") - 1).alias("n"))
    over = F.when(F.col("n") % 128 < 127, F.col("n") + 1).when(F.floor(F.col("n") / 128) % 2 == 0, F.col("n") - 127).otherwise(F.col("n") - 255)
    return numbered.withColumn("over", over).join(numbered.select(F.col("code").alias("parent_code"), F.col("n").alias("over")), "over", "left").select("code", "parent_code")


@query(f"""WITH RECURSIVE {RINGS}, hung AS (SELECT CAST(code AS VARCHAR) AS code, CAST(parent_code AS VARCHAR) AS parent_code FROM rings UNION ALL SELECT 'S' || s_suppkey, CAST(s_suppkey * 7 % 700 + 1 AS VARCHAR) FROM supplier),
    up AS (SELECT code, parent_code AS top, 1 AS n FROM hung UNION ALL SELECT up.code, hung.parent_code, n + 1 FROM up JOIN hung ON hung.code = top WHERE n < 600 AND hung.parent_code IS NOT NULL)
    SELECT code, bool_or(top = code) AS on_cycle FROM up GROUP BY 1 HAVING max(n) >= 600""")
def long_cycles(d: Domain) -> DataFrame:
    """Codes from which walks never end: cycles of 128 customers, and the customers and suppliers that hang at them."""
    text = lambda c: F.col(c).cast("string").alias(c)
    hung = rings(d).select(text("code"), text("parent_code"))
    hung = hung.unionByName(d.t("supplier").select(F.concat(F.lit("S"), "s_suppkey").alias("code"), (F.col("s_suppkey") * 7 % 700 + 1).cast("string").alias("parent_code")))
    on = hierarchy.cycles(hung).withColumn("on_cycle", F.lit(True))
    return hierarchy.endless(hung).join(on, "code", "left").select("code", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


@query(
    f"""WITH {EDGES}, x AS (SELECT a, string_agg(neighbour_rank || ':' || b, ',' ORDER BY neighbour_rank) AS neighbours FROM edges GROUP BY 1),
    y AS (SELECT role_id, string_agg(activity_rank || ':' || activity, ',' ORDER BY activity_rank) AS activities FROM role_activities GROUP BY 1)
    SELECT r.role_id, title, family, neighbours, activities, regexp_matches(title, '(?i)\\b(manager|director|chief|lead)\\b') AS is_manager FROM roles r LEFT JOIN x ON x.a = r.role_id LEFT JOIN y ON y.role_id = r.role_id"""
)
def role_payload_fields(d: Domain) -> DataFrame:
    rows = payloads.role_payloads(d.roles(), d.role_activities(), d.role_capabilities().where("focus"), edges_of(d))
    shape = "title string, family int, is_manager boolean, neighbours array<struct<neighbour_rank:int,neighbour_role_id:bigint>>, activities array<struct<activity_rank:int,activity:string>>"
    x = rows.select("role_id", F.from_json("payload", shape).alias("p")).select("role_id", "p.*")
    listed = lambda c, k, v: F.array_join(F.transform(c, lambda y: F.concat_ws(":", y[k], y[v])), ",").alias(c)
    return x.select("role_id", "title", "family", listed("neighbours", "neighbour_rank", "neighbour_role_id"), listed("activities", "activity_rank", "activity"), "is_manager")


@query(f"WITH {ctes('roles')} SELECT count(*) AS roles, count(DISTINCT family) AS families, count(DISTINCT rung) AS grades FROM roles")
def explorer_totals(d: Domain) -> DataFrame:
    return payloads.explorer_summary(d.roles())


@query(f"WITH {ctes('vectors')} SELECT vec_id, code FROM vectors WHERE code IN (1, 3) AND vec_id % 2 = 0")
def facet_codes(d: Domain) -> DataFrame:
    rows = d.vectors().withColumn("tags", F.array((F.col("vec_id") % 2).cast("int"), F.lit(9)))
    return similarity.facets(rows, code=[1, 3], tags=[0, 4], validated=[]).select("vec_id", "code")
