"""Registered queries on audits, lookups and rosters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import audits, features, payloads, quality, similarity, summaries
from .binding import Domain, ctes
from .queries import ACTIVE, EDGES, RARITY, SIMILAR, active_of, edges_of, near_of, query

GRADES = "grades AS (SELECT DISTINCT rung, 'Grade ' || rung AS label FROM roles WHERE rung < 20)"
NODES = "nodes(code, name) AS (VALUES ('1-URGENT', 'urgent'), ('2-HIGH', 'high'), ('3-MEDIUM', 'medium'))"


def grades_of(d: Domain) -> DataFrame:
    return d.roles().where("rung < 20").select("rung", F.concat(F.lit("Grade "), "rung").alias("label")).distinct()


def positions_as_roles(d: Domain) -> DataFrame:
    return d.t("customer").select(F.col("c_custkey").alias("role_id"), F.col("c_name").alias("title"))


@query(f"WITH {ctes('roles')}, {GRADES} SELECT role_id, rung, label FROM roles LEFT JOIN grades USING (rung)")
def classification_join(d: Domain) -> DataFrame:
    return audits.with_grades(d.roles().select("role_id", "rung"), grades_of(d))


@query(f"WITH {ACTIVE} SELECT c_custkey AS role_id, code FROM customer LEFT JOIN active_mappings ON position_id = c_custkey AND mapping_rank = 1")
def rank_one_fan_out(d: Domain) -> DataFrame:
    return audits.with_rank_one(positions_as_roles(d), active_of(d)).select("role_id", "code")


@query(f"WITH {ACTIVE}, {NODES} SELECT c_custkey AS role_id, (SELECT name FROM active_mappings m JOIN nodes USING (code) WHERE m.position_id = c_custkey ORDER BY mapping_rank, id LIMIT 1) AS primary_name FROM customer")
def primary_name_lookup(d: Domain) -> DataFrame:
    nodes = d.spark.createDataFrame([("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium")], "code string, name string")
    return audits.with_primary_name(positions_as_roles(d), active_of(d), nodes).select("role_id", "primary_name")


@query(f"WITH {EDGES} SELECT a AS role_id, b AS neighbour_role_id, CAST(neighbour_rank AS INT) AS neighbour_rank, x.title AS title, y.title AS neighbour_title FROM edges JOIN roles x ON x.role_id = a JOIN roles y ON y.role_id = b")
def role_neighbour_audit(d: Domain) -> DataFrame:
    return audits.neighbour_audit(edges_of(d), d.roles()).select("role_id", "neighbour_role_id", "neighbour_rank", "title", "neighbour_title")


@query(f"WITH {ctes('roles', 'role_activities')}, {RARITY} SELECT role_id, title, activity, CAST(activity_rank AS INT) AS activity_rank, round(share, 6) AS share FROM roles JOIN role_activities USING (role_id) LEFT JOIN (SELECT * FROM rarity WHERE role_count > 5) USING (activity)")
def role_activity_audit(d: Domain) -> DataFrame:
    statistics = features.activity_rarity(d.role_activities(), d.roles()).where("role_count > 5")
    return audits.activity_audit(d.roles(), d.role_activities(), statistics).withColumn("share", F.round("share", 6))


@query(f"WITH {ctes('roles', 'role_capabilities')} SELECT role_id, title, capability, level, focus FROM roles JOIN role_capabilities USING (role_id)")
def role_capability_audit(d: Domain) -> DataFrame:
    return audits.capability_audit(d.roles(), d.role_capabilities())


@query(
    f"""WITH {ctes("roles", "role_activities", "role_capabilities")} SELECT role_id, title, (SELECT count(*) FROM role_activities a WHERE a.role_id = r.role_id) AS activities,
      (SELECT count(*) FROM role_capabilities c WHERE c.role_id = r.role_id AND focus) AS capabilities FROM roles r"""
)
def role_overview_audit(d: Domain) -> DataFrame:
    return audits.overview(d.roles(), d.role_activities(), d.role_capabilities().where("focus"))


@query(f"WITH {ctes('roles')} SELECT c_custkey AS position_id, role_id, coalesce(status, 'active') AS record_status FROM customer LEFT JOIN (SELECT role_id, nullif(status, 'active') AS status FROM roles) ON role_id = c_custkey")
def identity_update(d: Domain) -> DataFrame:
    identity = d.roles().select(F.col("role_id").alias("position_id"), "role_id", F.nullif("status", F.lit("active")).alias("record_status"))
    return audits.identified(d.t("customer").select(F.col("c_custkey").alias("position_id")), identity)


@query(f"WITH {ctes('roles')}, {GRADES} SELECT 'Grade ' || rung AS grade, count(*) AS n FROM roles WHERE NOT EXISTS (SELECT 1 FROM grades g WHERE g.rung = roles.rung) GROUP BY 1")
def missing_grade_labels(d: Domain) -> DataFrame:
    roles = d.roles().select(F.concat(F.lit("Grade "), "rung").alias("grade"))
    return quality.missing_grades(roles, grades_of(d).select(F.col("label").alias("grade")))


@query(f"WITH {EDGES}, known AS (SELECT role_id FROM roles WHERE role_id % 13 <> 0) SELECT a AS role_id, b AS neighbour_role_id FROM edges WHERE a NOT IN (SELECT role_id FROM known) OR b NOT IN (SELECT role_id FROM known)")
def unresolved_neighbours(d: Domain) -> DataFrame:
    return quality.unresolved_ends(edges_of(d).select("role_id", "neighbour_role_id"), d.roles().where("role_id % 13 <> 0"))


@query(
    f"""WITH {ctes("roles")}, s AS (SELECT l_suppkey AS role_id, l_orderkey * 10 + l_linenumber AS sequence, l_returnflag AS statement, l_partkey FROM lineitem),
    n AS (SELECT *, row_number() OVER (PARTITION BY role_id ORDER BY sequence, l_partkey, statement) AS k FROM s), h AS (SELECT role_id, count(*) AS t, string_agg(statement, '' ORDER BY k) FILTER (k <= 3) AS head FROM n GROUP BY 1)
    SELECT 'F' || family AS code, count(*) AS total, string_agg(role_id || ':' || t, '|' ORDER BY role_id) AS roles FROM roles LEFT JOIN h USING (role_id) GROUP BY 1"""
)
def family_roster(d: Domain) -> DataFrame:
    lines = d.t("lineitem").select(F.col("l_suppkey").alias("role_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sequence"), F.col("l_returnflag").alias("statement"))
    roles = d.roles().select("role_id", "title", F.concat(F.lit("F"), "family").alias("code"))
    rows = similarity.roster(roles, lines)
    return rows.select("code", "total", F.array_join(F.transform("roles", lambda x: F.concat_ws(":", x["role_id"], x["statement_total"])), "|").alias("roles"))


@query(f"WITH {ctes('role_capabilities')} SELECT role_id, capability, arg_max(level, level * 10 + role_id % 7) AS level FROM role_capabilities WHERE focus GROUP BY 1, 2")
def last_focus_level(d: Domain) -> DataFrame:
    rows = d.role_capabilities().withColumn("seq", F.col("level") * 10 + F.col("role_id") % 7)
    return features.last_focus_level(rows, "seq")


@query(
    f"""WITH {ctes("roles", "role_activities")} SELECT r.role_id, CASE WHEN a.role_id IS NULL AND rung > 15 THEN 'missing_activities_and_grade_rung' WHEN a.role_id IS NULL THEN 'missing_activities'
      WHEN rung > 15 THEN 'missing_grade_rung' ELSE 'ready' END AS status FROM roles r LEFT JOIN (SELECT DISTINCT role_id FROM role_activities WHERE role_id % 3 <> 0) a USING (role_id)"""
)
def feature_status(d: Domain) -> DataFrame:
    linked = d.role_activities().where("role_id % 3 <> 0").select("role_id").distinct().withColumn("linked", F.lit(True))
    rows = d.roles().join(linked, "role_id", "left")
    return rows.select("role_id", scoring.feature_status(F.col("linked").isNull(), F.col("family").isNull(), F.col("rung") > 15).alias("status"))


@query(
    f"""WITH {SIMILAR} SELECT query_id, code, string_agg(CAST(vec_id AS VARCHAR), '|' ORDER BY similarity DESC, vec_id DESC) AS evidence FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, code ORDER BY similarity DESC, vec_id DESC) AS k FROM near) WHERE k <= 10 GROUP BY 1, 2"""
)
def evidence_lists(d: Domain) -> DataFrame:
    rows = similarity.evidence_lists(near_of(d, 25))
    return rows.select("query_id", "code", F.array_join(F.transform("evidence", lambda x: x["vec_id"].cast("string")), "|").alias("evidence"))


@query("SELECT c_mktsegment, min(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END) AS rank FROM customer GROUP BY 1")
def facet_options(d: Domain) -> DataFrame:
    rows = d.t("customer").withColumn("k", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")))
    return similarity.facet_options(rows, "c_mktsegment", "k")


@query(f"WITH {ctes('roles')} SELECT count(*) AS roles, count(DISTINCT family) AS families, count(DISTINCT rung) AS grades FROM roles")
def explorer_summary(d: Domain) -> DataFrame:
    return payloads.explorer_summary(d.roles())


@query(f"WITH {ctes('adjacency')} SELECT a.r_regionkey AS source, b.r_regionkey AS target, CASE WHEN a.r_regionkey = b.r_regionkey THEN -1 ELSE coalesce(tier, 2) END AS tier FROM region a CROSS JOIN region b LEFT JOIN adjacency ON source = a.r_regionkey AND target = b.r_regionkey")
def reference_adjacency(d: Domain) -> DataFrame:
    families = d.t("region").select(F.col("r_regionkey").alias("family"))
    empty = d.role_capabilities()
    return payloads.reference_tables(d.roles(), d.role_activities(), empty, edges_of(d), d.adjacency(), families)["adjacency"]


@query("SELECT 'region' AS name, count(*) AS rows, count(DISTINCT region) AS distinct_rows FROM region UNION ALL SELECT 'lineitem', count(*), (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) FROM lineitem")
def table_statistics(d: Domain) -> DataFrame:
    return audits.table_statistics(region=d.t("region"), lineitem=d.t("lineitem").select("l_orderkey", "l_linenumber"))


@query(
    "SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY first) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first FROM orders GROUP BY 1, 2) GROUP BY 1"
)
def unique_in_order(d: Domain) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"])
    return d.t("orders").groupBy("o_custkey").agg(F.array_join(audits.unique_in_order(ordered), "|").alias("priorities"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) GROUP BY 1")
def resumed_stage(d: Domain) -> DataFrame:
    from ..operators.releases import resume

    events = d.t("events")
    return resume(events, events.where("event_id % 3 = 0"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    """WITH new AS (SELECT o_orderkey, 'new' AS p FROM orders WHERE o_orderkey % 4 = 0), old AS (SELECT o_orderkey, o_orderpriority AS p FROM orders WHERE o_orderkey % 3 = 0)
    SELECT p, count(*) AS n FROM (SELECT * FROM new UNION ALL SELECT * FROM old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new)) GROUP BY 1"""
)
def upsert_by_key(d: Domain) -> DataFrame:
    from ..operators.releases import upsert

    rows = d.t("orders").select("o_orderkey", F.col("o_orderpriority").alias("p"))
    new = rows.where("o_orderkey % 4 = 0").withColumn("p", F.lit("new"))
    return upsert(rows.where("o_orderkey % 3 = 0"), new, ["o_orderkey"]).groupBy("p").agg(F.count("*").alias("n"))


@query(f"WITH {ctes('roles')} SELECT count_if(status = 'active') AS succeeded, count_if(status <> 'active') AS failed FROM roles")
def bulk_tally(d: Domain) -> DataFrame:
    return summaries.tally(d.roles().withColumn("ok", F.col("status") == "active"), "ok")
