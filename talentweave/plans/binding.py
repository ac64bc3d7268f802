"""The role domain over the driver's tables: each relation as a DataFrame, and as a DuckDB CTE for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Domain:
    """Bound relations of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        ship(spark)
        self.spark, self.t = spark, lambda name: table(spark, sf_dir, name)

    def roles(self) -> DataFrame:
        nation = self.t("nation").select("n_nationkey", "n_regionkey")
        joined = self.t("supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.col("s_suppkey").alias("role_id"),
            F.col("s_name").alias("title"),
            F.col("n_regionkey").alias("family"),
            F.col("n_nationkey").alias("sub_family"),
            (F.col("s_suppkey") % 3).cast("int").alias("specialisation"),
            F.floor((F.col("s_acctbal") + 1000) / 500).cast("int").alias("rung"),
            F.when(F.col("s_suppkey") % 10 == 0, "archived").otherwise("active").alias("status"),
        )

    def parts_of_roles(self) -> DataFrame:
        part = self.t("part").select("p_partkey", "p_brand", "p_type")
        lines = self.t("lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))

    def role_activities(self) -> DataFrame:
        activity = F.concat_ws("|", "p_brand", "p_type")
        sums = self.parts_of_roles().groupBy(F.col("l_suppkey").alias("role_id"), activity.alias("activity")).agg(F.sum("l_quantity").alias("q"))
        order = Window.partitionBy("role_id").orderBy(F.desc("q"), "activity")
        return sums.withColumn("activity_rank", F.row_number().over(order)).where("activity_rank <= 14").select("role_id", "activity", "activity_rank")

    def role_capabilities(self) -> DataFrame:
        grouped = self.parts_of_roles().groupBy(F.col("l_suppkey").alias("role_id"), F.col("p_type").alias("capability"))
        sums = grouped.agg(F.sum("l_linenumber").cast("long").alias("n"), F.sum("l_quantity").cast("long").alias("q"))
        return sums.select("role_id", "capability", (1 + F.col("n") % 5).cast("double").alias("level"), (F.col("q") % 3 == 0).alias("focus"))

    def adjacency(self) -> DataFrame:
        a, b = (self.t("region").select(F.col("r_regionkey").alias(n)) for n in ("source", "target"))
        pairs = F.broadcast(a).crossJoin(b)  # families of families: a few rows
        return pairs.where("not (least(source, target) = 0 and greatest(source, target) = 4)").withColumn("tier", F.least(F.abs(F.col("source") - F.col("target")), F.lit(2)))

    def hierarchy(self) -> DataFrame:
        regions = self.t("region").select(F.concat(F.lit("R"), "r_regionkey").alias("code"), F.col("r_name").alias("name"), F.lit("Job Family").alias("level"), F.lit("").alias("parent_code"))
        code = F.concat(F.lit("R"), "n_regionkey", F.lit("-N"), "n_nationkey")
        nations = self.t("nation").select(code.alias("code"), F.col("n_name").alias("name"), F.lit("Sub-family").alias("level"), F.concat(F.lit("R"), "n_regionkey").alias("parent_code"))
        specs = self.t("nation").select(code.alias("parent_code"), "n_name", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
        specs = specs.select(F.concat("parent_code", F.lit("-S"), "k").alias("code"), F.concat("n_name", F.lit(" "), "k").alias("name"), F.lit("Specialisation").alias("level"), "parent_code")
        return regions.unionByName(nations).unionByName(specs)

    def mappings(self, assigned: bool = False) -> DataFrame:
        """Imported (or manually assigned) ranked mappings of positions."""
        orders = self.t("orders").where((F.col("o_orderstatus") == "P") if assigned else F.col("o_orderstatus").isin("F", "O"))
        order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        ranked = orders.withColumn("mapping_rank", F.row_number().over(order)).where("mapping_rank <= 3")
        return ranked.select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("position_id"),
            "mapping_rank",
            F.col("o_orderpriority").alias("code"),
            F.when(F.col("o_orderstatus") == "F", "Yes").otherwise("").alias("validated"),
            (F.col("o_orderkey") % 4 != 0).cast("int").alias("code_valid"),
        )

    def vectors(self) -> DataFrame:
        return self.t("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("code"), (F.col("label") % 2 == 0).alias("validated"))


CTE = {
    "roles": """SELECT s_suppkey AS role_id, s_name AS title, n_regionkey AS family, n_nationkey AS sub_family, CAST(s_suppkey % 3 AS INT) AS specialisation,
        CAST(floor((s_acctbal + 1000) / 500) AS INT) AS rung, CASE WHEN s_suppkey % 10 = 0 THEN 'archived' ELSE 'active' END AS status
      FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "role_activities": """SELECT role_id, activity, activity_rank FROM (
        SELECT role_id, activity, row_number() OVER (PARTITION BY role_id ORDER BY q DESC, activity) AS activity_rank FROM (
          SELECT l_suppkey AS role_id, p_brand || '|' || p_type AS activity, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))
      WHERE activity_rank <= 14""",
    "role_capabilities": """SELECT l_suppkey AS role_id, p_type AS capability, CAST(1 + CAST(sum(l_linenumber) AS BIGINT) % 5 AS DOUBLE) AS level,
        CAST(sum(l_quantity) AS BIGINT) % 3 = 0 AS focus
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "adjacency": """SELECT a.r_regionkey AS source, b.r_regionkey AS target, least(abs(a.r_regionkey - b.r_regionkey), 2) AS tier
      FROM region a CROSS JOIN region b WHERE NOT (least(a.r_regionkey, b.r_regionkey) = 0 AND greatest(a.r_regionkey, b.r_regionkey) = 4)""",
    "hierarchy": """SELECT 'R' || r_regionkey AS code, r_name AS name, 'Job Family' AS level, '' AS parent_code FROM region
      UNION ALL SELECT 'R' || n_regionkey || '-N' || n_nationkey, n_name, 'Sub-family', 'R' || n_regionkey FROM nation
      UNION ALL SELECT 'R' || n_regionkey || '-N' || n_nationkey || '-S' || k, n_name || ' ' || k, 'Specialisation', 'R' || n_regionkey || '-N' || n_nationkey
        FROM nation CROSS JOIN (VALUES (0), (1), (2)) v(k)""",
    "imported": """SELECT id, position_id, mapping_rank, code, validated, code_valid FROM (
        SELECT o_orderkey AS id, o_custkey AS position_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS mapping_rank,
          o_orderpriority AS code, CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE '' END AS validated, CAST(o_orderkey % 4 <> 0 AS INT) AS code_valid
        FROM orders WHERE o_orderstatus IN ('F', 'O')) WHERE mapping_rank <= 3""",
    "assigned": """SELECT id, position_id, mapping_rank, code, validated, code_valid FROM (
        SELECT o_orderkey AS id, o_custkey AS position_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS mapping_rank,
          o_orderpriority AS code, '' AS validated, CAST(o_orderkey % 4 <> 0 AS INT) AS code_valid
        FROM orders WHERE o_orderstatus = 'P') WHERE mapping_rank <= 3""",
    "vectors": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vector, label AS code, label % 2 = 0 AS validated FROM embeddings",
}


def ctes(*names: str) -> str:
    return ", ".join(f"{n} AS ({CTE[n]})" for n in names)
