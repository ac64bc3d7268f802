"""Ranked mappings of positions to hierarchy codes: overrides, primary rules, batches and slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truthy


def active_mappings(imported: DataFrame, assigned: DataFrame) -> DataFrame:
    """Imported mappings of positions without a manual one, and all manual ones.

    One manual mapping hides every imported rank of its position. Manual rows have negative ids and valid codes.
    """
    kept = imported.join(assigned.select("position_id").distinct(), "position_id", "left_anti").withColumn("origin", F.lit("imported"))
    manual = assigned.withColumn("id", -F.col("id")).withColumn("code_valid", F.lit(1)).withColumn("origin", F.lit("assigned"))
    return kept.unionByName(manual)


def _first(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def primary_by_rank(mappings: DataFrame) -> DataFrame:
    """Lowest (rank, id) of any rank with a code."""
    return _first(mappings.where("code is not null"), "position_id", "mapping_rank", "id")


def primary_by_validation(mappings: DataFrame) -> DataFrame:
    """Among rank 1: validated first, then valid codes, then the smallest code."""
    return _first(mappings.where("mapping_rank = 1"), "position_id", F.desc(F.lower("validated") == "yes"), F.desc("code_valid"), "mapping_rank", "code")


def primary_by_validation_then_id(mappings: DataFrame) -> DataFrame:
    """As `primary_by_validation`, but the smallest id decides last."""
    return _first(mappings.where("mapping_rank = 1"), "position_id", F.desc(F.lower("validated") == "yes"), F.desc("code_valid"), "mapping_rank", "id")


def primary_last_of_rank_one(mappings: DataFrame) -> DataFrame:
    """The last rank-1 row in import order (position, rank, id)."""
    return _first(mappings.where("mapping_rank = 1"), "position_id", F.desc("mapping_rank"), F.desc("id"))


def any_rank_one(mappings: DataFrame) -> DataFrame:
    """All rank-1 rows, with their fan-out where a position has several."""
    return mappings.where("mapping_rank = 1")


def unpivot_slots(rows: DataFrame, key: str, slots: list[tuple[str, str]], need_code: bool = True) -> DataFrame:
    """(key, mapping_rank, code, name) from numbered (code, name) column pairs; a slot needs a code, or a code or a name."""
    stack = F.explode(F.array(*(F.struct(F.lit(k).alias("mapping_rank"), F.col(c).cast("string").alias("code"), F.col(n).cast("string").alias("name")) for k, (c, n) in enumerate(slots, 1))))
    long = rows.select(key, stack.alias("slot")).select(key, "slot.*")
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return long.where(filled("code") if need_code else filled("code") | filled("name"))


def by_number_prefix(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Left join of `rows` (pd_id) with positions whose number or file name begins with the id and a dash; one row per
    version. The prefix is a derived key, so both conditions are equi-joins."""
    keys = positions.select("position_id", F.explode(F.array_distinct(F.array(_base("number"), _base("filename")))).alias("pd_id"))
    return rows.join(keys.where("pd_id <> ''").distinct(), "pd_id", "left")


def by_base_number(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """As `by_number_prefix`, but the file name counts only for positions without a number."""
    number = F.when(F.coalesce(F.col("number"), F.lit("")) != "", F.col("number")).otherwise(F.col("filename"))
    keys = positions.select("position_id", F.split(number, "-")[0].alias("pd_id"))
    return rows.join(keys, "pd_id", "left")


def _base(column: str) -> Column:
    text = F.coalesce(F.col(column), F.lit(""))
    return F.when(text.contains("-"), F.split(text, "-")[0]).otherwise("")


def with_new_batch(batches: DataFrame, batch_id: int, source: str) -> DataFrame:
    """Adds an import batch, which is then the only active one."""
    new = batches.sparkSession.createDataFrame([(batch_id, source)], "id long, source string").withColumn("is_active", F.lit(True))
    return batches.withColumn("is_active", F.lit(False)).unionByName(new)


def replace_assignments(assigned: DataFrame, position_id: int, codes: list[str], active_codes: DataFrame) -> DataFrame:
    """Replaces a position's manual mappings with one to three different active codes."""
    codes = list(dict.fromkeys(c.strip() for c in codes if c and c.strip()))
    if not 1 <= len(codes) <= 3:
        raise ValueError("a position takes one to three codes")
    spark = assigned.sparkSession
    wanted = spark.createDataFrame([(position_id, k, c) for k, c in enumerate(codes, 1)], "position_id long, mapping_rank int, code string")
    if (unknown := wanted.join(active_codes.select("code"), "code", "left_anti").limit(3).collect()):
        raise ValueError(f"codes that aren't active: {', '.join(r.code for r in unknown)}")
    last = assigned.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = wanted.withColumn("id", F.col("mapping_rank").cast("long") + last).withColumn("validated", F.lit("")).withColumn("code_valid", F.lit(1))
    return assigned.where(F.col("position_id") != position_id).unionByName(rows.select(assigned.columns))


def import_status(mappings: DataFrame) -> DataFrame:
    """Counts over an import: rows, positions, codes, valid and validated ones, one row."""
    valid = F.col("code_valid") == 1
    return mappings.agg(
        F.count("*").alias("mappings"),
        F.countDistinct("position_id").alias("positions"),
        F.countDistinct("code").alias("codes"),
        F.count_if(valid).alias("valid"),
        F.count_if(~valid).alias("invalid"),
        F.countDistinct(F.when(~valid, F.col("position_id"))).alias("positions_with_invalid"),
        F.count_if(truthy(F.col("validated"))).alias("validated"),
        F.countDistinct(F.when(truthy(F.col("validated")), F.col("position_id"))).alias("positions_validated"),
        F.count_if(F.col("mapping_rank") == 1).alias("primary_mappings"),
    )


def of_active_batch(rows: DataFrame, batches: DataFrame) -> DataFrame:
    """Rows (batch_id) of the active import batches, with the batch's source."""
    active = batches.where("is_active").select(F.col("id").alias("batch_id"), "source")
    return rows.join(active, "batch_id")
