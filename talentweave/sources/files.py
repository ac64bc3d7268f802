"""Text, CSV, JSON and directory sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, columns: list[str] | StructType) -> DataFrame:
    """CSV with a header; columns are text unless a schema is given. A byte order mark is no part of the first name."""
    schema = columns if isinstance(columns, StructType) else ", ".join(f"`{c}` string" for c in columns)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str], one_file: bool = False) -> None:
    """The given columns only; null as empty, booleans as true and false. One file only for small summaries."""
    out = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str, glob: str = "*.json") -> DataFrame:
    """JSON documents of a directory but those whose names begin with `_`, with their file name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", glob).json(path)
    return rows.withColumn("file_name", F.col("_metadata.file_name")).where(~F.col("file_name").startswith("_"))


def read_jsonl(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last line of each key; lines that aren't JSON or lack the key are left out."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"))
    rows = lines.withColumn("row", F.from_json("value", schema)).where(F.col(f"row.{key}").isNotNull())
    return rows.groupBy(F.col(f"row.{key}").alias("_key")).agg(F.max_by("row", F.struct("f", "s", "n")).alias("row")).select("row.*")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_files(spark: SparkSession, path: str, glob: str = "*.docx", limit: int | None = None) -> DataFrame:
    """(path, content) of the files of a directory; lock files (`~$`) are left out, `limit` takes the first by name."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    rows = rows.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")
    return rows.orderBy("path").limit(limit) if limit else rows


def read_database(spark: SparkSession, url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query of a relational database by JDBC; `partition` is (column, lower, upper, parts) for parallel reads."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) q").options(**options)
    if partition:
        reader = reader.option("partitionColumn", partition[0]).option("lowerBound", partition[1]).option("upperBound", partition[2]).option("numPartitions", partition[3])
    return reader.load()


def copy_to_database(df: DataFrame, url: str, table: str, batch: int = 1000, **options: str) -> None:
    """Copies to an empty table in batches and compares the counts; refuses a table that has rows."""
    spark = df.sparkSession
    count = lambda: read_database(spark, url, f"select count(*) as n from {table}", **options).first()[0]
    if count():
        raise ValueError(f"{table} isn't empty")
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode("append").save()
    if count() != df.count():
        raise ValueError(f"{table} has another number of rows than its source")


def long_matrix(df: DataFrame, key: str) -> DataFrame:
    """(source, target, tier) of a square matrix whose columns but `key` are the targets."""
    targets = [c for c in df.columns if c != key]
    long = df.unpivot(key, targets, "target", "tier").withColumnRenamed(key, "source")
    return long.withColumn("tier", F.col("tier").cast("string").try_cast("double").cast("int"))


def wide_matrix(cells: DataFrame, targets: list) -> DataFrame:
    return cells.groupBy("source").pivot("target", targets).agg(F.first("tier"))
