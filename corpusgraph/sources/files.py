"""Tables, and file names as keys between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.ingest import basename


def read_table(spark: SparkSession, path: str, jdbc: dict | None = None) -> DataFrame:
    """A table from Parquet, or over JDBC with a partitioned read."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.parquet(path)


def widen(rows: DataFrame, key: str) -> DataFrame:
    """Spread a table that arrives in fewer splits than there are cores.

    Large tables have more splits than cores and pass through unchanged, so
    nothing is shuffled where shuffling would cost.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, key) if rows.rdd.getNumPartitions() < cores else rows


def stem(path: Column) -> Column:
    """File name without directories and extension."""
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def join_sidecar_text(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Attach pre-extracted text by file stem; ``texts`` is (path, text)."""
    side = texts.select(stem(F.col("path")).alias("stem"), "text")
    return files.withColumn("stem", stem(F.col("filename"))).join(side, "stem", "left")


def filename_index(files: DataFrame) -> DataFrame:
    """One path per file name, the last scanned wins; ``files`` is (path, filename, scan_order)."""
    return files.groupBy("filename").agg(F.max_by("path", F.struct("scan_order", "path")).alias("path"))
