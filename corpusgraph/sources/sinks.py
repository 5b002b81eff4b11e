"""Exports and idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.functions.markup import strip_tags
from corpusgraph.sources.keyed import KeyedTable

BOM = "﻿"


def export_rows(results: DataFrame, limit: int | None = None) -> DataFrame:
    """Search results as flat export rows, best first; the first ``limit`` if given.

    ``results`` has filename, source, doc_type, date, score, snippet and an
    ``entities`` array of structs with a name.
    """
    top = results.orderBy(F.desc("score"), "filename")
    top = top if limit is None else top.limit(limit)
    return top.select(
        "filename", "source", F.coalesce("doc_type", F.lit("")).alias("doc_type"),
        F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), "score",
        strip_tags(F.col("snippet")).alias("snippet"),
        F.array_join(F.transform("entities", lambda e: e["name"]), "; ").alias("entities"),
    )


def export_csv(results: DataFrame, path: str, limit: int | None = None) -> None:
    """Write the export as CSV with header: one file for a limited page, else a file per task."""
    rows = export_rows(results, limit)
    first, *rest = rows.columns
    # The byte-order mark in front of the first header name makes spreadsheets read UTF-8.
    named = rows.withColumnRenamed(first, BOM + first)
    (named if limit is None else named.coalesce(1)).write.mode("overwrite").csv(
        path, header=True, quote='"', escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )


def export_json(results: DataFrame, path: str) -> None:
    """Write rows as JSON lines."""
    results.write.mode("overwrite").json(path)


def merge_points(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert on ``point_id``: incoming rows replace stored ones, the latest ``indexed_at`` wins."""
    old = existing.withColumn("_incoming", F.lit(0))
    new = incoming.withColumn("_incoming", F.lit(1))
    both = old.unionByName(new)
    rest = [c for c in existing.columns if c != "point_id"]
    kept = both.groupBy("point_id").agg(F.max_by(F.struct(*rest), F.struct("_incoming", "indexed_at")).alias("r"))
    return kept.select("point_id", "r.*")


def write_points(spark: SparkSession, incoming: DataFrame, path: str) -> None:
    """Upsert points into a keyed table; running it twice changes nothing. Only the buckets of incoming keys are rewritten."""
    KeyedTable(spark, path, "point_id").upsert(incoming, merge_points)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return KeyedTable(spark, path).read()


def new_graph_rows(nodes: DataFrame, edges: DataFrame, old_nodes: DataFrame, old_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (unique by label and name) and edges (by src, dst, type) not yet stored."""
    fresh_nodes = nodes.dropDuplicates(["label", "name"]).join(old_nodes.select("label", "name"), ["label", "name"], "left_anti")
    fresh_edges = edges.dropDuplicates(["src", "dst", "type"]).join(
        old_edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti"
    )
    return fresh_nodes, fresh_edges


def write_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Append the nodes and edges that are not stored yet."""
    node_path, edge_path = f"{path}/nodes", f"{path}/edges"
    old_nodes = spark.read.parquet(node_path) if _exists(spark, node_path) else nodes.limit(0)
    old_edges = spark.read.parquet(edge_path) if _exists(spark, edge_path) else edges.limit(0)
    fresh_nodes, fresh_edges = new_graph_rows(nodes, edges, old_nodes, old_edges)
    fresh_nodes.select(*nodes.columns).write.mode("append").parquet(node_path)
    fresh_edges.select(*edges.columns).write.mode("append").parquet(edge_path)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
