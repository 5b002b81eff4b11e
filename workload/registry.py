"""Where each query and the SQL it must agree with are recorded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.session import scratch_path
from corpusgraph.sources.files import widen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is left out where SQL cannot express the operator."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


_STORED: dict[tuple[str, str, str], str] = {}


def stored_once(spark: SparkSession, sf: str, name: str, write: Callable[[str], None]) -> str:
    """The path of what ``write(path)`` derived from the tables, written once per application and folder of tables.

    Indexes, adjacency and projections that several queries read.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write(path)
        _STORED[key] = path
    return _STORED[key]


def scored_query(name: str, sql: str):
    """A query whose score is shown to six places; it was ranked on twelve."""
    def wrap(fn):
        def shown(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).withColumn("score", F.round("score", 6))

        query(name, f"SELECT * REPLACE (round(score, 6) AS score) FROM ({sql}) shown")(shown)
        return fn

    return wrap


# Text is expensive per row; a small table in one split would be one task's work.
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given parquet tables."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return widen(rows, TEXT_KEYS[name]) if name in TEXT_KEYS else rows
