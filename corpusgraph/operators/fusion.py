"""Combining ranked result lists.

Every list is a top-k result (page sizes are at most 100), so windows and joins
here handle a few hundred rows whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import preview
from corpusgraph.operators.search import postings, query_terms, rank_documents
from corpusgraph.operators.vectors import best_chunks


def semantic(docs: DataFrame, points: DataFrame, vector: list[float], limit: int = 25, offset: int = 0,
             threshold: float | None = None, filtered: bool = False) -> DataFrame:
    """Documents by their best chunk, joined to metadata with a 300-character preview.

    ``docs`` carries the filters: with ``filtered`` the points are restricted to
    it before scoring, so no over-fetching is needed.
    """
    if filtered:
        points = points.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    top = best_chunks(points, vector, limit + offset, threshold).offset(offset).withColumnRenamed("document_id", "doc_id")
    shown = [c for c in docs.columns if c not in ("text", "extracted_text", "metadata")]
    return (
        docs.join(F.broadcast(top), "doc_id")
        .select(*shown, "score", preview(F.col("text"), 300).alias("snippet"))
        .orderBy(F.desc("score"), "doc_id")
    )


def _ranked(hits: DataFrame, name: str) -> DataFrame:
    """1-based rank of a bounded result list."""
    order = Window.orderBy(F.desc("score"), "doc_id")
    return hits.select("doc_id", F.row_number().over(order).alias(name))


def reciprocal_rank_fusion(left: DataFrame, right: DataFrame, k: int = 60) -> DataFrame:
    """Sum of 1/(k+rank) over two bounded lists of (doc_id, score)."""
    merged = _ranked(left, "left_rank").join(_ranked(right, "right_rank"), "doc_id", "full_outer")

    def part(rank: str):
        return F.coalesce(F.lit(1.0) / (k + F.col(rank)), F.lit(0.0))

    return merged.withColumn("score", F.round(part("left_rank") + part("right_rank"), 9))


def hybrid(docs: DataFrame, points: DataFrame, query: str, vector: list[float], limit: int = 25, offset: int = 0,
           k: int = 60, filtered: bool = False) -> DataFrame:
    """Full-text and semantic search fused by reciprocal rank.

    Each side contributes its best ``2·limit`` documents and the page is taken
    after fusion.
    """
    terms = query_terms(query)
    total = docs.agg(F.count("*").alias("n")).scalar()
    words = rank_documents(postings(docs, terms), terms, total).orderBy(F.desc("score"), "doc_id").limit(2 * limit)
    if filtered:
        points = points.join(docs.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    meaning = best_chunks(points, vector, 2 * limit).select(F.col("document_id").alias("doc_id"), "score")
    fused = reciprocal_rank_fusion(words, meaning, k).orderBy(F.desc("score"), "doc_id").offset(offset).limit(limit)
    shown = [c for c in docs.columns if c not in ("text", "extracted_text", "metadata")]
    return docs.select(*shown).join(F.broadcast(fused), "doc_id").orderBy(F.desc("score"), "doc_id")


def first_seen(lists: list[tuple[str, DataFrame]], limit: int | None = None) -> DataFrame:
    """Merge bounded lists of (doc_id, score) by priority; a document keeps its first list."""
    merged = None
    for priority, (name, hits) in enumerate(lists):
        part = hits.select("doc_id", "score", F.lit(name).alias("search_type"), F.lit(priority).alias("priority"))
        merged = part if merged is None else merged.unionByName(part)
    kept = merged.groupBy("doc_id").agg(F.min_by(F.struct("priority", "search_type", "score"), "priority").alias("h"))
    rows = kept.select("doc_id", "h.*").orderBy("priority", F.desc("score"), "doc_id")
    return rows.limit(limit) if limit else rows


def merge_step_results(steps: list[DataFrame]) -> DataFrame:
    """Union of step outputs with any columns, first step wins per document."""
    merged = None
    for i, step in enumerate(steps):
        part = step.withColumn("step", F.lit(i))
        merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    rest = [c for c in merged.columns if c != "doc_id"]
    kept = merged.groupBy("doc_id").agg(F.min_by(F.struct(*rest), "step").alias("r"))
    return kept.select("doc_id", "r.*")


def with_entities(results: DataFrame, mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Attach each result's entities, most mentioned first, as an array of structs."""
    hits = mentions.join(results.select("doc_id").distinct(), "doc_id", "left_semi")
    named = hits.join(entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type"), "entity_id")
    badge = F.struct((-F.col("mention_count")).alias("order"), "canonical_name", "entity_type", "entity_id")
    listed = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(badge)).alias("_b"))
    badges = F.transform("_b", lambda b: F.struct(b["entity_id"].alias("id"), b["canonical_name"].alias("name"), b["entity_type"].alias("type")))
    empty = F.array().cast("array<struct<id:bigint,name:string,type:string>>")
    return results.join(listed.select("doc_id", badges.alias("entities")), "doc_id", "left").withColumn(
        "entities", F.coalesce("entities", empty)
    )
