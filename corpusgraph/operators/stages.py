"""Stage bookkeeping over the ``documents`` table: eligibility, repair, counts.

``documents`` holds its text in the columns ``text`` and ``extracted_text`` so
that status queries never read it, and small facts in a string map
``metadata``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def meta(key: str) -> Column:
    """One metadata value as text, null when absent."""
    return F.col("metadata")[key]


def _absent(*keys: str) -> Column:
    cond = F.lit(True)
    for key in keys:
        cond = cond & meta(key).isNull()
    return cond


def _is_pdf() -> Column:
    return F.col("filename").endswith(".pdf")


def _priority(sources: list[str]) -> Column:
    """Position of the source in a priority list; unlisted sources come last."""
    rank = F.array_position(F.array(*[F.lit(s) for s in sources]), F.col("source"))
    return F.when(rank == 0, len(sources) + 1).otherwise(rank)



def stage_rule(stage: str, **opt) -> tuple[Column, list[Column]]:
    """The predicate and the order of one work queue."""
    pending = (F.col("embedding_status") == "pending") & F.col("object_key").isNotNull()
    oldest = [F.col("created_at").asc(), F.col("doc_id").asc()]
    if stage == "text":
        sources = opt.get("sources", [])
        cond = _is_pdf() & F.col("text").isNull() & _absent("needs_ocr", "extraction_error", "file_not_found")
        if sources:
            cond = cond & F.col("source").isin(sources)
            return cond, [_priority(sources).asc(), *oldest]
        return cond, oldest
    if stage == "text_by_size":
        size = F.col("file_size_bytes")
        cond = pending & (size > 0)
        if "max_size" in opt:
            cond = cond & (size < opt["max_size"])
        return cond, [size.asc(), F.col("doc_id").asc()]
    if stage == "embed":
        cond = (F.length("text") > 100) & _absent("embedding_v2", "embedding_v2_error", "embedding_v2_started")
        return cond, oldest
    if stage == "entities":
        cond = ((F.length("text") > 100) | (F.length("extracted_text") > 100)) & _absent("entities_extracted", "entities_error")
        return cond, [F.col("doc_id").asc()]
    if stage == "classify":
        busy = F.coalesce(meta("classification_status"), F.lit("")) == "processing"
        return F.col("text").isNotNull() & _absent("content_classification") & ~busy, [F.col("doc_id").asc()]
    if stage == "upload":
        unset = F.coalesce("object_key", F.lit("")) == ""
        cond = _is_pdf() & (unset | meta("store_verified").isNull()) & _absent("file_not_found", "store_upload_error")
        first = F.when(F.col("source").isin(opt.get("sources", [])), 0).otherwise(1)
        return cond, [first.asc(), *oldest]
    if stage == "size_range":
        cond = pending & (F.col("file_size_bytes") >= opt.get("min_size", 0))
        if "max_size" in opt:
            cond = cond & (F.col("file_size_bytes") <= opt["max_size"])
        if opt.get("source"):
            cond = cond & (F.col("source") == opt["source"])
        # The queue is drawn at random; a keyed hash makes the draw repeatable.
        draw = F.md5(F.concat_ws("_", F.col("doc_id").cast("string"), F.lit(str(opt.get("seed", 0)))))
        return cond, [draw.asc()]
    if stage == "by_prefix":
        cond = F.lit(False)
        for prefix in opt.get("prefixes", []):
            cond = cond | F.col("object_key").startswith(prefix)
        return pending & cond, oldest
    if stage == "ocr":
        vlm = F.coalesce(meta("vlm_status"), F.lit(""))
        return (meta("needs_ocr") == "true") & ~vlm.isin("processing", "complete", "completed"), [
            F.col("source").asc(), F.col("filename").asc(),
        ]
    if stage == "vlm_embed":
        cond = meta("vlm_status").isin("complete", "completed") & _absent("vlm_embedded")
        return cond, [F.col("processed_at").desc_nulls_last(), F.col("doc_id").asc()]
    raise ValueError(f"unknown stage {stage!r}")


def eligible_batch(docs: DataFrame, stage: str, limit: int, **opt) -> DataFrame:
    """The next ``limit`` documents of a stage; a top-k, never a full sort."""
    cond, order = stage_rule(stage, **opt)
    return docs.where(cond).orderBy(*order).limit(limit)


def reset_stuck(docs: DataFrame, as_of: Column, minutes: int = 30) -> DataFrame:
    """Rows processing for longer than ``minutes`` go back to pending; stale claims are cleared."""
    age = F.make_dt_interval(mins=F.lit(minutes))
    stuck = (F.col("embedding_status") == "processing") & (F.col("processed_at") < as_of - age)
    started = F.try_to_timestamp(meta("embedding_v2_started"))
    stale = meta("embedding_v2").isNull() & (started < as_of - age)
    cleared = F.map_filter("metadata", lambda k, _: ~k.isin("embedding_v2_started", "embed_worker_id"))
    return docs.withColumn(
        "embedding_status", F.when(stuck, "pending").otherwise(F.col("embedding_status"))
    ).withColumn("metadata", F.when(stale, cleared).otherwise(F.col("metadata")))


def settle_edge_cases(docs: DataFrame) -> DataFrame:
    """Pending rows that are empty or have no stored object are completed."""
    hopeless = (F.col("embedding_status") == "pending") & (
        (F.col("file_size_bytes") == 0) | F.col("object_key").isNull()
    )
    return docs.withColumn("embedding_status", F.when(hopeless, "completed").otherwise(F.col("embedding_status")))


def too_large(docs: DataFrame, limit: int = 20_000_000) -> DataFrame:
    """Count and mean size of pending files above the size limit."""
    rows = docs.where((F.col("file_size_bytes") > limit) & (F.col("embedding_status") == "pending"))
    return rows.agg(F.count("*").alias("files"), F.avg("file_size_bytes").alias("avg_bytes"))


def retry_failed_embeddings(docs: DataFrame) -> DataFrame:
    """Clear embedding errors so that the rows are picked up again."""
    cleared = F.map_filter("metadata", lambda k, _: k != "embedding_v2_error")
    return docs.withColumn("metadata", cleared)


def stage_predicates() -> dict[str, Column]:
    """Name → condition for every counter the status pages show."""
    status = F.col("embedding_status")
    vlm = meta("vlm_status")
    done = vlm.isin("complete", "completed")
    ocr = meta("needs_ocr") == "true"
    return {
        "has_text": F.col("text").isNotNull(),
        "needs_ocr": ocr,
        "errors": meta("extraction_error").isNotNull(),
        "not_found": meta("file_not_found") == "true",
        "has_photos": meta("has_photos") == "true",
        "with_key": F.col("object_key").isNotNull(),
        "missing_key": F.col("object_key").isNull(),
        "completed": status == "completed",
        "pending": status == "pending",
        "in_progress": status == "processing",
        "failed": status.isin("failed", "error"),
        "embed_eligible": F.length("text") > 100,
        "embedded": meta("embedding_v2") == "completed",
        "embed_errors": meta("embedding_v2_error").isNotNull(),
        "embed_in_progress": meta("embedding_v2_started").isNotNull() & _absent("embedding_v2", "embedding_v2_error"),
        "entities_done": meta("entities_extracted") == "true",
        "entity_errors": meta("entities_error").isNotNull(),
        "entities_pending": F.col("text").isNotNull() & _absent("entities_extracted", "entities_error"),
        "classified": meta("content_classification").isNotNull(),
        "vlm_complete": done,
        "vlm_processing": vlm == "processing",
        "vlm_remaining": ocr & (vlm.isNull() | ~vlm.isin("processing", "complete", "completed")),
    }


def stage_counts(docs: DataFrame, by: str | None = None, predicates: Mapping[str, Column] | None = None) -> DataFrame:
    """All counters in one scan, optionally per group."""
    aggs = [F.count("*").alias("total")]
    aggs += [F.count_if(p).alias(n) for n, p in (predicates or stage_predicates()).items()]
    return docs.groupBy(by).agg(*aggs) if by else docs.agg(*aggs)


def corpus_stats(docs: DataFrame) -> DataFrame:
    """Documents, distinct sources, bytes and pages."""
    return docs.agg(
        F.count("*").alias("total_documents"),
        F.countDistinct("source").alias("sources"),
        F.sum("file_size_bytes").alias("total_bytes"),
        F.sum("page_count").cast("bigint").alias("total_pages"),
    )


def corpus_stats_by_source(docs: DataFrame) -> DataFrame:
    """The same per source, largest first."""
    return (
        docs.groupBy("source")
        .agg(F.count("*").alias("documents"), F.sum("file_size_bytes").alias("bytes"))
        .orderBy(F.desc("documents"), "source")
    )


def key_prefix_counts(docs: DataFrame, split_prefix: str, named: list[str]) -> DataFrame:
    """Documents per storage-key prefix.

    Keys starting with ``split_prefix`` fall in a bucket per first segment, the
    ``named`` folders in one bucket each, the rest in ``other``; missing keys
    are counted too.
    """
    key = F.col("object_key")
    bucket = F.when(key.isNull(), "NO_KEY").when(key.startswith(split_prefix), F.substring_index(key, "/", 1))
    for folder in named:
        bucket = bucket.when(key.startswith(f"{folder}/"), f"{folder}/...")
    return docs.groupBy(bucket.otherwise("other").alias("prefix")).agg(F.count("*").alias("count"))


def status_share(docs: DataFrame, column: str = "embedding_status") -> DataFrame:
    """Count and percentage of the total per value."""
    counts = docs.groupBy(column).agg(F.count("*").alias("count"))
    total = docs.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("pct", F.round(F.lit(100.0) * F.col("count") / total, 1))


def pct_complete(docs: DataFrame, done: Column, by: str | None = None, digits: int = 1) -> DataFrame:
    """Done, total and null-safe percentage."""
    grouped = docs.groupBy(by) if by else docs.groupBy()
    counted = grouped.agg(F.count_if(done).alias("done"), F.count("*").alias("total"))
    return counted.withColumn("pct", F.round(F.lit(100.0) * F.col("done") / F.nullif(F.col("total"), F.lit(0)), digits))


def throughput(rows: DataFrame, ts: str, unit: str, chunks: str | None = None, seconds: str | None = None) -> DataFrame:
    """Rows per minute or hour with optional chunk sums and mean durations."""
    aggs = [F.count("*").alias("docs")]
    if chunks:
        aggs.append(F.sum(chunks).cast("bigint").alias("chunks"))
    if seconds:
        aggs.append(F.round(F.avg(seconds), 6).alias("avg_seconds"))
    return rows.where(F.col(ts).isNotNull()).groupBy(F.date_trunc(unit, ts).alias("period")).agg(*aggs)


def recent_activity(docs: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """How much was processed and ingested in the last hours."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    return docs.agg(
        F.count_if(F.col("processed_at") > since).alias("processed"),
        F.count_if(F.col("created_at") > since).alias("ingested"),
    )


def source_span(docs: DataFrame) -> DataFrame:
    """First and last ingestion per source."""
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen")
    )


def worker_performance(rows: DataFrame, worker: str, chunks: str, ts: str) -> DataFrame:
    """Documents, mean chunks and last activity per worker."""
    return rows.groupBy(F.col(worker).alias("worker")).agg(
        F.count("*").alias("docs"), F.round(F.avg(chunks), 6).alias("avg_chunks"), F.max(ts).alias("last_activity")
    )


def stalled_workers(rows: DataFrame, worker: str, started: str, as_of: Column, minutes: int = 10) -> DataFrame:
    """Workers holding claims older than ``minutes``, with the oldest one."""
    limit = as_of - F.make_dt_interval(mins=F.lit(minutes))
    return (
        rows.where(F.col(started) < limit)
        .groupBy(F.col(worker).alias("worker"))
        .agg(F.count("*").alias("stalled"), F.min(started).alias("oldest_start"))
    )


def _first(ranked: DataFrame, k: int | None) -> DataFrame:
    return ranked if k is None else ranked.limit(k)


def error_histogram(rows: DataFrame, error: Column, k: int | None = None) -> DataFrame:
    """Error texts by frequency, the first ``k`` if given."""
    counts = rows.where(error.isNotNull()).groupBy(error.alias("error")).agg(F.count("*").alias("count"))
    return _first(counts.orderBy(F.desc("count"), "error"), k)


def field_frequency(docs: DataFrame, field: str, k: int | None = None) -> DataFrame:
    """Values of one metadata key by frequency, the first ``k`` if given."""
    value = meta(field)
    counts = docs.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count("*").alias("count"))
    return _first(counts.orderBy(F.desc("count"), "value"), k)


def job_status(jobs: DataFrame, column: str = "status") -> DataFrame:
    """Jobs by state in one row."""
    states = ("pending", "processing", "completed", "failed")
    return jobs.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == s).alias(s) for s in states])


def status_histogram(docs: DataFrame, column: str = "embedding_status") -> DataFrame:
    """Rows per status."""
    return docs.groupBy(column).agg(F.count("*").alias("count"))


def stuck_documents(docs: DataFrame, as_of: Column, minutes: int = 10, k: int | None = None) -> DataFrame:
    """Documents in process for too long and how long they have been at it, longest first, the first ``k`` if given."""
    limit = as_of - F.make_dt_interval(mins=F.lit(minutes))
    age = F.unix_seconds(as_of) - F.unix_seconds("processed_at")
    stuck = docs.where((F.col("embedding_status") == "processing") & (F.col("processed_at") < limit))
    shown = stuck.select("doc_id", "filename", "source", "file_size_bytes", "processed_at", age.alias("stuck_seconds"))
    return _first(shown.orderBy("processed_at", "doc_id"), k)
