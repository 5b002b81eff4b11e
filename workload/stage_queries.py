"""Work queues, repairs and status reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import stages
from workload.registry import query, table
from workload.standins import DOCS, docs

AS_OF = "timestamp '2024-01-06 00:00:00'"
PRIORITY = ["src7", "src3", "src11", "src0", "src19"]
PICK = "doc_id, filename, source"

QUEUES = {
    "text": (
        dict(sources=PRIORITY),
        "text IS NULL AND m_needs_ocr IS NULL AND m_extraction_error IS NULL AND m_file_not_found IS NULL AND source IN ('src7','src3','src11','src0','src19')",
        "CASE source WHEN 'src7' THEN 0 WHEN 'src3' THEN 1 WHEN 'src11' THEN 2 WHEN 'src0' THEN 3 WHEN 'src19' THEN 4 END, created_at, doc_id",
    ),
    "text_by_size": (
        {},
        "embedding_status = 'pending' AND object_key IS NOT NULL AND file_size_bytes > 0 AND file_size_bytes < 20000000",
        "file_size_bytes, doc_id",
    ),
    "embed": (
        {},
        "length(text) > 100 AND m_embedding_v2 IS NULL AND m_embedding_v2_error IS NULL AND m_embedding_v2_started IS NULL",
        "created_at, doc_id",
    ),
    "entities": (
        {},
        "(length(text) > 100 OR length(extracted_text) > 100) AND m_entities_extracted IS NULL AND m_entities_error IS NULL",
        "doc_id",
    ),
    "classify": (
        {},
        "text IS NOT NULL AND m_content_classification IS NULL AND coalesce(m_classification_status, '') <> 'processing'",
        "doc_id",
    ),
    "upload": (
        dict(sources=PRIORITY),
        "(object_key IS NULL OR m_store_verified IS NULL) AND m_file_not_found IS NULL",
        "CASE WHEN source IN ('src7','src3','src11','src0','src19') THEN 0 ELSE 1 END, created_at, doc_id",
    ),
    "size_range": (
        dict(min_size=500, max_size=5000, seed=7),
        "embedding_status = 'pending' AND object_key IS NOT NULL AND file_size_bytes BETWEEN 500 AND 5000",
        "md5(doc_id || '_7')",
    ),
    "by_prefix": (
        dict(prefixes=["src1/", "src2/"]),
        "embedding_status = 'pending' AND (object_key LIKE 'src1/%' OR object_key LIKE 'src2/%')",
        "created_at, doc_id",
    ),
    "ocr": (
        {},
        "m_needs_ocr = 'true' AND coalesce(m_vlm_status, '') NOT IN ('processing', 'complete', 'completed')",
        "source, filename",
    ),
    "vlm_embed": (
        {},
        "m_vlm_status IN ('complete', 'completed') AND m_vlm_embedded IS NULL",
        "processed_at DESC NULLS LAST, doc_id",
    ),
}


def _queue(stage, opt, where, order):
    @query(f"eligible_{stage}", f"WITH {DOCS} SELECT {PICK} FROM docs WHERE {where} ORDER BY {order} LIMIT 25")
    def run(spark, sf):
        return stages.eligible_batch(docs(spark, sf), stage, 25, **opt).select(*PICK.split(", "))


for _stage, (_opt, _where, _order) in QUEUES.items():
    _queue(_stage, _opt, _where, _order)


@query(
    "reset_stuck",
    f"""WITH {DOCS} SELECT doc_id,
 CASE WHEN embedding_status = 'processing' AND processed_at < {AS_OF} - interval '30' minute THEN 'pending' ELSE embedding_status END AS embedding_status,
 CASE WHEN m_embedding_v2 IS NULL AND CAST(m_embedding_v2_started AS TIMESTAMP) < {AS_OF} - interval '30' minute THEN NULL ELSE m_embed_worker_id END AS worker
 FROM docs""",
)
def reset_stuck(spark, sf):
    d = stages.reset_stuck(docs(spark, sf), F.expr(AS_OF))
    return d.select("doc_id", "embedding_status", d["metadata"]["embed_worker_id"].alias("worker"))


@query(
    "settle_edge_cases",
    f"""WITH {DOCS} SELECT doc_id, CASE WHEN embedding_status = 'pending' AND (file_size_bytes = 0 OR object_key IS NULL)
 THEN 'completed' ELSE embedding_status END AS embedding_status FROM docs""",
)
def settle_edge_cases(spark, sf):
    return stages.settle_edge_cases(docs(spark, sf)).select("doc_id", "embedding_status")


@query(
    "too_large",
    f"WITH {DOCS} SELECT count(*) AS files, avg(file_size_bytes) AS avg_bytes FROM docs WHERE file_size_bytes > 3000 AND embedding_status = 'pending'",
)
def too_large(spark, sf):
    return stages.too_large(docs(spark, sf), 3000)


@query(
    "retry_failed_embeddings",
    f"WITH {DOCS} SELECT doc_id, CAST(NULL AS VARCHAR) AS error, m_embedding_v2 AS embedding_v2 FROM docs",
)
def retry_failed_embeddings(spark, sf):
    d = stages.retry_failed_embeddings(docs(spark, sf))
    return d.select("doc_id", d["metadata"]["embedding_v2_error"].alias("error"), d["metadata"]["embedding_v2"].alias("embedding_v2"))


COUNTERS = {
    "has_text": "text IS NOT NULL",
    "needs_ocr": "m_needs_ocr = 'true'",
    "errors": "m_extraction_error IS NOT NULL",
    "not_found": "m_file_not_found = 'true'",
    "has_photos": "m_has_photos = 'true'",
    "with_key": "object_key IS NOT NULL",
    "missing_key": "object_key IS NULL",
    "completed": "embedding_status = 'completed'",
    "pending": "embedding_status = 'pending'",
    "in_progress": "embedding_status = 'processing'",
    "failed": "embedding_status IN ('failed', 'error')",
    "embed_eligible": "length(text) > 100",
    "embedded": "m_embedding_v2 = 'completed'",
    "embed_errors": "m_embedding_v2_error IS NOT NULL",
    "embed_in_progress": "m_embedding_v2_started IS NOT NULL AND m_embedding_v2 IS NULL AND m_embedding_v2_error IS NULL",
    "entities_done": "m_entities_extracted = 'true'",
    "entity_errors": "m_entities_error IS NOT NULL",
    "entities_pending": "text IS NOT NULL AND m_entities_extracted IS NULL AND m_entities_error IS NULL",
    "classified": "m_content_classification IS NOT NULL",
    "vlm_complete": "m_vlm_status IN ('complete', 'completed')",
    "vlm_processing": "m_vlm_status = 'processing'",
    "vlm_remaining": "m_needs_ocr = 'true' AND (m_vlm_status IS NULL OR m_vlm_status NOT IN ('processing', 'complete', 'completed'))",
}
_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER ({p}) AS {n}" for n, p in COUNTERS.items())


@query("stage_counts", f"WITH {DOCS} SELECT {_COUNTS} FROM docs")
def stage_counts(spark, sf):
    return stages.stage_counts(docs(spark, sf))


@query("stage_counts_by_source", f"WITH {DOCS} SELECT source, {_COUNTS} FROM docs GROUP BY source")
def stage_counts_by_source(spark, sf):
    return stages.stage_counts(docs(spark, sf), by="source")


@query(
    "corpus_stats",
    f"""WITH {DOCS} SELECT count(*) AS total_documents, count(DISTINCT source) AS sources, CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes,
 CAST(sum(page_count) AS BIGINT) AS total_pages FROM docs""",
)
def corpus_stats(spark, sf):
    return stages.corpus_stats(docs(spark, sf))


@query(
    "corpus_stats_by_source",
    f"WITH {DOCS} SELECT source, count(*) AS documents, CAST(sum(file_size_bytes) AS BIGINT) AS bytes FROM docs GROUP BY 1 ORDER BY 2 DESC, 1",
)
def corpus_stats_by_source(spark, sf):
    return stages.corpus_stats_by_source(docs(spark, sf))


@query(
    "key_prefix_counts",
    f"""WITH {DOCS} SELECT CASE WHEN object_key IS NULL THEN 'NO_KEY' WHEN object_key LIKE 'src1%' THEN split_part(object_key, '/', 1)
 WHEN object_key LIKE 'src2/%' THEN 'src2/...' ELSE 'other' END AS prefix, count(*) AS count FROM docs GROUP BY 1""",
)
def key_prefix_counts(spark, sf):
    return stages.key_prefix_counts(docs(spark, sf), "src1", ["src2"])


@query(
    "status_share",
    f"""WITH {DOCS} SELECT embedding_status, count(*) AS count, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM docs), 1) AS pct FROM docs GROUP BY 1""",
)
def status_share(spark, sf):
    return stages.status_share(docs(spark, sf))


@query(
    "pct_complete",
    f"""WITH {DOCS} SELECT source, count(*) FILTER (m_embedding_v2 = 'completed') AS done, count(*) AS total,
 round(100.0::DOUBLE * count(*) FILTER (m_embedding_v2 = 'completed') / nullif(count(*), 0), 1) AS pct FROM docs GROUP BY 1""",
)
def pct_complete(spark, sf):
    return stages.pct_complete(docs(spark, sf), stages.meta("embedding_v2") == "completed", by="source")


@query(
    "throughput_hourly",
    "SELECT date_trunc('hour', ts) AS period, count(*) AS docs, CAST(sum(user_id) AS BIGINT) AS chunks, round(avg(value), 6) AS avg_seconds FROM events GROUP BY 1",
)
def throughput_hourly(spark, sf):
    return stages.throughput(table(spark, sf, "events"), "ts", "hour", "user_id", "value")


@query("throughput_minutely", "SELECT date_trunc('minute', ts) AS period, count(*) AS docs FROM events GROUP BY 1")
def throughput_minutely(spark, sf):
    return stages.throughput(table(spark, sf, "events"), "ts", "minute")


@query(
    "recent_activity",
    f"""WITH {DOCS} SELECT count(*) FILTER (processed_at > {AS_OF} - interval '24' hour) AS processed,
 count(*) FILTER (created_at > {AS_OF} - interval '24' hour) AS ingested FROM docs""",
)
def recent_activity(spark, sf):
    return stages.recent_activity(docs(spark, sf), F.expr(AS_OF))


@query(
    "source_span",
    f"WITH {DOCS} SELECT source, count(*) AS documents, min(created_at) AS first_seen, max(created_at) AS last_seen FROM docs GROUP BY 1",
)
def source_span(spark, sf):
    return stages.source_span(docs(spark, sf))


@query(
    "worker_performance",
    "SELECT user_id AS worker, count(*) AS docs, round(avg(value), 6) AS avg_chunks, max(ts) AS last_activity FROM events WHERE event_type = 'purchase' GROUP BY 1",
)
def worker_performance(spark, sf):
    done = table(spark, sf, "events").where("event_type = 'purchase'")
    return stages.worker_performance(done, "user_id", "value", "ts")


@query(
    "stalled_workers",
    "SELECT user_id AS worker, count(*) AS stalled, min(ts) AS oldest_start FROM events WHERE event_type = 'click' AND ts < timestamp '2024-01-31 00:00:00' - interval '10' minute GROUP BY 1",
)
def stalled_workers(spark, sf):
    claims = table(spark, sf, "events").where("event_type = 'click'")
    return stages.stalled_workers(claims, "user_id", "ts", F.expr("timestamp '2024-01-31 00:00:00'"))


@query(
    "error_histogram",
    f"WITH {DOCS} SELECT m_extraction_error AS error, count(*) AS count FROM docs WHERE m_extraction_error IS NOT NULL GROUP BY 1",
)
def error_histogram(spark, sf):
    return stages.error_histogram(docs(spark, sf), stages.meta("extraction_error"))


@query(
    "field_frequency",
    f"WITH {DOCS} SELECT m_embed_worker_id AS value, count(*) AS count FROM docs WHERE m_embed_worker_id IS NOT NULL GROUP BY 1",
)
def field_frequency(spark, sf):
    return stages.field_frequency(docs(spark, sf), "embed_worker_id")


JOB_STATE = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'completed' END"


@query(
    "job_status",
    f"""SELECT count(*) AS total, count(*) FILTER (s = 'pending') AS pending, count(*) FILTER (s = 'processing') AS processing,
 count(*) FILTER (s = 'completed') AS completed, count(*) FILTER (s = 'failed') AS failed FROM (SELECT {JOB_STATE} AS s FROM events) q""",
)
def job_status(spark, sf):
    return stages.job_status(table(spark, sf, "events").select(F.expr(JOB_STATE).alias("status")))


@query("status_histogram", f"WITH {DOCS} SELECT embedding_status, count(*) AS count FROM docs GROUP BY 1")
def status_histogram(spark, sf):
    return stages.status_histogram(docs(spark, sf))


@query(
    "stuck_documents",
    f"""WITH {DOCS} SELECT doc_id, filename, source, file_size_bytes, processed_at,
 CAST(epoch({AS_OF}) - epoch(processed_at) AS BIGINT) AS stuck_seconds FROM docs
 WHERE embedding_status = 'processing' AND processed_at < {AS_OF} - interval '10' minute""",
)
def stuck_documents(spark, sf):
    return stages.stuck_documents(docs(spark, sf), F.expr(AS_OF))
