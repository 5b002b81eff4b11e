"""The logical tables of the library, derived from the given parquet tables.

Each derivation is written once in the SQL that Spark and DuckDB share, so the
query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload.registry import table

STATUS = """CASE doc_id % 6 WHEN 0 THEN 'completed' WHEN 1 THEN 'pending' WHEN 2 THEN 'processing'
 WHEN 3 THEN 'needs_ocr' WHEN 4 THEN 'error' ELSE 'failed' END"""

DOC_COLUMNS = {
    "doc_id": "doc_id",
    "filename": "concat('doc_', doc_id, '.pdf')",
    "source": "source",
    "doc_type": "lang",
    "file_size_bytes": "CASE WHEN doc_id % 40 = 1 THEN 0 ELSE n_chars END",
    "page_count": "CAST(floor(n_chars / 2000) AS INT)",
    "content_hash": "md5(text)",
    "object_key": "CASE WHEN doc_id % 10 <> 0 THEN concat(source, '/', substr(md5(text), 1, 4), '/doc_', doc_id, '.pdf') END",
    "embedding_status": STATUS,
    "created_at": "timestamp '2024-01-01 00:00:00' + doc_id * interval '7' minute",
    "processed_at": "CASE WHEN doc_id % 6 IN (0, 2, 4) THEN timestamp '2024-01-01 05:00:00' + doc_id * interval '7' minute END",
    "text": "CASE WHEN length(trim(text)) >= 50 AND doc_id % 8 <> 3 THEN text END",
    "extracted_text": "CASE WHEN doc_id % 8 IN (3, 4) THEN text END",
}

META_COLUMNS = {
    "needs_ocr": "CASE WHEN length(trim(text)) < 50 OR doc_id % 8 = 3 THEN 'true' END",
    "extraction_error": "CASE WHEN doc_id % 17 = 3 THEN concat('code ', doc_id % 4) END",
    "file_not_found": "CASE WHEN doc_id % 19 = 4 THEN 'true' END",
    "has_photos": "CASE WHEN doc_id % 7 = 0 THEN 'true' END",
    "store_verified": "CASE WHEN doc_id % 5 = 0 THEN 'true' END",
    "embedding_v2": "CASE WHEN doc_id % 3 = 0 THEN 'completed' END",
    "embedding_v2_error": "CASE WHEN doc_id % 11 = 5 THEN concat('batch ', doc_id % 3) END",
    "embedding_v2_started": "CASE WHEN doc_id % 4 = 0 THEN concat('2024-01-0', 1 + doc_id % 9, ' 00:00:00') END",
    "embed_worker_id": "CASE WHEN doc_id % 4 = 0 THEN concat('w', doc_id % 8) END",
    "chunk_count_v2": "CASE WHEN doc_id % 3 = 0 THEN CAST(1 + doc_id % 5 AS VARCHAR(9)) END",
    "entities_extracted": "CASE WHEN doc_id % 2 = 0 THEN 'true' END",
    "entities_error": "CASE WHEN doc_id % 13 = 6 THEN 'timeout' END",
    "content_classification": "CASE WHEN doc_id % 5 = 2 THEN lang END",
    "classification_status": "CASE WHEN doc_id % 5 = 3 THEN 'processing' END",
    "vlm_status": "CASE doc_id % 9 WHEN 0 THEN 'complete' WHEN 1 THEN 'completed' WHEN 2 THEN 'processing' END",
    "vlm_embedded": "CASE WHEN doc_id % 18 = 0 THEN 'true' END",
}

# For DuckDB: metadata keys appear as plain columns named m_<key>.
DOCS = "docs AS (SELECT {} FROM documents)".format(
    ", ".join(
        [f"{e} AS {c}" for c, e in DOC_COLUMNS.items()] + [f"{e} AS m_{c}" for c, e in META_COLUMNS.items()]
    )
)


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """The ``documents`` table with statuses and metadata."""
    raw = table(spark, sf, "documents")
    cols = [F.expr(e).alias(c) for c, e in DOC_COLUMNS.items()]
    pairs = [F.struct(F.lit(k).alias("key"), F.expr(e).alias("value")) for k, e in META_COLUMNS.items()]
    metadata = F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))
    return raw.select(*cols, metadata.alias("metadata"))


# Object listing: the keys whose content hash starts with 1-f, and every page as an orphan.
LISTING = """listing AS (
 SELECT concat(source, '/', substr(md5(text), 1, 4), '/doc_', doc_id, '.pdf') AS key, n_chars AS size
 FROM documents WHERE md5(text) >= '1'
 UNION ALL SELECT concat('pages/', page_id, '/page_', page_id, '.html') AS key, length(html) AS size FROM pages)"""


def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Stored objects as (key, size)."""
    stored = table(spark, sf, "documents").where("md5(text) >= '1'").selectExpr(
        "concat(source, '/', substr(md5(text), 1, 4), '/doc_', doc_id, '.pdf') AS key", "n_chars AS size"
    )
    orphans = table(spark, sf, "pages").selectExpr(
        "concat('pages/', page_id, '/page_', page_id, '.html') AS key", "CAST(length(html) AS BIGINT) AS size"
    )
    return stored.unionByName(orphans)
