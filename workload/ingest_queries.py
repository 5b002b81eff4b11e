"""Registration, deduplication and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions import text as tx
from corpusgraph.operators import ingest
from workload.registry import query, table
from workload.standins import DOCS, LISTING, docs, listing


@query("content_hash", "SELECT doc_id, md5(text) AS content_hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


@query(
    "import_documents",
    f"""WITH {DOCS},
 old AS (SELECT content_hash, min(doc_id) AS known FROM docs WHERE source < 'src15' GROUP BY 1),
 batch AS (SELECT *, min(doc_id) OVER (PARTITION BY content_hash) AS first FROM docs WHERE source >= 'src15')
 SELECT doc_id, b.content_hash, coalesce(known, first) AS kept_id,
  CASE WHEN known IS NULL AND first = doc_id THEN 'inserted' ELSE 'duplicate' END AS status
 FROM batch b LEFT JOIN old o ON b.content_hash = o.content_hash""",
)
def import_documents(spark, sf):
    d = docs(spark, sf).select("doc_id", "content_hash", "source")
    out = ingest.import_documents(d.where("source >= 'src15'"), d.where("source < 'src15'"))
    return out.select("doc_id", "content_hash", "kept_id", "status")


@query(
    "exact_duplicates",
    """SELECT doc_id, md5(text) AS content_hash, min(doc_id) OVER (PARTITION BY md5(text)) AS kept_id,
 CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY md5(text)) THEN 'inserted' ELSE 'duplicate' END AS status FROM documents""",
)
def exact_duplicates(spark, sf):
    d = docs(spark, sf).select("doc_id", "content_hash")
    return ingest.import_documents(d, d.limit(0))


@query(
    "doc_type_of",
    """SELECT page_id, ext,
 CASE WHEN ext IN ('pdf') THEN 'Court Filing' WHEN ext IN ('jpg','jpeg','png','gif','bmp','tif','tiff') THEN 'Image'
  WHEN ext IN ('mp4','mov','m4v','3gp') THEN 'Video' WHEN ext IN ('m4a','opus','wav','mp3','amr') THEN 'Audio' ELSE 'Document' END AS doc_type,
 CASE WHEN ext IN ('jpg','jpeg','png','gif','bmp','tif','tiff') THEN 'Image' WHEN ext = 'pdf' THEN 'PDF'
  WHEN ext IN ('mp4','mov','m4v','3gp','m4a','opus','wav','mp3') THEN 'Media' ELSE 'Document' END AS coarse_type
 FROM (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'amr'
  WHEN 4 THEN 'mp3' WHEN 5 THEN 'tiff' ELSE 'html' END AS ext FROM pages) q""",
)
def doc_type_of(spark, sf):
    ext = F.expr(
        "CASE page_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'png' WHEN 2 THEN 'mp4' WHEN 3 THEN 'amr' "
        "WHEN 4 THEN 'mp3' WHEN 5 THEN 'tiff' ELSE 'html' END"
    )
    p = table(spark, sf, "pages").select("page_id", ext.alias("ext"))
    return p.select(
        "page_id", "ext", tx.doc_type_of(F.col("ext")).alias("doc_type"), tx.doc_type_of(F.col("ext"), coarse=True).alias("coarse_type")
    )


@query(
    "source_slug",
    "SELECT doc_id, lower(translate(text, ' ,.', '-')) AS slug FROM documents",
)
def source_slug(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.source_slug(F.col("text")).alias("slug"))


@query(
    "object_key",
    "SELECT doc_id, source || '/' || substr(md5(text), 1, 4) || '/doc_' || doc_id || '.pdf' AS object_key FROM documents",
)
def object_key(spark, sf):
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf, "documents").select(
        "doc_id", tx.object_key(F.col("source"), F.md5("text"), name).alias("object_key")
    )


@query(
    "upsert_documents",
    f"""WITH {DOCS}, {LISTING},
 incoming AS (SELECT split_part(key, '/', -1) AS filename, key, split_part(key, '/', 1) AS source, size FROM listing)
 SELECT coalesce(d.filename, i.filename) AS filename, coalesce(i.key, d.object_key) AS object_key,
  coalesce(d.source, i.source) AS source, CASE WHEN d.doc_id IS NULL THEN i.size ELSE d.file_size_bytes END AS file_size_bytes,
  CASE WHEN d.doc_id IS NULL THEN 'pending' WHEN i.key IS NOT NULL AND embedding_status = 'failed' THEN 'pending'
   ELSE embedding_status END AS embedding_status
 FROM docs d FULL OUTER JOIN incoming i ON d.filename = i.filename""",
)
def upsert_documents(spark, sf):
    old = docs(spark, sf).select("filename", "object_key", "source", "file_size_bytes", "embedding_status")
    new = listing(spark, sf).select(
        ingest.basename(F.col("key")).alias("filename"),
        F.col("key").alias("object_key"),
        F.substring_index("key", "/", 1).alias("source"),
        F.col("size").alias("file_size_bytes"),
    )
    return ingest.upsert_documents(old, new)


# Uploads under new names: every third document again, every fifth of them with its stored name, and new texts twice.
UPLOADS = """uploads AS (SELECT CASE WHEN doc_id % 5 = 0 THEN concat('doc_', doc_id, '.pdf') ELSE concat('new_', doc_id, '.pdf') END AS filename,
 concat('up/', doc_id) AS object_key, 'up' AS source, n_chars AS file_size_bytes, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE md5(concat(lang, doc_id % 50)) END AS content_hash
 FROM documents WHERE doc_id % 3 = 0 OR doc_id % 7 = 1)"""


@query(
    "upsert_by_hash",
    f"""WITH {DOCS}, {UPLOADS}, own AS (SELECT * FROM uploads WHERE filename IN (SELECT filename FROM docs)),
 one AS (SELECT content_hash, min(filename) AS filename, max_by(object_key, filename) AS object_key, min_by(file_size_bytes, filename) AS size FROM uploads
  WHERE filename NOT IN (SELECT filename FROM docs) GROUP BY 1),
 met AS (SELECT content_hash, min(filename) AS met FROM docs GROUP BY 1),
 moved AS (SELECT coalesce(met, filename) AS filename, object_key, size, content_hash, 0 AS own FROM one LEFT JOIN met USING (content_hash)
  UNION ALL SELECT filename, object_key, file_size_bytes, content_hash, 1 FROM own),
 i AS (SELECT * FROM moved QUALIFY row_number() OVER (PARTITION BY filename ORDER BY own DESC, object_key DESC) = 1)
 SELECT coalesce(d.filename, i.filename) AS filename, coalesce(i.object_key, d.object_key) AS object_key, coalesce(d.source, 'up') AS source,
  CASE WHEN d.filename IS NULL THEN i.size ELSE d.file_size_bytes END AS file_size_bytes, coalesce(d.content_hash, i.content_hash) AS content_hash,
  CASE WHEN d.filename IS NULL THEN 'pending' WHEN i.object_key IS NOT NULL AND embedding_status = 'failed' THEN 'pending' ELSE embedding_status END AS embedding_status
 FROM docs d FULL OUTER JOIN i ON d.filename = i.filename""",
)
def upsert_by_hash(spark, sf):
    old = docs(spark, sf).select("filename", "object_key", "source", "file_size_bytes", "content_hash", "embedding_status")
    i, name = F.col("doc_id"), lambda kind: F.concat(F.lit(kind), F.col("doc_id").cast("string"), F.lit(".pdf"))
    new = table(spark, sf, "documents").where((i % 3 == 0) | (i % 7 == 1)).select(
        F.when(i % 5 == 0, name("doc_")).otherwise(name("new_")).alias("filename"), F.concat(F.lit("up/"), i.cast("string")).alias("object_key"),
        F.lit("up").alias("source"), F.col("n_chars").alias("file_size_bytes"),
        F.when(i % 3 == 0, F.md5("text")).otherwise(F.md5(F.concat("lang", (i % 50).cast("string")))).alias("content_hash"),
    )
    return ingest.upsert_documents(old, new, other="content_hash")


@query(
    "missing_files",
    f"""WITH {DOCS}, {LISTING} SELECT key, size, split_part(key, '/', -1) AS filename FROM listing
 WHERE split_part(key, '/', -1) NOT IN (SELECT filename FROM docs)""",
)
def missing_files(spark, sf):
    return ingest.missing_files(listing(spark, sf), docs(spark, sf)).select("key", "size", "filename")


@query(
    "sync_keys",
    f"""WITH {DOCS}, {LISTING}, o AS (SELECT l.key,
  CASE WHEN bool_or(d.filename IS NOT NULL AND (d.object_key IS NULL OR d.object_key <> l.key)) THEN 'updated'
   WHEN bool_or(d.filename IS NOT NULL) THEN 'already_set' ELSE 'not_found' END AS outcome
  FROM listing l LEFT JOIN docs d ON split_part(l.key, '/', -1) = d.filename GROUP BY l.key)
 SELECT count(*) AS processed, count(*) FILTER (outcome = 'updated') AS updated,
  count(*) FILTER (outcome = 'already_set') AS already_set, count(*) FILTER (outcome = 'not_found') AS not_found FROM o""",
)
def sync_keys(spark, sf):
    return ingest.sync_keys(listing(spark, sf), docs(spark, sf))


@query(
    "apply_sync_keys",
    f"""WITH {DOCS}, {LISTING}, l AS (SELECT split_part(key, '/', -1) AS filename, max(key) AS key FROM listing GROUP BY 1)
 SELECT doc_id, coalesce(key, object_key) AS object_key,
  CASE WHEN key IS NOT NULL AND object_key IS DISTINCT FROM key AND embedding_status = 'failed' THEN 'pending' ELSE embedding_status END AS embedding_status
 FROM docs LEFT JOIN l USING (filename)""",
)
def apply_sync_keys(spark, sf):
    return ingest.apply_sync_keys(listing(spark, sf), docs(spark, sf)).select("doc_id", "object_key", "embedding_status")


@query(
    "verify_sync",
    f"""WITH {DOCS}, {LISTING}, d AS (SELECT DISTINCT object_key AS key FROM docs WHERE object_key IS NOT NULL)
 SELECT coalesce(l.key, d.key) AS key, split_part(coalesce(l.key, d.key), '/', 1) AS source,
  CASE WHEN l.key IS NULL THEN 'missing' WHEN d.key IS NULL THEN 'orphaned' ELSE 'matched' END AS state
 FROM listing l FULL OUTER JOIN d ON l.key = d.key""",
)
def verify_sync(spark, sf):
    return ingest.verify_sync(listing(spark, sf), docs(spark, sf))


@query(
    "verify_sync_counts",
    f"""WITH {DOCS}, {LISTING}, d AS (SELECT DISTINCT object_key AS key FROM docs WHERE object_key IS NOT NULL)
 SELECT split_part(coalesce(l.key, d.key), '/', 1) AS source, count(d.key) AS in_documents, count(l.key) AS in_store,
  count(*) FILTER (l.key = d.key) AS matched, count(*) FILTER (l.key IS NULL) AS missing, count(*) FILTER (d.key IS NULL) AS orphaned
 FROM listing l FULL OUTER JOIN d ON l.key = d.key GROUP BY 1""",
)
def verify_sync_counts(spark, sf):
    return ingest.verify_sync_counts(listing(spark, sf), docs(spark, sf))


@query(
    "clear_invalid_keys",
    f"""WITH {DOCS}, {LISTING} SELECT doc_id, CASE WHEN object_key IN (SELECT key FROM listing) THEN object_key END AS object_key FROM docs""",
)
def clear_invalid_keys(spark, sf):
    return ingest.clear_invalid_keys(listing(spark, sf), docs(spark, sf)).select("doc_id", "object_key")


@query(
    "cross_source_duplicates",
    """SELECT md5(text) AS content_hash, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources,
 count(DISTINCT source) AS source_count, count(*) AS copies FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""",
)
def cross_source_duplicates(spark, sf):
    out = ingest.cross_source_duplicates(docs(spark, sf))
    return out.withColumn("sources", F.array_join("sources", ","))


@query(
    "clean_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '[\x00\x{FEFF}]', '', 'g'), '[^\x00-\x7F]', '?', 'g') AS cleaned FROM documents""",
)
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(
    "merge_metadata",
    f"""WITH {DOCS} SELECT doc_id, m_needs_ocr AS needs_ocr, 'done' AS embedding_v2, m_embed_worker_id AS worker,
 CASE WHEN embedding_status = 'failed' THEN 'yes' ELSE 'no' END AS retried FROM docs""",
)
def merge_metadata(spark, sf):
    retried = F.when(F.col("embedding_status") == "failed", "yes").otherwise("no")
    patch = F.create_map(F.lit("embedding_v2"), F.lit("done"), F.lit("retried"), retried)
    merged = docs(spark, sf).withColumn("metadata", tx.merge_metadata(F.col("metadata"), patch))
    m = merged["metadata"]
    return merged.select(
        "doc_id", m["needs_ocr"].alias("needs_ocr"), m["embedding_v2"].alias("embedding_v2"),
        m["embed_worker_id"].alias("worker"), m["retried"].alias("retried"),
    )


@query(
    "drop_metadata_keys",
    f"""WITH {DOCS} SELECT doc_id, CAST(NULL AS VARCHAR) AS started, m_embedding_v2 AS embedding_v2 FROM docs""",
)
def drop_metadata_keys(spark, sf):
    m = tx.drop_keys(F.col("metadata"), "embedding_v2_started", "embed_worker_id")
    d = docs(spark, sf).withColumn("metadata", m)
    return d.select("doc_id", d["metadata"]["embedding_v2_started"].alias("started"), d["metadata"]["embedding_v2"].alias("embedding_v2"))
