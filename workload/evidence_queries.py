"""Evidence reports, composites, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import evidence
from corpusgraph.plans import composites
from corpusgraph.sources import files, sinks
from workload.graph_queries import ONE, TWO, cooc_sql, path_sql
from workload.graph_standins import GRAPH, edges, mentions, nodes
from workload.registry import query, table
from workload.search_queries import BEST, POINTS, TERMS, WORDS, corpus, first_vector, points, ranked_sql, text_mentions
from workload.standins import DOCS, docs
from workload.text_queries import RUNS_SQL

NOTE_COLUMNS = {
    "id": "o_orderkey",
    "subject": "concat('Customer ', o_custkey)",
    "allegation_type": "o_orderpriority",
    "source_credibility_tier": "CAST(substr(o_orderpriority, 1, 1) AS INT)",
    "corroboration_count": "CAST(o_orderkey % 5 AS INT)",
    "primary_doc_verified": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END",
    "created_at": "o_orderdate",
}
NOTES = "notes AS (SELECT {}, o_orderkey % 3 AS supporting FROM orders)".format(", ".join(f"{e} AS {c}" for c, e in NOTE_COLUMNS.items()))
VERDICT = """CASE WHEN primary_doc_verified AND corroboration_count >= 3 THEN 'VERIFIED - High Confidence'
 WHEN primary_doc_verified AND corroboration_count >= 1 THEN 'SUPPORTED - Primary Evidence' WHEN source_credibility_tier <= 2 THEN 'CREDIBLE SOURCE - Needs Corroboration'
 WHEN source_credibility_tier = 3 AND corroboration_count >= 2 THEN 'PROBABLE - Multiple Sources' WHEN source_credibility_tier = 3 THEN 'UNVERIFIED - Single Source'
 WHEN source_credibility_tier >= 4 THEN 'QUESTIONABLE - Low Quality Source' ELSE 'UNKNOWN' END"""


def notes(spark, sf):
    docs_of = F.slice(F.array(F.lit("d1"), F.lit("d2")), F.lit(1), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf, "orders").select(
        *[F.expr(e).alias(c) for c, e in NOTE_COLUMNS.items()], docs_of.alias("corroborating_docs")
    )


@query(
    "verification_scores",
    f"""WITH {NOTES} SELECT id, subject, {VERDICT} AS verification_status, CAST(nullif(supporting, 0) AS INT) AS supporting_docs,
 CASE WHEN primary_doc_verified AND corroboration_count >= 3 THEN 1 WHEN primary_doc_verified THEN 2 ELSE 5 END AS display_order FROM notes""",
)
def verification_scores(spark, sf):
    return evidence.verification_scores(notes(spark, sf))


@query("notes_by_category", f"WITH {NOTES} SELECT id, subject, created_at FROM notes WHERE allegation_type IN ('1-URGENT', '5-LOW')")
def notes_by_category(spark, sf):
    return evidence.notes_by_category(notes(spark, sf), ["1-URGENT", "5-LOW"]).select("id", "subject", "created_at")


@query("subjects", f"WITH {NOTES} SELECT subject, count(*) AS notes, max(created_at) AS latest FROM notes GROUP BY 1")
def subjects(spark, sf):
    return evidence.subjects(notes(spark, sf))


@query("notes_about", f"WITH {NOTES} SELECT id, subject FROM notes WHERE subject ILIKE '%customer 17%'")
def notes_about(spark, sf):
    return evidence.notes_about(notes(spark, sf), "customer 17").select("id", "subject")


@query("entity_notes", "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = 17")
def entity_notes(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey AS entity_id", "o_orderdate AS created_at")
    return evidence.entity_notes(rows, 17).select("id", "created_at")


@query(
    "subject_tags",
    """SELECT t.doc_id AS document_id, 'quality ' || quality AS accused_name, 'doc_' || d.doc_id || '.pdf' AS filename, source
 FROM (SELECT doc_id * 2 AS doc_id, quality FROM labels) t LEFT JOIN documents d ON t.doc_id = d.doc_id WHERE 'quality ' || quality ILIKE '%LITY 1%'""",
)
def subject_tags(spark, sf):
    tags = table(spark, sf, "labels").selectExpr("doc_id * 2 AS document_id", "concat('quality ', quality) AS accused_name")
    return evidence.subject_tags(tags, corpus(spark, sf), "LITY 1").select("document_id", "accused_name", "filename", "source")


HOST = "regexp_extract(url, '://([^/]+)', 1)"
RATINGS = f"ratings AS (SELECT {HOST} AS source_domain, upper({HOST}) AS source_name, CAST(length({HOST}) % 5 + 1 AS INT) AS credibility_tier FROM pages GROUP BY 1)"


def ratings(spark, sf):
    host = F.regexp_extract("url", "://([^/]+)", 1)
    return table(spark, sf, "pages").select(host.alias("source_domain")).distinct().select(
        "source_domain", F.upper("source_domain").alias("source_name"), (F.length("source_domain") % 5 + 1).alias("credibility_tier")
    )


@query(
    "source_rating",
    f"""WITH {RATINGS} SELECT 'ththth' AS requested, min(source_domain) AS source_domain, min_by(source_name, source_domain) AS source_name,
 min_by(credibility_tier, source_domain) AS credibility_tier, CASE WHEN count(*) = 0 THEN 'NOT_RATED' ELSE 'RATED' END AS status FROM ratings WHERE source_domain ILIKE '%ththth%'""",
)
def source_rating(spark, sf):
    return evidence.source_rating(ratings(spark, sf), "ththth")


@query(
    "source_ratings",
    f"""WITH {RATINGS}, asked AS (SELECT DISTINCT regexp_replace(source_domain, '^[^.]*[.]', '') AS requested FROM ratings UNION SELECT DISTINCT source FROM documents)
 SELECT requested, min(source_domain) AS source_domain, min_by(source_name, source_domain) AS source_name, min_by(credibility_tier, source_domain) AS credibility_tier,
  CASE WHEN count(source_domain) = 0 THEN 'NOT_RATED' ELSE 'RATED' END AS status
 FROM asked LEFT JOIN ratings ON source_domain = requested OR source_domain LIKE '%.' || requested GROUP BY 1""",
)
def source_ratings(spark, sf):
    rated = ratings(spark, sf)
    asked = rated.select(F.regexp_replace("source_domain", "^[^.]*[.]", "").alias("source_domain")).unionByName(
        table(spark, sf, "documents").select(F.col("source").alias("source_domain"))
    )
    return evidence.source_ratings(asked, rated)


@query("sources_by_tier", f"WITH {RATINGS} SELECT source_domain, credibility_tier FROM ratings WHERE credibility_tier = 2")
def sources_by_tier(spark, sf):
    return evidence.sources_by_tier(ratings(spark, sf), 2).select("source_domain", "credibility_tier")


@query(
    "upsert_rating",
    f"""WITH {RATINGS}, i AS (SELECT source AS source_domain, CAST(NULL AS VARCHAR) AS source_name, CAST(1 AS INT) AS credibility_tier FROM documents GROUP BY 1
  UNION ALL SELECT source_domain, CASE WHEN credibility_tier > 2 THEN 'new' END, CASE WHEN credibility_tier < 4 THEN 5 END FROM ratings)
 SELECT coalesce(i.source_domain, r.source_domain) AS source_domain, coalesce(i.source_name, r.source_name) AS source_name, coalesce(i.credibility_tier, r.credibility_tier) AS credibility_tier
 FROM ratings r FULL OUTER JOIN i ON r.source_domain = i.source_domain""",
)
def upsert_rating(spark, sf):
    old = ratings(spark, sf)
    changed = old.select(
        "source_domain", F.when(F.col("credibility_tier") > 2, "new").alias("source_name"), F.when(F.col("credibility_tier") < 4, 5).alias("credibility_tier")
    )
    fresh = table(spark, sf, "documents").select(F.col("source").alias("source_domain")).distinct().select(
        "source_domain", F.lit(None).cast("string").alias("source_name"), F.lit(1).alias("credibility_tier")
    )
    return evidence.upsert_keep_old(old, changed.unionByName(fresh), "source_domain")


FINDINGS = r"""findings AS (SELECT doc_id AS id, source AS investigation_id, array_to_string(list_slice(w, 1, 2), ' ') AS title, list_slice(w, 3, 4) AS entities, w AS evidence,
 (doc_id % 10) / 10.0::DOUBLE AS confidence, timestamp '2024-01-01 00:00:00' + (doc_id % 500) * interval '1' minute AS created_at FROM (SELECT *, string_split(lower(text), ' ') AS w FROM documents) d)"""


def findings(spark, sf):
    w = F.split(F.lower("text"), " ")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("investigation_id"), F.array_join(F.slice(w, 1, 2), " ").alias("title"),
        F.slice(w, 3, 2).alias("entities"), w.alias("evidence"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("confidence"),
        F.expr("timestamp '2024-01-01 00:00:00' + (doc_id % 500) * interval '1' minute").alias("created_at"),
    )


HASHED = rf"""{FINDINGS}, h AS (SELECT *, md5(lower(regexp_replace(title, '^\s+|\s+$', '', 'g')) || '|' || array_to_string(list_sort(entities), '|')) AS content_hash FROM findings),
 k AS (SELECT *, row_number() OVER (PARTITION BY investigation_id, content_hash ORDER BY created_at, id) = 1 AS inserted FROM h)"""


@query("dedup_findings", f"WITH {HASHED} SELECT id, investigation_id, content_hash, inserted FROM k")
def dedup_findings(spark, sf):
    return evidence.dedup_findings(findings(spark, sf)).select("id", "investigation_id", "content_hash", "inserted")


@query("stored_findings", f"WITH {HASHED} SELECT id, title, confidence FROM k WHERE inserted")
def stored_findings(spark, sf):
    return evidence.stored_findings(findings(spark, sf)).select("id", "title", "confidence")


BAND = "CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"


@query(
    "confidence_bands",
    f"WITH {FINDINGS} SELECT investigation_id, {BAND} AS band, count(*) AS findings, round(avg(confidence), 6) AS avg_confidence FROM findings GROUP BY 1, 2",
)
def confidence_bands(spark, sf):
    return evidence.confidence_bands(findings(spark, sf))


@query(
    "report_rows",
    f"WITH {FINDINGS} SELECT id, title, {BAND} AS band, array_to_string(list_slice(evidence, 1, 5), '|') AS evidence, array_to_string(list_slice(entities, 1, 15), '|') AS entities FROM findings",
)
def report_rows(spark, sf):
    rows = evidence.report_rows(findings(spark, sf))
    return rows.withColumn("evidence", F.array_join("evidence", "|")).withColumn("entities", F.array_join("entities", "|"))


@query(
    "platform_stats",
    f"""WITH {DOCS}, {GRAPH} SELECT (SELECT count(*) FROM docs) AS documents, (SELECT count(text) FROM docs) AS with_text, (SELECT count(DISTINCT source) FROM docs) AS sources,
 (SELECT count(*) FROM nodes WHERE label = 'Person') AS person_nodes, (SELECT count(*) FROM nodes WHERE label = 'Organization') AS organization_nodes,
 (SELECT count(*) FROM nodes WHERE label = 'Location') AS location_nodes, (SELECT count(*) FROM nodes WHERE label = 'Document') AS document_nodes,
 (SELECT count(*) FROM embeddings) AS vectors""",
)
def platform_stats(spark, sf):
    return evidence.platform_stats(docs(spark, sf), nodes(spark, sf), table(spark, sf, "embeddings"))


@query(
    "outliers",
    """WITH c AS (SELECT l_partkey AS part, count(*) AS n FROM lineitem GROUP BY 1),
 s AS (SELECT avg(n) AS m, stddev_samp(n) AS sd, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM c),
 o AS (SELECT part, n, round((n - m) / sd, 6) AS z_score, n < q1 - 1.5 * (q3 - q1) OR n > q3 + 1.5 * (q3 - q1) AS outside_iqr FROM c, s)
 SELECT part, n, z_score, outside_iqr FROM o WHERE abs(z_score) >= 3 OR outside_iqr""",
)
def outliers(spark, sf):
    counts = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("*").alias("n"))
    return evidence.outliers(counts, "part", "n")


@query(
    "entity_document_filter",
    "SELECT doc_id FROM documents WHERE contains('doc_' || doc_id || '.pdf', '7') AND lang = 'fr'",
)
def entity_document_filter(spark, sf):
    return evidence.entity_document_filter(corpus(spark, sf), "7", "fr").select("doc_id")


@query("document_types", "SELECT DISTINCT lang AS doc_type FROM documents")
def document_types(spark, sf):
    return evidence.document_types(corpus(spark, sf))


# Composite jobs: their parts are stacked as (part, item, number) rows.
def _stack(parts):
    rows = None
    for name, df, item, number in parts:
        part = df.select(F.lit(name).alias("part"), F.expr(item).cast("string").alias("item"), F.expr(number).cast("bigint").alias("number"))
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(
    "person_profile",
    f"""WITH {GRAPH}, {NOTES} SELECT 'connections' AS part, name AS item, shared_docs AS number FROM {cooc_sql(ONE, 30)} c JOIN nodes USING (id)
 UNION ALL SELECT 'entities', name, (SELECT count(*) FROM edges WHERE src = id) FROM nodes WHERE label = 'Person' AND contains(name, '{ONE}')
 UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), 1 FROM (SELECT doc_id FROM documents WHERE text ILIKE '%{ONE}%' ORDER BY 1 LIMIT 50) d
 UNION ALL SELECT 'notes', CAST(id AS VARCHAR), 1 FROM notes WHERE subject ILIKE '%{ONE}%'
 UNION ALL SELECT 'document_count', 'n', count(*) FROM documents WHERE text ILIKE '%{ONE}%'""",
)
def person_profile(spark, sf):
    p = composites.person_profile(ONE, nodes(spark, sf), edges(spark, sf), corpus(spark, sf), notes(spark, sf))
    return _stack([
        ("connections", p["connections"], "name", "shared_docs"), ("entities", p["entities"], "name", "connections"),
        ("documents", p["documents"], "doc_id", "1"), ("notes", p["notes"], "id", "1"), ("document_count", p["document_count"], "'n'", "documents"),
    ])


_PATH = path_sql(5, 9, 2)


@query(
    "connection_map",
    f"""WITH p AS ({_PATH}), {GRAPH} SELECT 'path' AS part, CAST(id AS VARCHAR) AS item, CAST(step AS BIGINT) AS number FROM p
 UNION ALL SELECT 'a', name, shared_docs FROM {cooc_sql(ONE, 20)} a JOIN nodes USING (id)
 UNION ALL SELECT 'b', name, shared_docs FROM {cooc_sql(TWO, 20)} b JOIN nodes USING (id)
 UNION ALL SELECT 'shared', name, 1 FROM (SELECT name FROM {cooc_sql(ONE, 20)} a JOIN nodes USING (id) INTERSECT SELECT name FROM {cooc_sql(TWO, 20)} b JOIN nodes USING (id)) s""",
)
def connection_map(spark, sf):
    c = composites.connection_map(ONE, TWO, nodes(spark, sf), mentions(spark, sf))
    return _stack([
        ("path", c["path"], "id", "step"), ("a", c["a_connections"], "name", "shared_docs"),
        ("b", c["b_connections"], "name", "shared_docs"), ("shared", c["shared"], "name", "1"),
    ])


@query(
    "document_triage",
    f"""WITH {ranked_sql(TERMS)}, {POINTS}, {BEST}, t AS (SELECT doc_id, score FROM ranked ORDER BY score DESC, doc_id LIMIT 20),
 b AS (SELECT doc_id, score FROM best ORDER BY score DESC, doc_id LIMIT 20), n AS (SELECT doc_id, source FROM documents WHERE text ILIKE '%er ha%' ORDER BY doc_id LIMIT 20)
 SELECT doc_id, score, CAST(NULL AS VARCHAR) AS source, 0 AS step FROM t UNION ALL SELECT doc_id, score, NULL, 1 FROM b WHERE doc_id NOT IN (SELECT doc_id FROM t)
 UNION ALL SELECT doc_id, NULL, source, 2 FROM n WHERE doc_id NOT IN (SELECT doc_id FROM t UNION ALL SELECT doc_id FROM b)""",
)
def document_triage(spark, sf):
    return composites.document_triage(WORDS, corpus(spark, sf), points(spark, sf), first_vector(spark, sf), 20)


@query(
    "entity_network",
    f"""WITH {GRAPH} SELECT id, label, name, shared_docs, (SELECT count(DISTINCT dst) FROM edges JOIN nodes e ON src = e.id WHERE type = 'MENTIONED_IN' AND contains(lower(e.name), 'red r')) AS document_count
 FROM {cooc_sql('red r', 50)} c JOIN nodes USING (id)""",
)
def entity_network(spark, sf):
    return composites.entity_network("Red R", nodes(spark, sf), mentions(spark, sf))


# Sources and sinks.
@query(
    "join_sidecar_text",
    f"""WITH {DOCS} SELECT doc_id, filename, t.quality || '/' || t.toxic AS text, regexp_replace(filename, '[.][^.]*$', '') AS stem FROM docs LEFT JOIN labels t USING (doc_id)""",
)
def join_sidecar_text(spark, sf):
    side = table(spark, sf, "labels").selectExpr("concat('/texts/doc_', doc_id, '.txt') AS path", "concat(quality, '/', toxic) AS text")
    return files.join_sidecar_text(docs(spark, sf).select("doc_id", "filename"), side)


@query(
    "filename_index",
    "SELECT split_part(url, '/', -1) AS filename, arg_max(url, page_id) AS path FROM pages GROUP BY 1",
)
def filename_index(spark, sf):
    rows = table(spark, sf, "pages").select(
        F.col("url").alias("path"), F.element_at(F.split("url", "/"), -1).alias("filename"), F.col("page_id").alias("scan_order")
    )
    return files.filename_index(rows)


@query("read_table", "SELECT r_regionkey, r_name FROM region")
def read_table(spark, sf):
    return files.read_table(spark, f"{sf}/region.parquet")


EXPORTED = f"""{RUNS_SQL}, e AS (SELECT doc_id, string_agg(name, '; ' ORDER BY name) AS entities FROM runs GROUP BY 1),
 x AS (SELECT 'doc_' || doc_id || '.pdf' AS filename, source, lang AS doc_type, '' AS date, CAST(n_chars AS DOUBLE) AS score,
  regexp_replace('<mark>' || text || '</mark>', '<[^>]*>', '', 'g') AS snippet, coalesce(entities, '') AS entities
  FROM documents LEFT JOIN e USING (doc_id))"""


def export_rows(spark, sf):
    names = text_mentions(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    results = table(spark, sf, "documents").join(names, "doc_id", "left").select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "source", F.col("lang").alias("doc_type"),
        F.lit(None).cast("timestamp").alias("date"), F.col("n_chars").cast("double").alias("score"),
        F.concat(F.lit("<mark>"), F.col("text"), F.lit("</mark>")).alias("snippet"),
        F.transform(F.coalesce("names", F.array().cast("array<string>")), lambda n: F.struct(n.alias("name"))).alias("entities"),
    )
    return sinks.export_rows(results)


@query("export_rows", f"WITH {EXPORTED} SELECT filename, source, doc_type, date, score, snippet, entities FROM x")
def exported(spark, sf):
    return export_rows(spark, sf)


@query("export_csv", "SELECT o_orderkey AS filename, o_orderstatus AS source FROM orders")
def export_csv(spark, sf):
    """Writes the export and reads it back."""
    from corpusgraph.session import scratch_path

    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("filename"), F.col("o_orderstatus").alias("source"), F.lit(None).cast("string").alias("doc_type"),
        F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("snippet"),
        F.array(F.struct(F.lit("x, \"y\"").alias("name"))).alias("entities"),
    )
    path = scratch_path(spark, "export")
    sinks.export_csv(rows, path)
    back = spark.read.csv(path, header=True, quote='"', escape='"')
    return back.select(F.col(back.columns[0]).cast("bigint").alias("filename"), "source")


@query("export_json", "SELECT doc_id, quality, toxic FROM labels")
def export_json(spark, sf):
    """Writes JSON lines and reads them back."""
    from corpusgraph.session import scratch_path

    path = scratch_path(spark, "export")
    sinks.export_json(table(spark, sf, "labels"), path)
    return spark.read.schema("doc_id bigint, quality int, toxic int").json(path)


@query(
    "merge_points",
    """SELECT user_id AS point_id, max_by(event_id, ts) AS chunk_index, max(ts) AS indexed_at FROM events WHERE event_type = 'click' GROUP BY 1
 UNION ALL SELECT user_id, max_by(event_id, ts), max(ts) FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click') GROUP BY 1""",
)
def merge_points(spark, sf):
    rows = table(spark, sf, "events").selectExpr("user_id AS point_id", "event_id AS chunk_index", "ts AS indexed_at", "event_type")
    return sinks.merge_points(rows.where("event_type = 'view'").drop("event_type"), rows.where("event_type = 'click'").drop("event_type"))


@query(
    "write_points",
    "SELECT vec_id AS point_id, label FROM embeddings",
)
def write_points(spark, sf):
    """Upserts all, then a part again: that must change nothing."""
    from corpusgraph.session import scratch_path

    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.lit("2024-01-01").alias("indexed_at"))
    path = scratch_path(spark, "points")
    sinks.write_points(spark, rows, path)
    sinks.write_points(spark, rows.where("label = 3"), path)
    return sinks.read_points(spark, path).select("point_id", "label")


@query(
    "write_graph",
    f"WITH {GRAPH} SELECT type, count(*) AS edges FROM edges GROUP BY 1 UNION ALL SELECT label, count(*) FROM nodes GROUP BY 1",
)
def write_graph(spark, sf):
    """Merges the graph in two overlapping steps."""
    from corpusgraph.session import scratch_path

    path = scratch_path(spark, "graph")
    sinks.write_graph(spark, nodes(spark, sf).where("label <> 'Document'"), mentions(spark, sf), path)
    sinks.write_graph(spark, nodes(spark, sf), edges(spark, sf), path)
    n, e = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    counted = e.groupBy("type").agg(F.count("*").alias("edges"))
    return counted.unionByName(n.groupBy(F.col("label").alias("type")).agg(F.count("*").alias("edges")))
