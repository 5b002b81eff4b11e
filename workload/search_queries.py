"""Full-text, vector and fused search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import extraction, fusion, search, textindex, vectors
from corpusgraph.session import cut_lineage
from workload.registry import ORACLE, query, scored_query, stored_once, table
from workload.standins import DOCS, docs
from workload.text_queries import RUNS_SQL

WORDS = "er ha"
TERMS = ["er", "ha"]
STOP = ", ".join(f"'{w}'" for w in [""] + search.STOP_WORDS)
TOKENS = rf"list_filter(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w NOT IN ({STOP}))"


def ranked_sql(terms, source="documents", where="true"):
    """(doc_id, score) of the documents with all terms."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return rf"""tok AS (SELECT doc_id, unnest({TOKENS}) AS token FROM {source} WHERE {where}),
 tf AS (SELECT doc_id, token, count(*) AS tf FROM tok WHERE token IN ({listed}) GROUP BY 1, 2),
 df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
 ranked AS (SELECT doc_id, round(sum((1 + ln(tf)) * ln(1 + (SELECT count(*) FROM {source} WHERE {where}) / df)), 12) AS score
  FROM tf JOIN df USING (token) GROUP BY 1 HAVING count(*) = {len(terms)})"""


SNIPPET = r"""array_to_string(list_transform(list_slice(w, st, st + 49), lambda x: CASE WHEN list_has_any(string_split_regex(lower(x), '[^\p{L}\p{N}]+'), ['er', 'ha']) THEN '<mark>' || x || '</mark>' ELSE x END), ' ')"""
FIRST = r"""greatest(list_position(list_transform(w, lambda x: list_has_any(string_split_regex(lower(x), '[^\p{L}\p{N}]+'), ['er', 'ha'])), true) - 20, 1)"""


def corpus(spark, sf):
    """Documents with their whole text and no metadata."""
    return table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"), "source",
        F.col("lang").alias("doc_type"), "text",
    )


@query(
    "token_index",
    rf"""SELECT token, doc_id, count(*) AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions FROM (
 SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {TOKENS} AS t FROM documents) a) b GROUP BY 1, 2""",
)
def token_index(spark, sf):
    return search.token_index(corpus(spark, sf)).withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ","))


@scored_query(
    "fulltext",
    rf"""WITH {ranked_sql(TERMS)}, top AS (SELECT * FROM ranked ORDER BY score DESC, doc_id LIMIT 25),
 p AS (SELECT doc_id, source, lang AS doc_type, score, string_split_regex(text, '\s+') AS w FROM documents JOIN top USING (doc_id))
 SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, source, doc_type, score, {SNIPPET} AS snippet FROM (SELECT *, {FIRST} AS st FROM p) q""",
)
def fulltext(spark, sf):
    return search.fulltext(corpus(spark, sf), WORDS)


@scored_query(
    "fulltext_filtered",
    rf"""WITH {ranked_sql(['tion'], 'documents', "source IN ('src1', 'src5', 'src9') AND lang = 'en'")}
 SELECT doc_id, score FROM ranked ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10""",
)
def fulltext_filtered(spark, sf):
    kept = search.apply_filters(corpus(spark, sf), sources=["src1", "src5", "src9"], doc_types=["en"])
    return search.fulltext(kept, "tion", limit=10, offset=10).select("doc_id", "score")


@scored_query(
    "fulltext_ranking",
    f"WITH {ranked_sql(TERMS)} SELECT doc_id, score FROM ranked",
)
def fulltext_ranking(spark, sf):
    d = corpus(spark, sf)
    return search.rank_documents(search.postings(d, TERMS), TERMS, d.agg(F.count("*").alias("n")).scalar())


@query("matching", f"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'er') AND list_contains({TOKENS}, 'ha')")
def matching(spark, sf):
    return search.matching(corpus(spark, sf), WORDS).select("doc_id")


@query(
    "snippet",
    rf"""SELECT doc_id, coalesce({SNIPPET}, '') AS snippet FROM (SELECT *, {FIRST} AS st FROM (SELECT doc_id, string_split_regex(text, '\s+') AS w FROM documents) a) b""",
)
def snippet(spark, sf):
    return corpus(spark, sf).select("doc_id", search.snippet(F.col("text"), TERMS).alias("snippet"))


@query(
    "capped_count",
    f"SELECT least(count(*), 10001) AS count FROM documents WHERE list_contains({TOKENS}, 'er') AND list_contains({TOKENS}, 'ha')",
)
def capped_count(spark, sf):
    return search.capped_count(search.matching(corpus(spark, sf), WORDS))


@query(
    "apply_filters",
    f"""WITH {DOCS} SELECT doc_id, source, doc_type, created_at FROM docs WHERE source IN ('src2', 'src4', 'src8') AND doc_type IN ('en', 'fr')
 AND m_content_classification IN ('en', 'fr') AND created_at BETWEEN timestamp '2024-01-01 06:00:00' AND timestamp '2024-06-01 00:00:00'""",
)
def apply_filters(spark, sf):
    import datetime as dt

    kept = search.apply_filters(
        docs(spark, sf), sources=["src2", "src4", "src8"], doc_types=["en", "fr"], classifications=["en", "fr"],
        date_range=(dt.datetime(2024, 1, 1, 6), dt.datetime(2024, 6, 1)),
    )
    return kept.select("doc_id", "source", "doc_type", "created_at")


@query(
    "documents_with_all",
    f"""WITH {RUNS_SQL} SELECT doc_id FROM runs WHERE name IN ('The', 'And', 'Was') GROUP BY 1 HAVING count(DISTINCT name) = 3""",
)
def documents_with_all(spark, sf):
    mentions = extraction.capitalized_runs(corpus(spark, sf)).withColumnRenamed("name", "entity_id")
    return search.documents_with_all(mentions, ["The", "And", "Was", "The"])


@query(
    "substring_search",
    "SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, source, substr(text, 1, 500) AS text_preview FROM documents WHERE text ILIKE '%on the%' ORDER BY doc_id LIMIT 25",
)
def substring_search(spark, sf):
    return search.substring_search(corpus(spark, sf), "On-the")


@query(
    "substring_count",
    "SELECT count(*) AS documents, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents WHERE text ILIKE '%on the%'",
)
def substring_count(spark, sf):
    return search.substring_count(corpus(spark, sf), "On-the").withColumn("sources", F.array_join("sources", ","))


# Points: two chunks per document, three collections.
POINTS = """points AS (SELECT vec_id AS point_id, CAST(floor(vec_id / 2) AS BIGINT) AS document_id, concat('src', label) AS source,
 CASE vec_id % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'vlm' ELSE 'v1' END AS embedding_type, vec_id % 4 AS people_count, embedding FROM embeddings)"""
Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {Q0}), 12)"


def points(spark, sf):
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS point_id", "CAST(floor(vec_id / 2) AS BIGINT) AS document_id", "concat('src', label) AS source",
        "CASE vec_id % 3 WHEN 0 THEN 'v2' WHEN 1 THEN 'vlm' ELSE 'v1' END AS embedding_type", "vec_id % 4 AS people_count", "embedding",
    )


def first_vector(spark, sf):
    return vectors.vector_of(points(spark, sf), 0)


@scored_query(
    "knn",
    f"WITH {POINTS} SELECT point_id, document_id, source, embedding_type, people_count, {COS} AS score FROM points ORDER BY score DESC, point_id LIMIT 20",
)
def knn(spark, sf):
    return vectors.knn(points(spark, sf), first_vector(spark, sf), 20)


@scored_query(
    "knn_filtered",
    f"""WITH {POINTS} SELECT point_id, {COS} AS score FROM points WHERE source IN ('src1', 'src2', 'src3') AND embedding_type = 'v2' AND people_count >= 1
 AND {COS} >= -0.5 ORDER BY score DESC, point_id LIMIT 10""",
)
def knn_filtered(spark, sf):
    found = vectors.knn(points(spark, sf), first_vector(spark, sf), 10, threshold=-0.5, people_count=1,
                        source=["src1", "src2", "src3"], embedding_type="v2")
    return found.select("point_id", "score")


@scored_query(
    "knn_batch",
    """SELECT query_id, point_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank FROM (
 SELECT q.vec_id AS query_id, p.vec_id AS point_id, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 12) AS score
 FROM embeddings q JOIN embeddings p ON q.vec_id <> p.vec_id) a) b WHERE rank <= 5""",
)
def knn_batch(spark, sf):
    p = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "point_id")
    return vectors.knn_batch(p, p.withColumnRenamed("point_id", "query_id"), 5, exclude_self=True)


@scored_query(
    "similar_to",
    f"WITH {POINTS} SELECT point_id, document_id, {COS} AS score FROM points WHERE document_id <> 0 AND embedding_type = 'v2' ORDER BY score DESC, point_id LIMIT 10",
)
def similar_to(spark, sf):
    return vectors.similar_to(points(spark, sf), 0, 10, embedding_type="v2").select("point_id", "document_id", "score")


@scored_query(
    "search_collections",
    f"""WITH {POINTS}, s AS (SELECT *, {COS} AS score FROM points),
 d AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, embedding_type DESC, point_id) AS best FROM s)
 SELECT document_id, score, embedding_type AS collection, point_id FROM d WHERE best = 1 ORDER BY score DESC, document_id LIMIT 15""",
)
def search_collections(spark, sf):
    p = points(spark, sf)
    named = {t: p.where(F.col("embedding_type") == t) for t in ("v2", "vlm", "v1")}
    return vectors.search_collections(named, first_vector(spark, sf), 15)


BEST = f"""best AS (SELECT document_id AS doc_id, score, point_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, point_id) AS rn
 FROM (SELECT *, {COS} AS score FROM points) a) b WHERE rn = 1)"""


@scored_query(
    "semantic",
    f"""WITH {POINTS}, {BEST} SELECT d.doc_id, 'doc_' || d.doc_id || '.pdf' AS filename, source, lang AS doc_type, score,
 CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS snippet
 FROM (SELECT * FROM best WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') ORDER BY score DESC, doc_id LIMIT 20) b JOIN documents d ON b.doc_id = d.doc_id""",
)
def semantic(spark, sf):
    english = search.apply_filters(corpus(spark, sf), doc_types=["en"])
    return fusion.semantic(english, points(spark, sf), first_vector(spark, sf), 20, filtered=True)


FUSED = f"""{ranked_sql(TERMS)}, {POINTS}, {BEST},
 a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM ranked QUALIFY r <= 40),
 b AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM best QUALIFY r <= 40),
 fused AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CAST(a.r AS INT) AS left_rank, CAST(b.r AS INT) AS right_rank,
  round(coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0), 9) AS score FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id)"""


@query(
    "hybrid",
    f"""WITH {FUSED} SELECT d.doc_id, 'doc_' || d.doc_id || '.pdf' AS filename, source, lang AS doc_type, left_rank, right_rank, score
 FROM (SELECT * FROM fused ORDER BY score DESC, doc_id LIMIT 20) f JOIN documents d ON f.doc_id = d.doc_id""",
)
def hybrid(spark, sf):
    return fusion.hybrid(corpus(spark, sf), points(spark, sf), WORDS, first_vector(spark, sf), limit=20)


@scored_query(
    "unified_search",
    f"""WITH {ranked_sql(TERMS)}, {POINTS}, s AS (SELECT document_id AS doc_id, embedding_type, max({COS}) AS score FROM points GROUP BY 1, 2),
 u AS (SELECT doc_id, score, 'semantic_v2' AS search_type, 0 AS priority FROM (SELECT * FROM s WHERE embedding_type = 'v2' ORDER BY score DESC, doc_id LIMIT 15) a
  UNION ALL SELECT doc_id, score, 'vlm', 1 FROM (SELECT * FROM s WHERE embedding_type = 'vlm' ORDER BY score DESC, doc_id LIMIT 15) b
  UNION ALL SELECT doc_id, score, 'fulltext', 2 FROM (SELECT * FROM ranked ORDER BY score DESC, doc_id LIMIT 15) c)
 SELECT doc_id, score, search_type, priority FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority) AS rn FROM u) q
 WHERE rn = 1 ORDER BY priority, score DESC, doc_id LIMIT 30""",
)
def unified_search(spark, sf):
    p, v = points(spark, sf), first_vector(spark, sf)

    def by_type(name):
        return vectors.best_chunks(p.where(F.col("embedding_type") == name), v, 15).withColumnRenamed("document_id", "doc_id")

    words = search.fulltext(corpus(spark, sf), WORDS, limit=15).select("doc_id", "score")
    return fusion.first_seen([("semantic_v2", by_type("v2")), ("vlm", by_type("vlm")), ("fulltext", words)], 30)


@scored_query(
    "merge_step_results",
    f"""WITH {ranked_sql(TERMS)}, t AS (SELECT * FROM ranked ORDER BY score DESC, doc_id LIMIT 15),
 n AS (SELECT doc_id, source FROM documents WHERE text ILIKE '%er ha%' ORDER BY doc_id LIMIT 25)
 SELECT doc_id, score, CAST(NULL AS VARCHAR) AS source, 0 AS step FROM t
 UNION ALL SELECT doc_id, CAST(NULL AS DOUBLE), source, 1 FROM n WHERE doc_id NOT IN (SELECT doc_id FROM t)""",
)
def merge_step_results(spark, sf):
    d = corpus(spark, sf)
    words = search.fulltext(d, WORDS, limit=15).select("doc_id", "score")
    literal = search.substring_search(d, "er ha").select("doc_id", "source")
    return fusion.merge_step_results([words, literal])


ENTITY_ID = "CAST(('0x' || substr(md5(name), 1, 15)) AS BIGINT)"


def text_mentions(spark, sf):
    """Capitalised names in the documents as (doc_id, entity_id, name, mention_count)."""
    runs = extraction.capitalized_runs(corpus(spark, sf))
    return runs.withColumn("entity_id", F.conv(F.substring(F.md5("name"), 1, 15), 16, 10).cast("bigint"))


@query(
    "with_entities",
    f"""WITH {RUNS_SQL}, {ranked_sql(TERMS)}, t AS (SELECT * FROM ranked ORDER BY score DESC, doc_id LIMIT 25)
 SELECT t.doc_id, coalesce(array_to_string(list(name ORDER BY mention_count DESC, name) FILTER (name IS NOT NULL), '; '), '') AS entities
 FROM t LEFT JOIN runs USING (doc_id) GROUP BY 1""",
)
def with_entities(spark, sf):
    m = text_mentions(spark, sf)
    ents = m.groupBy(F.col("entity_id").alias("id"), F.col("name").alias("canonical_name")).agg(F.lit("person").alias("entity_type"))
    page = search.fulltext(corpus(spark, sf), WORDS).select("doc_id")
    out = fusion.with_entities(page, m, ents)
    return out.select("doc_id", F.array_join(F.transform("entities", lambda e: e["name"]), "; ").alias("entities"))


@query(
    "autocomplete",
    f"WITH {RUNS_SQL} SELECT DISTINCT {ENTITY_ID} AS id, name AS canonical_name FROM runs WHERE name ILIKE 'thE%' ORDER BY 2, 1 LIMIT 10",
)
def autocomplete(spark, sf):
    ents = text_mentions(spark, sf).select(F.col("entity_id").alias("id"), F.col("name").alias("canonical_name")).distinct()
    return search.autocomplete(ents, "thE")


@query("get_documents", "SELECT doc_id, source FROM documents WHERE doc_id IN (3, 5, 8, 13, 999999)")
def get_documents(spark, sf):
    return search.get_documents(corpus(spark, sf), [3, 5, 8, 13, 999999]).select("doc_id", "source")


@query("get_document_by_name", "SELECT doc_id, source FROM documents WHERE 'doc_' || doc_id || '.pdf' = 'doc_17.pdf'")
def get_document_by_name(spark, sf):
    return search.get_documents(corpus(spark, sf), filename="doc_17.pdf").select("doc_id", "source")


@query(
    "get_documents_for",
    "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def get_documents_for(spark, sf):
    return search.get_documents_for(corpus(spark, sf), table(spark, sf, "labels").where("quality = 1")).select("doc_id", "source")


@query(
    "search_nested",
    "SELECT doc_id FROM documents WHERE (doc_id % 2 = 0 AND text ILIKE '%er ha%') OR source ILIKE '%er ha%' OR lang ILIKE '%er ha%' ORDER BY doc_id LIMIT 50",
)
def search_nested(spark, sf):
    nested = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("extracted_text"),
            F.col("source").alias("people_description"), F.col("doc_type").alias("context"),
        )
    )
    return search.search_nested(corpus(spark, sf).withColumn("analysis", nested), "er ha").select("doc_id")


@query(
    "year_range",
    f"SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, source FROM documents WHERE regexp_matches(text, '2003|2004|2005|2006|2007') AND list_contains({TOKENS}, 'license') ORDER BY doc_id LIMIT 20",
)
def year_range(spark, sf):
    return search.year_range(corpus(spark, sf), 2003, 2007, "license")


@query("vector_distribution", f"WITH {POINTS} SELECT embedding_type, count(*) AS vectors FROM points GROUP BY 1")
def vector_distribution(spark, sf):
    return vectors.vector_distribution(points(spark, sf), "embedding_type")


@query(
    "validate_vectors",
    """SELECT vec_id AS point_id, CASE WHEN e IS NULL THEN 'missing' ELSE 'dimension ' || len(e) END AS error FROM (
 SELECT vec_id, CASE WHEN label = 3 THEN NULL WHEN label = 4 THEN list_slice(embedding, 1, 10) ELSE embedding END AS e FROM embeddings) q WHERE e IS NULL OR len(e) <> 64""",
)
def validate_vectors(spark, sf):
    damaged = F.when(F.col("label") == 4, F.slice("embedding", 1, 10)).when(F.col("label") != 3, F.col("embedding"))
    return vectors.validate_vectors(table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), damaged.alias("embedding")), 64)


@query(
    "embed_status_rollup",
    """SELECT user_id AS doc_id, count(*) FILTER (event_type = 'error' AND value > 40) AS chunks_done, count(*) FILTER (NOT (event_type = 'error' AND value > 40)) AS chunks_failed,
 CASE WHEN count(*) FILTER (event_type = 'error' AND value > 40) > 0 THEN 'completed' ELSE 'failed' END AS status,
 CASE WHEN count(*) FILTER (event_type = 'error' AND value > 40) = 0 THEN 'all_chunks_failed (' || count(*) || ' chunks)' END AS error FROM events GROUP BY 1""",
)
def embed_status_rollup(spark, sf):
    chunks = table(spark, sf, "events").selectExpr("user_id AS doc_id", "event_type = 'error' AND value > 40 AS ok")
    return vectors.embed_status_rollup(chunks)


@query(
    "cost_estimate",
    "SELECT count(*) AS vectors, count(*) * 500 AS tokens, round(count(*) * 500 * 0.02::DOUBLE / 1000000, 6) AS cost_usd FROM embeddings",
)
def cost_estimate(spark, sf):
    return vectors.cost_estimate(table(spark, sf, "embeddings"))


@scored_query("fulltext_indexed", ORACLE["fulltext"].removeprefix("SELECT * REPLACE (round(score, 6) AS score) FROM (").removesuffix(") shown"))
def fulltext_indexed(spark, sf):
    d = corpus(spark, sf)
    path = stored_once(spark, sf, "word-index", lambda p: textindex.write_block_index(d.select("doc_id", "text"), p, segment=64))
    return textindex.fulltext(d, path, WORDS)


@query("substring_indexed", ORACLE["substring_search"])
def substring_indexed(spark, sf):
    d = corpus(spark, sf)
    path = stored_once(spark, sf, "trigrams", lambda p: textindex.write_trigram_index(d, "doc_id", "text", p))
    found = textindex.containing(d, path, "on the")
    return found.select("doc_id", "filename", "source", F.substring("text", 1, 500).alias("text_preview")).orderBy("doc_id").limit(25)


@query("autocomplete_indexed", ORACLE["autocomplete"])
def autocomplete_indexed(spark, sf):
    ents = cut_lineage(text_mentions(spark, sf).select(F.col("entity_id").alias("id"), F.col("name").alias("canonical_name")).distinct())
    path = stored_once(spark, sf, "name-trigrams", lambda p: textindex.write_trigram_index(ents, "id", "canonical_name", p, anchored=True))
    return textindex.containing(ents, path, "thE", "id", "canonical_name", prefix=True).orderBy("canonical_name", "id").limit(10)
