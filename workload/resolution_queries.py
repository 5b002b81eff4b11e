"""Entity resolution and graph algorithms."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.functions.names import TITLE_PATTERN
from corpusgraph.functions.similarity import jaro_winkler
from corpusgraph.operators import algorithms, extraction, graph, resolution
from workload.graph_standins import CO_MENTIONED, GRAPH, edges, members, mentions, nodes
from workload.registry import query, stored_once, table
from workload.text_queries import RUNS_SQL

# Names are the capitalised runs of the documents; the source of a name's first
# document decides its label, so each label has thousands of entities.
ENTITY_ID = "CAST(('0x' || substr(md5(name), 1, 15)) AS BIGINT)"
# The SQL function compares bytes; each letter of Latin-1 gets a byte of its own that no lower-case name holds.
ONE_BYTE = "translate(normalized, 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')"
ENTS = rf"""{RUNS_SQL},
 ent AS (SELECT {ENTITY_ID} AS id, name, CASE length(name) % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Location' END AS label,
  count(DISTINCT doc_id) AS connections FROM runs GROUP BY name),
 m AS (SELECT {ENTITY_ID} AS src, doc_id AS dst FROM runs),
 norm AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '{TITLE_PATTERN}', ''), '[^\p{{L}}\p{{N}}_\s\-'']', '', 'g'), '\s+', ' ', 'g')) AS normalized,
  count(*) OVER (PARTITION BY label) AS n FROM ent),
 keyed AS (SELECT id, label, name, connections, normalized, {ONE_BYTE} AS letters, '' AS block FROM norm),
 scored AS MATERIALIZED (SELECT a.label, a.id AS id_a, b.id AS id_b, jaro_winkler_similarity(a.letters, b.letters) AS similarity
  FROM keyed a JOIN keyed b ON a.label = b.label AND a.block = b.block AND a.id < b.id WHERE a.normalized <> '' AND b.normalized <> ''
  AND jaro_winkler_similarity(a.letters, b.letters) >= 0.85),
 matched AS MATERIALIZED (SELECT * FROM scored s WHERE similarity >= 0.95 OR EXISTS (SELECT 1 FROM m x JOIN m y ON x.dst = y.dst WHERE x.src = s.id_a AND y.src = s.id_b))"""
# Transitive closure by repeatedly taking the smallest reachable id.
GROUPS = ENTS + """,
 und AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM matched UNION SELECT id_b, id_a FROM matched),
 reach(id, r) AS (SELECT id, id FROM ent UNION SELECT und.b, reach.r FROM reach JOIN und ON reach.id = und.a WHERE reach.r < und.b),
 grp AS MATERIALIZED (SELECT id, min(r) AS "group" FROM reach GROUP BY 1),
 canon AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY connections DESC, id) AS rn, count(*) OVER (PARTITION BY "group") AS members FROM ent JOIN grp USING (id)),
 best AS MATERIALIZED (SELECT "group", id AS canonical_id, name AS canonical_name, members FROM canon WHERE rn = 1 AND members > 1),
 moved AS MATERIALIZED (SELECT canon.id, best.canonical_id FROM canon JOIN best USING ("group") WHERE canon.id <> best.canonical_id)"""


def runs(spark, sf):
    def write(path):
        found = extraction.capitalized_runs(table(spark, sf, "documents"))
        found.withColumn("id", F.conv(F.substring(F.md5("name"), 1, 15), 16, 10).cast("bigint")).write.parquet(path)

    return spark.read.parquet(stored_once(spark, sf, "runs", write))


def text_mentions(spark, sf):
    return runs(spark, sf).select(F.col("id").alias("src"), F.col("doc_id").alias("dst"), F.lit("MENTIONED_IN").alias("type"), F.col("mention_count").alias("count"))


def entities(spark, sf):
    kind = F.element_at(F.array(F.lit("Person"), F.lit("Organization"), F.lit("Location")), F.length("name") % 3 + 1)
    return runs(spark, sf).groupBy("id", "name").agg(F.count("*").alias("connections")).withColumn("label", kind)


def keyed(spark, sf):
    return resolution.block_keys(entities(spark, sf))


@query("block_keys", f"WITH {ENTS} SELECT id, label, name, normalized, block FROM keyed")
def block_keys(spark, sf):
    return keyed(spark, sf).select("id", "label", "name", "normalized", "block")


@query(
    "block_keys_sorted",
    rf"""WITH {ENTS} SELECT id, label, name, trim(array_to_string(list_sort(string_split(normalized, ' ')), ' ')) AS normalized, '' AS block FROM norm""",
)
def block_keys_sorted(spark, sf):
    return resolution.block_keys(entities(spark, sf), sorted_words=True).select("id", "label", "name", "normalized", "block")


@query("score_pairs", f"WITH {ENTS} SELECT label, id_a, id_b, round(similarity, 6) AS similarity FROM scored")
def score_pairs(spark, sf):
    return resolution.score_pairs(keyed(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query(
    "jaro_winkler",
    "SELECT a.s_suppkey AS a, p_partkey AS b, round(jaro_winkler_similarity(s_name, p_name), 6) AS similarity FROM supplier a JOIN part ON a.s_suppkey = p_partkey",
)
def jaro_winkler_names(spark, sf):
    pairs = table(spark, sf, "supplier").join(table(spark, sf, "part"), F.col("s_suppkey") == F.col("p_partkey"))
    return pairs.select(F.col("s_suppkey").alias("a"), F.col("p_partkey").alias("b"), F.round(jaro_winkler("s_name", "p_name"), 6).alias("similarity"))


@query("match_pairs", f"WITH {ENTS} SELECT label, id_a, id_b, round(similarity, 6) AS similarity FROM matched")
def match_pairs(spark, sf):
    scored = resolution.score_pairs(keyed(spark, sf))
    return resolution.match_pairs(scored, text_mentions(spark, sf)).withColumn("similarity", F.round("similarity", 6))


def groups(spark, sf):
    links = resolution.match_links(keyed(spark, sf), text_mentions(spark, sf))
    return resolution.merge_groups(entities(spark, sf), links)


@query("merge_groups", f'WITH RECURSIVE {GROUPS} SELECT id, "group" FROM grp')
def merge_groups(spark, sf):
    return groups(spark, sf)


def known_groups(spark, sf):
    """The groups that the reports below build on, merged once."""
    return spark.read.parquet(stored_once(spark, sf, "groups", lambda path: groups(spark, sf).write.parquet(path)))


def canonical(spark, sf):
    e, grouped = entities(spark, sf), known_groups(spark, sf)
    return resolution.canonicalize(e.select("id", "name"), grouped, e.select("id", "connections"))


def mapping(spark, sf):
    return resolution.canonical_map(known_groups(spark, sf), canonical(spark, sf))


@query(
    "canonicalize",
    f"""WITH RECURSIVE {GROUPS} SELECT best."group", best.canonical_id, canonical_name, best.members,
 (SELECT string_agg(DISTINCT c.name, '|' ORDER BY c.name) FROM canon c WHERE c."group" = best."group" AND c.id <> best.canonical_id) AS aliases FROM best""",
)
def canonicalize(spark, sf):
    return canonical(spark, sf).withColumn("aliases", F.array_join("aliases", "|"))


@query(
    "rewrite_edges",
    f"""WITH RECURSIVE {GROUPS} SELECT coalesce(canonical_id, src) AS src, dst, max(mention_count) AS count FROM
 (SELECT {ENTITY_ID} AS src, doc_id AS dst, mention_count FROM runs) e LEFT JOIN moved ON moved.id = src GROUP BY 1, 2""",
)
def rewrite_edges(spark, sf):
    return resolution.rewrite_edges(text_mentions(spark, sf), mapping(spark, sf)).select("src", "dst", "count")


# Besides the mentions, every merged entity knows the smallest id of its label, which the simple rewrite drops.
@query(
    "rewrite_edges_simple",
    f"""WITH RECURSIVE {GROUPS}, e AS (SELECT {ENTITY_ID} AS src, doc_id AS dst, 'MENTIONED_IN' AS type, mention_count AS n FROM runs
  UNION ALL SELECT id, (SELECT min(id) FROM ent), 'CONNECTED_TO', 1 FROM ent WHERE id > (SELECT min(id) FROM ent))
 SELECT coalesce(a.canonical_id, src) AS src, dst, type, max(n) AS count FROM e LEFT JOIN moved a ON a.id = src LEFT JOIN moved b ON b.id = dst
 WHERE b.id IS NULL AND (a.id IS NULL OR type = 'MENTIONED_IN') AND coalesce(a.canonical_id, src) <> dst GROUP BY 1, 2, 3""",
)
def rewrite_edges_simple(spark, sf):
    ids = entities(spark, sf).select("id")
    low = ids.agg(F.min("id").alias("low")).scalar()
    known = ids.where(F.col("id") > low).select(F.col("id").alias("src"), low.alias("dst"), F.lit("CONNECTED_TO").alias("type"), F.lit(1).cast("bigint").alias("count"))
    return resolution.rewrite_edges(text_mentions(spark, sf).unionByName(known), mapping(spark, sf), simple=True)


@query(
    "resolution_report",
    f"""WITH RECURSIVE {GROUPS} SELECT label, count(*) AS original, count(moved.id) AS merged, count(*) - count(moved.id) AS remaining,
 round(100.0::DOUBLE * count(moved.id) / count(*), 1) AS reduction_pct FROM ent LEFT JOIN moved USING (id) GROUP BY 1""",
)
def resolution_report(spark, sf):
    return resolution.resolution_report(entities(spark, sf), mapping(spark, sf))


# Relational entities: every fourth name is already known, with stale aliases.
KNOWN = "known AS (SELECT id + 1 AS id, lower(label) AS entity_type, name AS canonical_name, 'stale' AS aliases FROM ent WHERE length(name) > 6)"


def known_entities(spark, sf):
    return entities(spark, sf).where(F.length("name") > 6).select(
        (F.col("id") + 1).alias("id"), F.lower("label").alias("entity_type"), F.col("name").alias("canonical_name"), F.array(F.lit("stale")).alias("aliases")
    )


@query(
    "sync_entities",
    f"""WITH {ENTS}, {KNOWN}, inc AS (SELECT id, lower(label) AS entity_type, name AS canonical_name, concat(name, '*') AS aliases FROM ent WHERE length(name) < 9)
 SELECT coalesce(k.id, i.id) AS id, coalesce(k.entity_type, i.entity_type) AS entity_type, coalesce(k.canonical_name, i.canonical_name) AS canonical_name,
  coalesce(i.aliases, k.aliases) AS aliases, CASE WHEN k.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' ELSE 'updated' END AS action
 FROM known k FULL OUTER JOIN inc i ON k.entity_type = i.entity_type AND k.canonical_name = i.canonical_name""",
)
def sync_entities(spark, sf):
    incoming = entities(spark, sf).where(F.length("name") < 9).select("id", "label", "name", F.array(F.concat("name", F.lit("*"))).alias("aliases"))
    return resolution.sync_entities(known_entities(spark, sf), incoming).withColumn("aliases", F.array_join("aliases", "|"))


def _sync(spark, sf):
    labelled = runs(spark, sf).join(entities(spark, sf).select("id", "label"), "id").select("label", "name", "doc_id", "mention_count")
    known = known_entities(spark, sf)
    old = runs(spark, sf).where(F.length("name") > 8).select("doc_id", (F.col("id") + 1).alias("entity_id"), F.lit(0).cast("bigint").alias("mention_count"))
    return resolution.sync_mentions(old, labelled, known)


@query(
    "sync_mentions",
    f"""WITH {ENTS}, {KNOWN} SELECT doc_id, known.id AS entity_id, mention_count FROM runs JOIN known ON name = canonical_name""",
)
def sync_mentions(spark, sf):
    return _sync(spark, sf)[0]


@query(
    "sync_mentions_skipped",
    f"""WITH {ENTS}, {KNOWN} SELECT count(*) FILTER (known.id IS NULL) AS skipped, count(known.id) AS upserted FROM runs LEFT JOIN known ON name = canonical_name""",
)
def sync_mentions_skipped(spark, sf):
    return _sync(spark, sf)[1]


# Entity-to-entity relations: memberships and co-mentions.
ENTITY_EDGES = f"{GRAPH}, {CO_MENTIONED}, ee AS (SELECT src, dst FROM edges WHERE type = 'MEMBER_OF' UNION ALL SELECT src, dst FROM co)"


def entity_nodes(spark, sf):
    return nodes(spark, sf).where(F.col("label").isin(graph.ENTITY_LABELS))


def entity_edges(spark, sf):
    def write(path):
        members(spark, sf).unionByName(graph.co_mentions(nodes(spark, sf), mentions(spark, sf))).write.parquet(path)

    return spark.read.parquet(stored_once(spark, sf, "projection", write))


RANKED = f"""{ENTITY_EDGES}, w AS MATERIALIZED (SELECT src AS a, dst AS b FROM ee UNION SELECT dst, src FROM ee),
 o AS MATERIALIZED (SELECT a, count(*) AS out FROM w GROUP BY 1), v AS (SELECT id FROM nodes WHERE label <> 'Document'),
 pr(it, id, rank) AS (SELECT 0, id, 0.15::DOUBLE FROM v UNION ALL
  SELECT it + 1, b, 0.15::DOUBLE + 0.85::DOUBLE * sum(rank / out) FROM pr JOIN w ON w.a = pr.id JOIN o ON o.a = pr.id WHERE it < 20 GROUP BY it, b),
 metrics AS (SELECT v.id, round(coalesce(rank, 0.15), 6) AS pagerank FROM v LEFT JOIN (SELECT * FROM pr WHERE it = 20) p ON v.id = p.id)"""


@query("pagerank", f"WITH RECURSIVE {RANKED} SELECT id, pagerank FROM metrics")
def pagerank(spark, sf):
    return algorithms.pagerank(entity_nodes(spark, sf), entity_edges(spark, sf)).withColumn("pagerank", F.round("pagerank", 6))


@query("communities")
def communities(spark, sf):
    return algorithms.communities(entity_nodes(spark, sf), entity_edges(spark, sf), weight=F.col("count"))


def _betweenness(levels: int = 6, samples: int = 1000) -> str:
    """All searches at once, level by level, and the dependencies back: the tables up to ``bt`` (id, betweenness)."""
    parts = [f"""wb AS MATERIALIZED (SELECT src AS a, dst AS b FROM ee WHERE src <> dst UNION SELECT dst, src FROM ee WHERE src <> dst),
 vb AS (SELECT id FROM nodes WHERE label <> 'Document'), l0 AS MATERIALIZED (SELECT id AS source, id, 1.0::DOUBLE AS paths FROM vb ORDER BY md5(id || '_42'), id LIMIT {samples})"""]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT source, id FROM l{j}" for j in range(max(0, i - 2), i))
        parts.append(f"""r{i} AS (SELECT source, b AS id, sum(paths) AS paths FROM l{i - 1} JOIN wb ON a = id GROUP BY 1, 2),
 l{i} AS MATERIALIZED (SELECT * FROM r{i} ANTI JOIN ({seen}) s USING (source, id))""")
    parts.append(f"d{levels} AS (SELECT *, 0.0::DOUBLE AS delta FROM l{levels})")
    for i in range(levels - 1, 0, -1):
        parts.append(f"""b{i} AS (SELECT source, b AS id, sum((1 + delta) / paths) AS share FROM d{i + 1} JOIN wb ON a = id GROUP BY 1, 2),
 d{i} AS MATERIALIZED (SELECT source, id, paths, paths * coalesce(share, 0) AS delta FROM l{i} LEFT JOIN b{i} USING (source, id))""")
    every = " UNION ALL ".join(f"SELECT id, delta FROM d{i}" for i in range(1, levels + 1))
    parts.append(f"bt AS (SELECT id, round(coalesce(b, 0) * 0.5, 6) AS betweenness FROM vb LEFT JOIN (SELECT id, sum(delta) AS b FROM ({every}) q GROUP BY 1) s USING (id))")
    return ", ".join(parts)


BETWEEN = _betweenness()


@query("betweenness", f"WITH {ENTITY_EDGES}, {BETWEEN} SELECT id, betweenness FROM bt")
def betweenness(spark, sf):
    return algorithms.betweenness(entity_nodes(spark, sf), entity_edges(spark, sf)).withColumn("betweenness", F.round("betweenness", 6))


COMPONENTS = """v AS (SELECT doc_id * 2 AS id, md5(text) AS h, source FROM documents),
 e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.h = b.h AND a.id <> b.id),
 r(id, root) AS (SELECT id, id FROM v UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
 comp AS (SELECT id, min(root) AS component FROM r GROUP BY 1)"""


@query("connected_components", f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM comp")
def connected_components(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") * 2).alias("id"), F.md5("text").alias("h"))
    first = d.groupBy("h").agg(F.min("id").alias("dst"))
    links = d.join(first, "h").where("id <> dst").select(F.col("id").alias("src"), "dst")
    return algorithms.connected_components(d, links)


def metrics(spark, sf):
    """(id, pagerank, community, betweenness, connections) of the projection, computed once."""
    def write(path):
        n, e = entity_nodes(spark, sf), entity_edges(spark, sf)
        both = e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("connections"))
        whole = algorithms.node_metrics(n.select("id"), pagerank(spark, sf), communities(spark, sf), betweenness(spark, sf))
        whole.join(both, "id", "left").fillna(0, ["connections"]).write.parquet(path)

    return spark.read.parquet(stored_once(spark, sf, "metrics", write))


@query("rank_by", f"WITH RECURSIVE {RANKED} SELECT id, pagerank FROM metrics ORDER BY pagerank DESC, id LIMIT 25")
def rank_by(spark, sf):
    return algorithms.rank_by(metrics(spark, sf), "pagerank").select("id", "pagerank")


@query("rank_by_betweenness", f"WITH {ENTITY_EDGES}, {BETWEEN} SELECT id, betweenness FROM bt ORDER BY betweenness DESC, id LIMIT 25")
def rank_by_betweenness(spark, sf):
    return algorithms.rank_by(metrics(spark, sf), "betweenness").select("id", "betweenness")


@query(
    "score_scale",
    f"""WITH RECURSIVE {RANKED}, {BETWEEN}, ends AS (SELECT src AS id FROM ee UNION ALL SELECT dst FROM ee), deg AS (SELECT id, count(*) AS connections FROM ends GROUP BY 1),
 m AS (SELECT id, pagerank, betweenness, coalesce(connections, 0) AS connections FROM metrics JOIN bt USING (id) LEFT JOIN deg USING (id))
 SELECT id, round(CASE WHEN pagerank IS NOT NULL THEN 20.0 + 40.0 * greatest(0, least(1, pagerank / (SELECT greatest(max(pagerank), 0.001) FROM m))) ELSE greatest(20.0, least(60.0, 20.0 + connections * 2.0)) END::DOUBLE, 6) AS size,
  betweenness >= 0.7 * (SELECT greatest(max(betweenness), 0.001) FROM m) AS is_bridge, round(100.0 * pagerank / (SELECT greatest(max(pagerank), 0.001) FROM m), 6) AS bar_pct FROM m""",
)
def score_scale(spark, sf):
    return graph.score_scale(metrics(spark, sf))


@query("community_sizes")
def community_sizes(spark, sf):
    return algorithms.community_sizes(metrics(spark, sf))


@query("component_sizes", f"WITH RECURSIVE {COMPONENTS} SELECT component AS community, count(*) AS size FROM comp GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def component_sizes(spark, sf):
    """The same report on the components of equal documents, which SQL can tell."""
    return algorithms.community_sizes(connected_components(spark, sf).withColumnRenamed("component", "community"))


@query("algorithm_status", f"WITH RECURSIVE {RANKED} SELECT count(pagerank) AS node_count, timestamp '2024-02-01 00:00:00' AS last_computed FROM metrics")
def algorithm_status(spark, sf):
    return algorithms.algorithm_status(metrics(spark, sf), F.expr("timestamp '2024-02-01 00:00:00'"))
