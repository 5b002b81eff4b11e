"""Entity-graph construction, lookup and walks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgraph.operators import graph, walks
from workload.graph_standins import (
    CO_MENTIONED, EVENTS_SQL, GRAPH, LINKS_SQL, WAYS, edges, links, mentions, nodes, timeline_events,
)
from workload.registry import query, stored_once, table

ONE = "Supplier#000000001"
TWO = "Supplier#000000002"

# Entity lists per document: its words 1-3 are people, 4-5 organizations, the language a location.
WORDS = """de AS (SELECT doc_id, list_slice(string_split(text, ' '), 1, 3) AS people, list_slice(string_split(text, ' '), 4, 5) AS organizations, [lang, ' ' || source || ' '] AS locations FROM documents)"""
TAGGED = r"""men AS (SELECT DISTINCT doc_id, label, regexp_replace(name, '^\s+|\s+$', '', 'g') AS name FROM (
 SELECT doc_id, 'Person' AS label, unnest(people) AS name FROM de UNION ALL SELECT doc_id, 'Organization', unnest(organizations) FROM de
 UNION ALL SELECT doc_id, 'Location', unnest(locations) FROM de) q WHERE length(regexp_replace(name, '^\s+|\s+$', '', 'g')) BETWEEN 3 AND 99)"""
HASH = "CAST(('0x' || substr(md5({} || '|' || {}), 1, 15)) AS BIGINT)"


def doc_entities(spark, sf):
    w = F.split("text", " ")
    return table(spark, sf, "documents").select(
        "doc_id", F.slice(w, 1, 3).alias("people"), F.slice(w, 4, 2).alias("organizations"),
        F.array("lang", F.concat(F.lit(" "), F.col("source"), F.lit(" "))).alias("locations"),
    )


@query(
    "build_graph_nodes",
    f"""WITH {WORDS}, {TAGGED} SELECT DISTINCT {HASH.format('label', 'name')} AS id, label, name FROM men
 UNION ALL SELECT {HASH.format("'Document'", 'doc_id')} AS id, 'Document', CAST(doc_id AS VARCHAR) FROM documents""",
)
def build_graph_nodes(spark, sf):
    return graph.build_graph(doc_entities(spark, sf))[0]


@query(
    "build_graph_edges",
    f"""WITH {WORDS}, {TAGGED} SELECT {HASH.format('label', 'name')} AS src, {HASH.format("'Document'", 'doc_id')} AS dst, 'MENTIONED_IN' AS type, 1::BIGINT AS count FROM men""",
)
def build_graph_edges(spark, sf):
    return graph.build_graph(doc_entities(spark, sf))[1]


@query("co_mentions", f"WITH {GRAPH}, {CO_MENTIONED} SELECT src, dst, type, count FROM co")
def co_mentions(spark, sf):
    return graph.co_mentions(nodes(spark, sf), mentions(spark, sf))


DEGREE = "deg AS (SELECT n.id, n.label, n.name, count(w.node) AS connections FROM nodes n LEFT JOIN ways w ON n.id = w.node GROUP BY 1, 2, 3)"


@query("degree", f"WITH {GRAPH}, {WAYS}, {DEGREE} SELECT id, label, name, connections FROM deg")
def degree(spark, sf):
    return graph.degree(nodes(spark, sf), edges(spark, sf))


@query(
    "list_entities",
    f"WITH {GRAPH}, {WAYS}, {DEGREE} SELECT id, label, name, connections FROM deg WHERE label = 'Organization' ORDER BY connections DESC, id LIMIT 25 OFFSET 25",
)
def list_entities(spark, sf):
    return graph.list_entities(nodes(spark, sf), edges(spark, sf), "Organization", 25, 25)


@query(
    "find_entities",
    f"WITH {GRAPH}, {WAYS}, {DEGREE} SELECT id, label, name, connections FROM deg WHERE label <> 'Document' AND contains(lower(name), 'red r') ORDER BY connections DESC, id LIMIT 20",
)
def find_entities(spark, sf):
    return graph.find_entities(nodes(spark, sf), edges(spark, sf), "Red R")


@query(
    "neighbors",
    f"""WITH {GRAPH}, {WAYS}, f AS (SELECT other, type, outgoing FROM ways WHERE node = 5 ORDER BY other, type, outgoing LIMIT 50)
 SELECT id, label, name, type, outgoing FROM f JOIN nodes ON id = other""",
)
def neighbors(spark, sf):
    return graph.neighbors(nodes(spark, sf), edges(spark, sf), 5)


@query(
    "neighbors_by_type",
    f"""WITH {GRAPH}, {WAYS}, n AS (SELECT DISTINCT w.type, id, name FROM ways w JOIN nodes ON id = other WHERE node = 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY name, id) AS rn FROM n)
 SELECT type, count(*) AS size, array_to_string(list(name ORDER BY rn) FILTER (rn <= 10), '|') AS shown, count(*) - least(count(*), 10) AS remaining FROM r GROUP BY 1""",
)
def neighbors_by_type(spark, sf):
    out = graph.neighbors_by_type(nodes(spark, sf), edges(spark, sf), 5)
    return out.select("type", "size", F.array_join("shown", "|").alias("shown"), "remaining")


def adjacency(spark, sf):
    return stored_once(spark, sf, "adjacency", lambda path: walks.write_adjacency(edges(spark, sf), path))


def cooc_sql(name, k):
    return f"""(SELECT e.src AS id, count(DISTINCT e.dst) AS shared_docs FROM edges s JOIN edges e ON s.dst = e.dst AND s.type = 'MENTIONED_IN' AND e.type = 'MENTIONED_IN' AND s.src <> e.src
  WHERE s.src IN (SELECT id FROM nodes WHERE label <> 'Document' AND contains(lower(name), '{name.lower()}')) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k})"""


@query("co_occurring", f"WITH {GRAPH} SELECT id, label, name, shared_docs FROM {cooc_sql(ONE, 20)} c JOIN nodes USING (id)")
def co_occurring(spark, sf):
    return graph.co_occurring(nodes(spark, sf), mentions(spark, sf), ONE)


@query(
    "co_occurring_samples",
    f"""WITH {GRAPH}, c AS {cooc_sql('red r', 10)}, d AS (SELECT DISTINCT e.src AS id, e.dst FROM edges s JOIN edges e ON s.dst = e.dst AND s.type = 'MENTIONED_IN' AND e.type = 'MENTIONED_IN' AND s.src <> e.src
  WHERE s.src IN (SELECT id FROM nodes WHERE label <> 'Document' AND contains(lower(name), 'red r'))),
 x AS (SELECT id, dst, row_number() OVER (PARTITION BY id ORDER BY dst) AS rn FROM d)
 SELECT id, label, name, shared_docs, (SELECT string_agg(dst, ',' ORDER BY dst) FROM x WHERE x.id = c.id AND rn <= 5) AS sample_docs FROM c JOIN nodes USING (id)""",
)
def co_occurring_samples(spark, sf):
    out = graph.co_occurring(nodes(spark, sf), mentions(spark, sf), "Red R", 10, samples=5)
    return out.withColumn("sample_docs", F.array_join(F.col("sample_docs").cast("array<string>"), ","))


@query(
    "shared_connections",
    f"WITH {GRAPH} SELECT name FROM {cooc_sql(ONE, 40)} a JOIN nodes USING (id) INTERSECT SELECT name FROM {cooc_sql(TWO, 40)} b JOIN nodes USING (id)",
)
def shared_connections(spark, sf):
    return graph.shared_connections(nodes(spark, sf), mentions(spark, sf), ONE, TWO, 40)


@query(
    "hidden_connections",
    f"""WITH {GRAPH}, o AS (SELECT DISTINCT src, dst FROM edges WHERE src % 4 = 1),
 p AS (SELECT x.src AS a, y.src AS b, count(*) AS n FROM o x JOIN o y ON x.dst = y.dst AND x.src < y.src GROUP BY 1, 2 HAVING count(*) >= 3),
 t AS (SELECT * FROM p ORDER BY n DESC, a, b LIMIT 20),
 s AS (SELECT a, b, x.dst, row_number() OVER (PARTITION BY a, b ORDER BY x.dst) AS rn FROM t JOIN o x ON x.src = a JOIN o y ON y.src = b AND y.dst = x.dst)
 SELECT a, na.name AS a_name, b, nb.name AS b_name, n AS shared_count, (SELECT string_agg(dst, ',' ORDER BY dst) FROM s WHERE s.a = t.a AND s.b = t.b AND rn <= 10) AS top_shared
 FROM t JOIN nodes na ON na.id = a JOIN nodes nb ON nb.id = b""",
)
def hidden_connections(spark, sf):
    out = graph.hidden_connections(nodes(spark, sf), edges(spark, sf))
    return out.withColumn("top_shared", F.array_join(F.col("top_shared").cast("array<string>"), ","))


@query(
    "hubs",
    f"WITH {GRAPH} SELECT src AS id, name, count(DISTINCT dst) AS doc_count FROM edges JOIN nodes ON src = id WHERE type = 'MENTIONED_IN' AND label = 'Person' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20",
)
def hubs(spark, sf):
    return graph.hubs(nodes(spark, sf), mentions(spark, sf))


@query(
    "top_connected",
    f"""WITH {GRAPH}, {CO_MENTIONED}, b AS (SELECT src AS id, count FROM co UNION ALL SELECT dst, count FROM co)
 SELECT id, name, CAST(sum(count) AS BIGINT) AS total, count(*) AS partners FROM b JOIN nodes USING (id) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20""",
)
def top_connected(spark, sf):
    return graph.top_connected(nodes(spark, sf), co_mentions(spark, sf))


@query(
    "entity_doc_count",
    f"WITH {GRAPH} SELECT count(DISTINCT dst) AS doc_count FROM edges JOIN nodes ON src = id WHERE type = 'MENTIONED_IN' AND contains(lower(name), 'red r')",
)
def entity_doc_count(spark, sf):
    return graph.entity_doc_count(nodes(spark, sf), mentions(spark, sf), "Red R")


@query(
    "docs_with_most_entities",
    f"WITH {GRAPH} SELECT id, name, count(DISTINCT src) AS entities FROM edges JOIN nodes ON dst = id WHERE type = 'MENTIONED_IN' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20",
)
def docs_with_most_entities(spark, sf):
    return graph.docs_with_most_entities(nodes(spark, sf), mentions(spark, sf))


@query(
    "document_people",
    f"WITH {GRAPH} SELECT DISTINCT p.id, p.name FROM edges JOIN nodes d ON dst = d.id AND d.name = 'order_7' JOIN nodes p ON src = p.id AND p.label = 'Person' WHERE type = 'MENTIONED_IN'",
)
def document_people(spark, sf):
    return graph.document_people(nodes(spark, sf), mentions(spark, sf), "order_7")


@query(
    "document_entities",
    f"WITH {GRAPH} SELECT dst AS doc, label, count(*) AS entities, CAST(sum(count) AS BIGINT) AS mentions FROM edges JOIN nodes ON src = id WHERE type = 'MENTIONED_IN' GROUP BY 1, 2",
)
def document_entities(spark, sf):
    return graph.document_entities(nodes(spark, sf), mentions(spark, sf))


@query(
    "graph_stats",
    f"WITH {GRAPH} SELECT 'node' AS kind, label AS name, count(*) AS count FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY 2",
)
def graph_stats(spark, sf):
    return graph.graph_stats(nodes(spark, sf), edges(spark, sf))


@query("restrict_types", f"WITH {GRAPH} SELECT src, dst, type, count FROM edges WHERE type = 'MEMBER_OF'")
def restrict_types(spark, sf):
    return graph.restrict_types(edges(spark, sf), ["MEMBER_OF", "DROP TABLE"])


@query("restrict_labels", f"WITH {GRAPH} SELECT id, label, name FROM nodes WHERE label IN ('Person', 'Location')")
def restrict_labels(spark, sf):
    return graph.restrict_labels(nodes(spark, sf), ["Person", "Location", "Secret"]).select("id", "label", "name")


@query(
    "expand_subgraph",
    f"""WITH {GRAPH}, {WAYS} SELECT DISTINCT id, label, name FROM nodes WHERE id IN (SELECT other FROM ways WHERE node IN (5, 9))""",
)
def expand_subgraph(spark, sf):
    n, e = nodes(spark, sf), edges(spark, sf)
    near = [graph.neighbors(n, e, i, 1_000_000).select("id", "label", "name") for i in (5, 9)]
    return graph.expand_subgraph(near[0], near[1])


TIMED = f"links AS ({LINKS_SQL}), ev AS ({EVENTS_SQL}), t AS (SELECT DISTINCT src AS entity, ev.id, date, description, ev.type FROM links JOIN ev ON dst = ev.id WHERE links.type <> 'OTHER')"


@query("timeline", f"WITH {TIMED} SELECT entity, id, date, description, type FROM t WHERE entity = 3 ORDER BY date, id LIMIT 50")
def timeline(spark, sf):
    return graph.timeline(links(spark, sf), timeline_events(spark, sf), 3)


@query(
    "timelines",
    f"WITH {TIMED} SELECT entity, id, date, description, type FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, id) AS rn FROM t) q WHERE rn <= 50",
)
def timelines(spark, sf):
    return graph.timeline(links(spark, sf), timeline_events(spark, sf))


# Notes: one per order, about the supplier whose key its customer key hits.
NOTES_SQL = "SELECT o_orderkey AS id, (o_custkey % (SELECT count(*) FROM supplier)) * 4 + 1 AS entity_id, o_orderpriority AS content, o_orderdate AS created_at FROM orders"


@query(
    "entity_profile",
    f"""WITH {GRAPH}, {WAYS}, {TIMED}, notes AS ({NOTES_SQL}), who AS (SELECT id FROM nodes WHERE label IN ('Person', 'Location')),
 m AS (SELECT DISTINCT src AS id, dst AS doc FROM edges WHERE type = 'MENTIONED_IN'),
 p AS (SELECT m.id, o.id AS partner, count(*) AS shared FROM m JOIN m o ON m.doc = o.doc AND m.id <> o.id WHERE m.id IN (SELECT id FROM who) GROUP BY 1, 2),
 pr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, partner) AS rn FROM p),
 mr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY doc) AS rn FROM m WHERE id IN (SELECT id FROM who)),
 nr AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, id DESC) AS rn FROM notes),
 tl AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date, id) AS rn FROM t),
 docs AS (SELECT mr.id, string_agg(doc || ' ' || name, ',' ORDER BY rn) AS l FROM mr JOIN nodes ON nodes.id = doc WHERE rn <= 50 GROUP BY 1),
 mates AS (SELECT pr.id, string_agg(partner || ' ' || name || ' ' || label || ' ' || shared, ',' ORDER BY rn) AS l FROM pr JOIN nodes ON nodes.id = partner WHERE rn <= 20 GROUP BY 1),
 told AS (SELECT entity_id AS id, string_agg(content, ',' ORDER BY rn) AS l FROM nr WHERE rn <= 20 GROUP BY 1),
 days AS (SELECT entity AS id, string_agg(date || ' ' || type || ' ' || description, ',' ORDER BY rn) AS l FROM tl WHERE rn <= 50 GROUP BY 1)
 SELECT n.id, label, name, (SELECT count(*) FROM ways WHERE node = n.id) AS connections, (SELECT count(*) FROM m WHERE m.id = n.id) AS documents,
  docs.l AS documents_listed, mates.l AS partners, (SELECT count(*) FROM notes WHERE entity_id = n.id) AS notes, told.l AS note_texts,
  (SELECT count(*) FROM tl WHERE entity = n.id) AS events, (SELECT min(date) FROM tl WHERE entity = n.id) AS first_date,
  (SELECT max(date) FROM tl WHERE entity = n.id) AS last_date, days.l AS timeline
 FROM nodes n LEFT JOIN docs USING (id) LEFT JOIN mates USING (id) LEFT JOIN told USING (id) LEFT JOIN days USING (id) WHERE n.id IN (SELECT id FROM who)""",
)
def entity_profile(spark, sf):
    n = nodes(spark, sf)
    suppliers = table(spark, sf, "supplier").agg(F.count("*").alias("n")).scalar()
    notes = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), ((F.col("o_custkey") % suppliers) * 4 + 1).alias("entity_id"),
        F.col("o_orderpriority").alias("content"), F.col("o_orderdate").alias("created_at"),
    )
    out = graph.entity_profile(
        n.where("label IN ('Person', 'Location')"), n, edges(spark, sf), notes, links(spark, sf), timeline_events(spark, sf)
    )
    line = lambda c, *parts: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", *[x[p].cast("string") for p in parts])), ",")
    return out.select(
        "id", "label", "name", "connections", "documents",
        line(F.arrays_zip("document_ids", "document_names"), "document_ids", "document_names").alias("documents_listed"),
        line(F.col("partners"), "id", "name", "label", "shared").alias("partners"), "notes", F.array_join("note_texts", ",").alias("note_texts"),
        "events", "first_date", "last_date", line(F.col("timeline"), "date", "type", "description").alias("timeline"),
    )


@query(
    "traverse",
    f"""WITH RECURSIVE {GRAPH}, {WAYS}, b(id, d) AS (SELECT id, 0 FROM nodes WHERE name = '{ONE}' UNION SELECT other, d + 1 FROM b JOIN ways ON node = b.id WHERE d < 2)
 SELECT id, name, label, distance FROM (SELECT id, CAST(min(d) AS INT) AS distance FROM b GROUP BY 1) q JOIN nodes USING (id) WHERE distance > 0 ORDER BY distance, name, id LIMIT 500""",
)
def traverse(spark, sf):
    return walks.traverse(nodes(spark, sf), None, ONE, depth=2, limit=500, stored=adjacency(spark, sf))


@query(
    "traverse_by_type",
    f"""WITH RECURSIVE {GRAPH}, {WAYS}, b(id, d) AS (SELECT id, 0 FROM nodes WHERE name = 'NATION_1' UNION SELECT other, d + 1 FROM b JOIN ways ON node = b.id WHERE d < 3 AND type = 'MENTIONED_IN')
 SELECT id, distance FROM (SELECT id, CAST(min(d) AS INT) AS distance FROM b GROUP BY 1) q""",
)
def traverse_by_type(spark, sf):
    starts = nodes(spark, sf).where("name = 'NATION_1'").select("id")
    return walks.hop_levels(None, starts, 3, ["MENTIONED_IN"], adjacency(spark, sf)).select("id", "distance")


def path_sql(a: int, b: int, most: int = 6) -> str:
    """Levels with their smallest parents, then the chain back from the target."""
    parts = [f"l0 AS (SELECT {a}::BIGINT AS id, NULL::BIGINT AS parent)"]
    for i in range(1, most + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(i))
        stop = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{j} WHERE id = {b})" for j in range(i))
        parts.append(
            f"l{i} AS MATERIALIZED (SELECT other AS id, min(node) AS parent FROM w JOIN l{i-1} ON node = id WHERE other NOT IN ({seen}) AND {stop} GROUP BY 1)"
        )
    levels = " UNION ALL ".join(f"SELECT {i} AS step, id, parent FROM l{i}" for i in range(most + 1))
    return f"""WITH RECURSIVE {GRAPH}, {WAYS}, w AS MATERIALIZED (SELECT DISTINCT node, other FROM ways WHERE type = 'MENTIONED_IN'), {', '.join(parts)}, lv AS MATERIALIZED ({levels}),
 c AS (SELECT step, id, parent FROM lv WHERE id = {b} UNION ALL SELECT lv.step, lv.id, lv.parent FROM c JOIN lv ON lv.id = c.parent)
 SELECT CAST(step AS INT) AS step, id, CASE WHEN step > 0 THEN 'MENTIONED_IN' END AS type FROM c"""


@query("shortest_path", path_sql(3, 7))
def shortest_path(spark, sf):
    return walks.shortest_path(None, 3, 7, types=["MENTIONED_IN"], stored=adjacency(spark, sf), spark=spark)


@query(
    "shortest_path_length",
    f"""WITH RECURSIVE {GRAPH}, {WAYS}, b(id, d) AS (SELECT 5::BIGINT, 0 UNION SELECT other, d + 1 FROM b JOIN ways ON node = b.id WHERE d < 3)
 SELECT CAST(min(d) AS INT) AS length FROM b WHERE id = 9""",
)
def shortest_path_length(spark, sf):
    return walks.shortest_path(None, 5, 9, stored=adjacency(spark, sf), spark=spark).agg(F.max("step").alias("length"))


@query(
    "paths",
    f"""WITH {GRAPH}, {WAYS}, o AS (SELECT min(id) AS id FROM nodes WHERE contains(lower(name), 'order_11')),
 p1 AS (SELECT [o.id, other] AS ids, [type] AS rel_types, other AS tip, [(least(node, other), greatest(node, other), type)] AS used FROM o JOIN ways ON node = o.id),
 p2 AS (SELECT list_append(ids, other) AS ids, list_append(rel_types, type) AS rel_types, other AS tip FROM p1 JOIN ways ON node = tip
  WHERE NOT list_contains(used, (least(node, other), greatest(node, other), type)))
 SELECT tip AS id, name, label, array_to_string(ids, '>') AS ids, array_to_string(rel_types, '>') AS rel_types FROM (
  SELECT ids, rel_types, tip FROM (SELECT ids, rel_types, tip FROM p1 UNION ALL SELECT ids, rel_types, tip FROM p2) u ORDER BY len(ids), ids, rel_types LIMIT 50) q JOIN nodes ON id = tip""",
)
def paths(spark, sf):
    out = walks.paths(nodes(spark, sf), edges(spark, sf), "order_11", depth=2, limit=50)
    return out.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ">")).withColumn("rel_types", F.array_join("rel_types", ">"))
