"""The entity graph as two tables, and the queries over it.

``nodes`` is (id, label, name, aliases) and ``edges`` is (src, dst, type,
count).  MENTIONED_IN edges run from an entity to a Document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions.text import strip
from corpusgraph.session import broadcast_if_small, spread, written

MENTIONED = "MENTIONED_IN"
#: Memberships that a task compares in pairs, on average.
PAIR_ROWS = 100_000

# The relationship types and node labels a caller may ask for.
RELATION_TYPES = [
    "MENTIONED_IN",
    "CONNECTED_TO",
    "ASSOCIATED_WITH",
    "WORKS_FOR",
    "LOCATED_IN",
    "RELATED_TO",
    "APPEARED_WITH",
    "EMPLOYED_BY",
    "OWNS",
    "MEMBER_OF",
]
ENTITY_LABELS = ["Person", "Organization", "Location"]
NODE_LABELS = [*ENTITY_LABELS, "Document", "Event"]


def node_id(label: Column, name: Column) -> Column:
    """60-bit id of a (label, name) pair."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", label, name)), 1, 15), 16, 10).cast("bigint")


def build_graph(doc_entities: DataFrame, shortest: int = 3, longest: int = 99) -> tuple[DataFrame, DataFrame]:
    """Nodes and MENTIONED_IN edges from (doc_id, people, organizations, locations).

    Names are trimmed and length-filtered; a node is unique per label and name,
    an edge per entity and document.
    """
    kinds = [("people", "Person"), ("organizations", "Organization"), ("locations", "Location")]
    tagged = F.concat(
        *[
            F.transform(F.coalesce(column, F.array().cast("array<string>")), _tag(label))
            for column, label in kinds
        ]
    )
    mentions = (
        doc_entities.select("doc_id", F.inline(tagged))
        .where(F.length("name").between(shortest, longest))
        .distinct()
        .withColumn("id", node_id(F.col("label"), F.col("name")))
    )
    document = F.col("doc_id").cast("string")
    nodes = mentions.select("id", "label", "name").distinct().unionByName(
        doc_entities.select(node_id(F.lit("Document"), document).alias("id"), F.lit("Document").alias("label"), document.alias("name")).distinct()
    )
    edges = mentions.select(
        F.col("id").alias("src"), node_id(F.lit("Document"), document).alias("dst"), F.lit(MENTIONED).alias("type"), F.lit(1).cast("bigint").alias("count")
    )
    return nodes, edges


def _tag(label: str):
    return lambda name: F.struct(F.lit(label).alias("label"), strip(name).alias("name"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge seen from each of its ends: (node, other, type, count, outgoing)."""
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("outgoing")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("outgoing")),
    )
    # A self loop has one end.
    ends = F.when(F.col("src") == F.col("dst"), F.slice(ends, 1, 1)).otherwise(ends)
    return edges.select("type", "count", F.inline(ends))


def shared_pairs(memberships: DataFrame, block: int = 1000, unique: bool = False, parts: int = 0) -> DataFrame:
    """(a, b, count) of members that share groups, from (grp, member).

    The result holds one row per pair by definition.  A group with more than
    ``block`` members is cut into hash blocks and each pair of blocks becomes
    its own join key, so no key ever carries more than about ``block``² pairs.
    ``unique`` says that no row is repeated; ``parts`` is the least number of
    tasks that compare.
    """
    rows = memberships if unique else memberships.distinct()
    hot = rows.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    # Hot groups are few: each has over ``block`` rows.  Broadcast, they do not meet their rows in one task.
    cut = rows.join(broadcast_if_small(hot), "grp", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    cut = cut.withColumn("mine", F.pmod(F.xxhash64("member"), "parts").cast("int"))
    low = cut.select("grp", F.col("mine").alias("lo"), F.explode(F.sequence("mine", F.col("parts") - 1)).alias("hi"), F.col("member").alias("m1"))
    high = cut.select("grp", F.explode(F.sequence(F.lit(0), "mine")).alias("lo"), F.col("mine").alias("hi"), F.col("member").alias("m2"))
    key = ["grp", "lo", "hi"]
    pairs = spread(low, *key, least=parts).join(spread(high, *key, least=parts), key).where((F.col("lo") < F.col("hi")) | (F.col("m1") < F.col("m2")))
    return pairs.groupBy(F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")).agg(F.count("*").alias("count"))


def co_mentions(nodes: DataFrame, edges: DataFrame, label: str = "Person", block: int = 1000) -> DataFrame:
    """CO_MENTIONED edges between entities of a label with the number of shared documents."""
    people = nodes.where(F.col("label") == label).select(F.col("id").alias("src"))
    mentions = edges.where(F.col("type") == MENTIONED).join(people, "src", "left_semi")
    pairs = shared_pairs(mentions.select(F.col("dst").alias("grp"), F.col("src").alias("member")), block)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CO_MENTIONED").alias("type"), "count")


def degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Undirected relationship count of every node, 0 when isolated."""
    counts = both_ways(edges).groupBy(F.col("node").alias("id")).agg(F.count("*").alias("connections"))
    return nodes.join(counts, "id", "left").withColumn("connections", F.coalesce("connections", F.lit(0).cast("bigint")))


def list_entities(nodes: DataFrame, edges: DataFrame, label: str | None = None, offset: int = 0, limit: int = 25) -> DataFrame:
    """Entities by degree, most connected first."""
    kept = nodes.where(F.col("label") == label) if label else nodes.where(F.col("label").isin(ENTITY_LABELS))
    return degree(kept, edges).orderBy(F.desc("connections"), "id").offset(offset).limit(limit)


def name_contains(name: str) -> Column:
    """Case-insensitive literal containment in the node name."""
    return F.contains(F.lower("name"), F.lit(name.lower()))


def find_entities(nodes: DataFrame, edges: DataFrame, name: str, label: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name contains ``name``, most connected first."""
    return list_entities(nodes.where(name_contains(name)), edges, label, 0, limit)


def neighbors(nodes: DataFrame, edges: DataFrame, node, limit: int = 50) -> DataFrame:
    """Adjacent nodes of one node with the edge that leads there."""
    near = both_ways(edges.where((F.col("src") == node) | (F.col("dst") == node))).where(F.col("node") == node)
    first = near.orderBy("other", "type", "outgoing").limit(limit)
    return nodes.join(F.broadcast(first), nodes["id"] == first["other"]).select("id", "label", "name", "type", "outgoing")


def top_names(rows: DataFrame, group: str, order: list, value: str, k: int) -> DataFrame:
    """Per group the first ``k`` values as an array; ranking keeps only ``k`` rows per task."""
    w = Window.partitionBy(group).orderBy(*order)
    return (
        rows.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= k)
        .groupBy(group)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", F.col(value).alias("_v")))), lambda s: s["_v"]).alias("shown"))
    )


def neighbors_by_type(nodes: DataFrame, edges: DataFrame, node, shown: int = 10) -> DataFrame:
    """Neighbours grouped by relationship: size, first names, how many are left out."""
    near = (
        both_ways(edges.where((F.col("src") == node) | (F.col("dst") == node)))
        .where(F.col("node") == node)
        .select(F.col("other").alias("id"), "type")
        .distinct()
        .join(nodes.select("id", "name"), "id")
    )
    sizes = near.groupBy("type").agg(F.count("*").alias("size"))
    names = top_names(near, "type", ["name", "id"], "name", shown)
    return sizes.join(names, "type").withColumn("remaining", F.col("size") - F.size("shown")).orderBy(F.desc("size"), "type")


def _start_documents(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Documents of the entities whose name matches, with how many of them and one of them."""
    starts = nodes.where(F.col("label").isin(ENTITY_LABELS) & name_contains(name)).select(F.col("id").alias("src"))
    docs = edges.where(F.col("type") == MENTIONED).join(starts, "src", "left_semi")
    return docs.groupBy("dst").agg(F.countDistinct("src").alias("starts"), F.min("src").alias("a_start"))


def co_occurrence_counts(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(id, shared_docs) for every entity that shares a document with the named one."""
    docs = _start_documents(nodes, edges, name)
    mentions = edges.where(F.col("type") == MENTIONED).select("src", "dst").distinct()
    other = (F.col("starts") > 1) | (F.col("src") != F.col("a_start"))
    return mentions.join(docs, "dst").where(other).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("shared_docs"))


def co_occurring(nodes: DataFrame, edges: DataFrame, name: str, k: int = 20, samples: int = 0) -> DataFrame:
    """The ``k`` entities most often in the same documents, optionally with sample documents."""
    top = co_occurrence_counts(nodes, edges, name).orderBy(F.desc("shared_docs"), "id").limit(k)
    named = nodes.select("id", "label", "name").join(F.broadcast(top), "id")
    if samples:
        docs = _start_documents(nodes, edges, name)
        mentions = edges.where(F.col("type") == MENTIONED).select(F.col("src").alias("id"), "dst").distinct()
        hits = mentions.join(F.broadcast(top.select("id")), "id").join(docs, "dst")
        hits = hits.where((F.col("starts") > 1) | (F.col("id") != F.col("a_start")))
        named = named.join(top_names(hits, "id", ["dst"], "dst", samples), "id").withColumnRenamed("shown", "sample_docs")
    return named.orderBy(F.desc("shared_docs"), "id")


def shared_connections(nodes: DataFrame, edges: DataFrame, a: str, b: str, k: int = 20) -> DataFrame:
    """Names in both entities' co-mention lists of ``k``."""
    return co_occurring(nodes, edges, a, k).select("name").intersect(co_occurring(nodes, edges, b, k).select("name"))


def frequent_pairs(memberships: DataFrame, minimum: int, most: int, without: DataFrame | None = None, block: int = 1000,
                   unique: bool = False) -> DataFrame:
    """The ``most`` pairs (a, b, count) of members that share the most groups, ``minimum`` at least; ties by a, b.

    ``memberships`` is (grp, member); pairs in ``without`` (a, b) do not count.
    A member's ``minimum - 1`` largest groups are its tail.  Two members that
    share ``minimum`` groups share one outside both tails, so only the other
    groups are joined and the largest groups, where most pairs would come from,
    rarely make one.  The counts so far bound what a pair can reach; only pairs
    that can still be among the first are looked up in the tails.  ``unique``
    says that the memberships are stored and none is repeated.
    """
    rows = memberships if unique else written(memberships.distinct())
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1")
    enough = rows.join(broadcast_if_small(sizes), "grp").join(rows.groupBy("member").agg(F.count("*").alias("of")).where(F.col("of") >= minimum).select("member"), "member", "left_semi")
    enough = written(enough)
    if minimum > 1:
        # A rank filter that Spark applies in each task before the shuffle.
        last = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("n"), F.desc("grp")))
        tails = written(enough.withColumn("r", last).where(F.col("r") < minimum).select("member", "grp"))
        heads = enough.join(tails, ["member", "grp"], "left_anti")
    else:
        tails, heads = enough.select("member", "grp").limit(0), enough
    pairs = shared_pairs(heads.select("grp", "member"), block, True, -(-enough.count() // PAIR_ROWS))
    if without is not None:
        pairs = pairs.join(without, ["a", "b"], "left_anti")
    order = [F.desc("count"), "a", "b"]
    if minimum == 1:
        return pairs.orderBy(*order).limit(most)
    pairs = written(pairs)
    least = pairs.orderBy(*order).offset(most - 1).limit(1).collect()
    least = max(minimum, least[0]["count"]) if least else minimum
    # Both tails together add 2 (minimum - 1) at most.
    near = written(pairs.where(F.col("count") + 2 * (minimum - 1) >= least))
    tail = tails.groupBy("member").agg(F.collect_set("grp").alias("tail"))
    side = lambda c: tail.select(F.col("member").alias(c), F.col("tail").alias(f"tail_{c}"))
    asked = near.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b",
        F.inline(F.concat(
            F.transform("tail_a", lambda g: F.struct(F.col("b").alias("member"), g.alias("grp"))),
            F.transform(F.array_except("tail_b", "tail_a"), lambda g: F.struct(F.col("a").alias("member"), g.alias("grp"))),
        )),
    )
    more = asked.join(enough.select("member", "grp"), ["member", "grp"]).groupBy("a", "b").agg(F.count("*").alias("more"))
    whole = near.join(more, ["a", "b"], "left").select("a", "b", (F.col("count") + F.coalesce("more", F.lit(0))).alias("count"))
    return whole.where(F.col("count") >= minimum).orderBy(*order).limit(most)


def hidden_connections(nodes: DataFrame, edges: DataFrame, minimum: int = 3, limit: int = 20, examples: int = 10, block: int = 1000) -> DataFrame:
    """Person pairs without a direct edge that both point to at least ``minimum`` same nodes."""
    people = nodes.where(F.col("label") == "Person").select(F.col("id").alias("src"))
    out = written(edges.join(people, "src", "left_semi").select("src", "dst").distinct())
    # An edge between two people starts at one of them.
    direct = out.join(people.select(F.col("src").alias("dst")), "dst", "left_semi").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    top = written(frequent_pairs(out.select(F.col("dst").alias("grp"), F.col("src").alias("member")), minimum, limit, direct, block, True))
    seen = (
        F.broadcast(top.select("a", "b"))  # ``limit`` rows
        .join(out.select(F.col("src").alias("a"), F.col("dst").alias("shared")), "a")
        .join(out.select(F.col("src").alias("b"), F.col("dst").alias("shared")), ["b", "shared"])
        .withColumn("pair", F.struct("a", "b"))
    )
    sample = top_names(seen, "pair", ["shared"], "shared", examples)
    named = nodes.select("id", "name").join(F.broadcast(top.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "id", "left_semi")
    return (
        top.withColumn("pair", F.struct("a", "b"))
        .join(sample, "pair", "left")
        .join(named.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a")
        .join(named.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b")
        .select("a", "a_name", "b", "b_name", F.col("count").alias("shared_count"), F.col("shown").alias("top_shared"))
        .orderBy(F.desc("shared_count"), "a", "b")
    )


def hubs(nodes: DataFrame, edges: DataFrame, label: str = "Person", k: int = 20) -> DataFrame:
    """Entities of a label in the most documents."""
    mentions = edges.where(F.col("type") == MENTIONED).select("src", "dst").distinct()
    counts = mentions.groupBy("src").agg(F.count("*").alias("doc_count"))
    named = nodes.where(F.col("label") == label).select(F.col("id").alias("src"), "name")
    return named.join(counts, "src").select(F.col("src").alias("id"), "name", "doc_count").orderBy(F.desc("doc_count"), "id").limit(k)


def top_connected(nodes: DataFrame, co_mentioned: DataFrame, k: int = 20) -> DataFrame:
    """Entities by the summed counts of their CO_MENTIONED edges."""
    sums = both_ways(co_mentioned).groupBy(F.col("node").alias("id")).agg(F.sum("count").alias("total"), F.count("*").alias("partners"))
    return nodes.select("id", "name").join(sums, "id").orderBy(F.desc("total"), "id").limit(k)


def entity_doc_count(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Distinct documents that mention an entity whose name matches."""
    return _start_documents(nodes, edges, name).agg(F.count("*").alias("doc_count"))


def docs_with_most_entities(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """Documents by number of distinct entities."""
    counts = edges.where(F.col("type") == MENTIONED).select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("entities"))
    top = counts.orderBy(F.desc("entities"), "id").limit(k)
    return nodes.select("id", "name").join(F.broadcast(top), "id").orderBy(F.desc("entities"), "id")


def document_people(nodes: DataFrame, edges: DataFrame, document: str) -> DataFrame:
    """Persons mentioned in the document of that name."""
    doc = nodes.where((F.col("label") == "Document") & (F.col("name") == document)).select(F.col("id").alias("dst"))
    inside = edges.where(F.col("type") == MENTIONED).join(F.broadcast(doc.limit(1)), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return nodes.where(F.col("label") == "Person").join(inside, "id", "left_semi").select("id", "name").orderBy("name", "id")


def document_entities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities per document and label with their mention counts."""
    mentions = edges.where(F.col("type") == MENTIONED).groupBy("src", "dst").agg(F.sum("count").alias("mentions"))
    named = nodes.select(F.col("id").alias("src"), "label", "name")
    return mentions.join(named, "src").groupBy(F.col("dst").alias("doc"), "label").agg(
        F.count("*").alias("entities"), F.sum("mentions").alias("mentions")
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes per label and edges per type, as (kind, name, count)."""
    by_label = nodes.groupBy(F.col("label").alias("name")).agg(F.count("*").alias("count")).select(F.lit("node").alias("kind"), "name", "count")
    by_type = edges.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("count")).select(F.lit("edge").alias("kind"), "name", "count")
    return by_label.unionByName(by_type)


def restrict_types(edges: DataFrame, types: list[str], allowed: list[str] | None = None) -> DataFrame:
    """Edges of the requested types that are on the allow-list; no valid type means all."""
    good = [t for t in types if t in (allowed or RELATION_TYPES)]
    return edges.where(F.col("type").isin(good)) if good else edges


def restrict_labels(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """Nodes of the requested labels that are on the allow-list."""
    good = [x for x in labels if x in NODE_LABELS]
    return nodes.where(F.col("label").isin(good)) if good else nodes


def expand_subgraph(shown: DataFrame, found: DataFrame) -> DataFrame:
    """Union of two node sets, unique by id; the nodes already shown win."""
    merged = shown.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)))
    rest = [c for c in shown.columns if c != "id"]
    return merged.groupBy("id").agg(F.min_by(F.struct(*rest), "_new").alias("r")).select("id", "r.*")


def timeline(links: DataFrame, events: DataFrame, entity=None, limit: int | None = 50) -> DataFrame:
    """Events linked to an entity by participation, place or relation, by date.

    Without ``entity`` every entity gets its first ``limit`` events, or all if None.
    """
    kept = links.where(F.col("type").isin("PARTICIPATED_IN", "OCCURRED_AT", "RELATED_TO"))
    if entity is not None:
        kept = kept.where(F.col("src") == entity)
    rows = kept.select(F.col("src").alias("entity"), F.col("dst").alias("id")).distinct().join(events, "id")
    if entity is not None:
        return rows.orderBy("date", "id").limit(limit)
    if limit is None:
        return rows
    order = Window.partitionBy("entity").orderBy("date", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("rank")


def score_scale(metrics: DataFrame) -> DataFrame:
    """Display sizes and flags from (id, pagerank, betweenness, connections).

    The maxima are one aggregated row; no window gathers the table.
    """
    top = metrics.agg(F.max("pagerank").alias("p"), F.max("betweenness").alias("b"), F.max("connections").alias("c"))
    top_rank = F.greatest(top.select("p").scalar(), F.lit(0.001))
    top_between = F.greatest(top.select("b").scalar(), F.lit(0.001))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("pagerank") / top_rank))
    plain = F.greatest(F.lit(20.0), F.least(F.lit(60.0), 20.0 + F.col("connections") * 2.0))
    return metrics.select(
        "id",
        F.round(F.when(F.col("pagerank").isNotNull(), 20.0 + share * 40.0).otherwise(plain), 6).alias("size"),
        (F.col("betweenness") >= top_between * 0.7).alias("is_bridge"),
        F.round(100.0 * F.col("pagerank") / top_rank, 6).alias("bar_pct"),
    )


def entity_profile(wanted: DataFrame, nodes: DataFrame, edges: DataFrame, notes: DataFrame, links: DataFrame, events: DataFrame,
                   docs: int = 50, partners: int = 20, texts: int = 20, dated: int = 50, block: int = 1000) -> DataFrame:
    """One row per wanted entity: names, counts and dates over all its rows, and the first of its lists.

    ``wanted`` is (id); ``notes`` is (id, entity_id, content, created_at).
    Lists: ``document_ids`` and ``document_names``; ``partners`` (id, name,
    label, shared) by shared documents; ``note_texts``, newest first;
    ``timeline`` (date, type, description) by date.  A document of more than
    ``block`` mentions is joined in parts, so no task meets it whole.
    """
    who = wanted.select("id").distinct()
    named = nodes.select("id", "label", "name", *(["aliases"] if "aliases" in nodes.columns else []))
    base = named.join(who, "id", "left_semi")
    ends = both_ways(edges).join(who.withColumnRenamed("id", "node"), "node", "left_semi")
    counts = ends.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("connections"))
    mentions = written(edges.where(F.col("type") == MENTIONED).select(F.col("src").alias("id"), F.col("dst").alias("doc")).distinct())
    mine = mentions.join(who, "id", "left_semi")
    doc_counts = mine.groupBy("id").agg(F.count("*").alias("documents"))
    first_docs = written(_first_of(mine, "id", [F.col("doc")], docs))
    doc_list = _listed(first_docs.join(nodes.select(F.col("id").alias("doc"), F.col("name").alias("doc_name")), "doc", "left"), "id").select(
        "id", F.col("l.doc").alias("document_ids"), F.col("l.doc_name").alias("document_names")
    )
    hot = mentions.groupBy("doc").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).where("parts > 1")
    hot = broadcast_if_small(hot)
    parts = F.coalesce("parts", F.lit(1))
    near = mine.join(hot, "doc", "left").select("doc", "id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    others = mentions.withColumnRenamed("id", "partner").join(hot, "doc", "left").select("doc", "partner", F.pmod(F.xxhash64("partner"), parts).cast("int").alias("part"))
    together = near.join(others, ["doc", "part"]).where("partner <> id").groupBy("id", "partner").agg(F.count("*").alias("shared"))
    first_partners = _first_of(together, "id", [F.desc("shared"), F.col("partner")], partners)
    known = nodes.select(F.col("id").alias("partner"), F.col("name").alias("partner_name"), F.col("label").alias("partner_label"))
    partner_list = _listed(first_partners.join(known, "partner", "left"), "id").select(
        "id", F.transform("l", lambda x: F.struct(x["partner"].alias("id"), x["partner_name"].alias("name"), x["partner_label"].alias("label"), x["shared"].alias("shared"))).alias("partners")
    )
    own_notes = notes.select(F.col("entity_id").alias("id"), F.col("id").alias("note"), "content", "created_at").join(who, "id", "left_semi")
    note_counts = own_notes.groupBy("id").agg(F.count("*").alias("notes"))
    note_list = _listed(_first_of(own_notes, "id", [F.desc("created_at"), F.desc("note")], texts), "id").select("id", F.col("l.content").alias("note_texts"))
    told = timeline(links.join(who.withColumnRenamed("id", "src"), "src", "left_semi"), events, None, None).select(
        F.col("entity").alias("id"), F.col("id").alias("event"), "date", "type", "description"
    )
    event_counts = told.groupBy("id").agg(F.count("*").alias("events"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    event_list = _listed(_first_of(told, "id", [F.col("date"), F.col("event")], dated), "id").select(
        "id", F.transform("l", lambda x: F.struct(x["date"].alias("date"), x["type"].alias("type"), x["description"].alias("description"))).alias("timeline")
    )
    out = base
    for part in (counts, doc_counts, doc_list, partner_list, note_counts, note_list, event_counts, event_list):
        out = out.join(part, "id", "left")
    return out.fillna(0, ["connections", "documents", "notes", "events"])


def _first_of(rows: DataFrame, group: str, order: list, k: int) -> DataFrame:
    """The first ``k`` rows per group with their rank; ranking keeps only ``k`` rows per task."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_rank") <= k)


def _listed(ranked: DataFrame, group: str) -> DataFrame:
    """Per group its ranked rows as an array ``l`` of structs, in order."""
    rest = [c for c in ranked.columns if c not in (group, "_rank")]
    return ranked.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_rank", *rest))).alias("l"))
