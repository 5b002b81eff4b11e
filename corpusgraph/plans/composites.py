"""Jobs that answer one question with several operators.

Each returns a dict of lazy DataFrames: the parts have different shapes, and
Spark plans every part on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.operators import evidence, fusion, graph, search, vectors, walks


def person_profile(name: str, nodes: DataFrame, edges: DataFrame, docs: DataFrame, notes: DataFrame, limit: int = 50) -> dict[str, DataFrame]:
    """Matching entities, their co-occurrences, documents and notes."""
    return {
        "entities": graph.find_entities(nodes, edges, name, "Person"),
        "connections": graph.co_occurring(nodes, edges, name, 30),
        "documents": search.substring_search(docs, name, limit),
        "notes": evidence.notes_about(notes, name),
        "document_count": search.substring_count(docs, name),
    }


def connection_map(a: str, b: str, nodes: DataFrame, edges: DataFrame, k: int = 20) -> dict[str, DataFrame]:
    """Shortest mention path between two names, both neighbourhoods and their overlap."""
    ids = []
    for name in (a, b):
        row = walks.first_match(nodes, name).first()
        if row is None:
            raise LookupError(f"no entity matches {name!r}")
        ids.append(row.id)
    return {
        "path": walks.shortest_path(edges, ids[0], ids[1], types=[graph.MENTIONED]),
        "a_connections": graph.co_occurring(nodes, edges, a, k),
        "b_connections": graph.co_occurring(nodes, edges, b, k),
        "shared": graph.shared_connections(nodes, edges, a, b, k),
    }


def document_triage(query: str, docs: DataFrame, points: DataFrame, vector: list[float], limit: int = 50) -> DataFrame:
    """Full-text, semantic and literal hits merged, first step wins."""
    words = search.fulltext(docs, query, limit).select("doc_id", "score")
    meaning = vectors.best_chunks(points, vector, limit).select(F.col("document_id").alias("doc_id"), "score")
    literal = search.substring_search(docs, query, limit).select("doc_id", "source")
    return fusion.merge_step_results([words, meaning, literal])


def entity_network(name: str, nodes: DataFrame, edges: DataFrame, k: int = 50) -> DataFrame:
    """An entity's connections with its document count on every row."""
    found = graph.co_occurring(nodes, edges, name, k)
    return found.withColumn("document_count", graph.entity_doc_count(nodes, edges, name).scalar())
