"""Breadth-first walks over stored adjacency: traversal, paths, shortest path.

``write_adjacency`` stores every node's neighbours once, in folders by a hash
of the node and sorted by it there.  A hop from few nodes reads their folders'
row groups alone; a hop from many is one join, whose frontier is broadcast only
after its size was measured.  Every hop is stored so that the plan stays
short and a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgraph.operators.graph import RELATION_TYPES, both_ways
from corpusgraph.session import broadcast_if_small, scratch_path, written


def clamp_depth(depth, most: int = 4) -> int:
    """A service's default: depth as an integer between 1 and ``most``.  The operators take any depth."""
    return min(max(int(depth), 1), most)


#: Folders of a stored adjacency, and nodes that a hop names one by one.
BUCKETS, LISTED = 64, 1000


def write_adjacency(edges: DataFrame, path: str) -> None:
    """Store (node, other, type) of both directions of every edge, once per pair and type.

    Ranges over folder, node and neighbour: a node of many edges is several
    tasks' work, and a task writes to few folders.  Repeated rows meet there, so
    dropping them needs no other shuffle.
    """
    ways = both_ways(edges).select("node", "other", "type").withColumn("bucket", _bucket("node"))
    placed = ways.repartitionByRange("bucket", "node", "other").distinct().sortWithinPartitions("bucket", "node", "other")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def _bucket(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(BUCKETS)).cast("int")


def adjacency(edges: DataFrame | None, stored: str | None, spark: SparkSession | None = None) -> DataFrame:
    """(node, other, type[, bucket]) of a stored adjacency, else written once for this walk."""
    if stored is None:
        stored = scratch_path(edges.sparkSession, "adjacency")
        write_adjacency(edges, stored)
    spark = spark or edges.sparkSession
    return spark.read.schema("node bigint, other bigint, type string, bucket int").parquet(stored)


def _around(ways: DataFrame, frontier: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(node, other, type) around the nodes of ``frontier`` (id)."""
    if types:
        ways = ways.where(F.col("type").isin(types))
    ids = [r.id for r in frontier.select("id").limit(LISTED + 1).collect()]
    if len(ids) <= LISTED:
        spark = ways.sparkSession
        folders = spark.createDataFrame([(i,) for i in ids], "node bigint").select(_bucket("node").alias("b")).distinct()
        return ways.where(F.col("bucket").isin([r.b for r in folders.collect()]) & F.col("node").isin(ids))
    return ways.join(broadcast_if_small(frontier.select(F.col("id").alias("node"))), "node")


def _next_level(ways: DataFrame, frontier: DataFrame, seen: DataFrame, step: int, types: list[str] | None = None) -> DataFrame:
    """(id, distance, parent) of the nodes one hop further; the parent is the smallest neighbour one hop closer."""
    reached = _around(ways, frontier, types).groupBy(F.col("other").alias("id")).agg(F.min("node").alias("parent"))
    return written(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(step).alias("distance"), "parent"))


def hop_levels(edges: DataFrame | None, starts: DataFrame, depth: int, types: list[str] | None = None, stored: str | None = None) -> DataFrame:
    """(id, distance, parent) of every node within ``depth`` hops of ``starts`` (id).

    The parent is the smallest neighbour one hop closer.  ``stored`` is the
    path of a stored adjacency of ``edges``, which are then not read.
    """
    ways = adjacency(edges, stored, starts.sparkSession)
    frontier = written(starts.select("id", F.lit(0).alias("distance"), F.lit(None).cast("bigint").alias("parent")))
    seen = frontier
    for step in range(1, depth + 1):
        frontier = _next_level(ways, frontier, seen, step, types)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def traverse(nodes: DataFrame, edges: DataFrame | None, start: str, types: list[str] | None = None, depth: int = 2, limit: int = 50,
             stored: str | None = None) -> DataFrame:
    """Nodes within ``depth`` hops of the named node with their least distance."""
    types = [t for t in types if t in RELATION_TYPES] if types else None
    starts = nodes.where(F.col("name") == start).select("id")
    levels = hop_levels(edges, starts, depth, types, stored).where("distance > 0")
    return (
        nodes.select("id", "name", "label").join(levels.select("id", "distance"), "id")
        .orderBy("distance", "name", "id").limit(limit)
    )


def first_match(nodes: DataFrame, name: str) -> DataFrame:
    """The matching node with the smallest id, as (id)."""
    return nodes.where(F.contains(F.lower("name"), F.lit(name.lower()))).agg(F.min("id").alias("id")).where("id IS NOT NULL")


def shortest_path(edges: DataFrame | None, source: int, target: int, most: int = 6, types: list[str] | None = None,
                  stored: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """Nodes of one shortest path as (step, id, type), empty when none within ``most`` hops.

    Two searches, from either end, take turns; the one with the smaller
    frontier goes on, until they meet, so each covers about half the way.
    Ties go to the smallest predecessor, seen from the target; ``type`` is the
    first relation, by name, that leads to the node.
    """
    ways = adjacency(edges, stored, spark)
    spark = ways.sparkSession
    none = spark.createDataFrame([], "step int, id bigint, type string")

    def begin(node: int) -> list[DataFrame]:
        return [spark.createDataFrame([(node, 0, None)], "id bigint, distance int, parent bigint")]

    ahead, back = begin(source), begin(target)
    seen = {id(ahead): ahead[0], id(back): back[0]}
    size = {id(ahead): 1, id(back): 1}
    met = ahead[0].where(F.col("id") == target)
    while met.isEmpty():
        if len(ahead) + len(back) - 2 >= most:
            return none
        side = ahead if size[id(ahead)] <= size[id(back)] else back
        level = _next_level(ways, side[-1], seen[id(side)], len(side), types)
        size[id(side)] = level.count()
        if not size[id(side)]:
            return none
        side.append(level)
        seen[id(side)] = seen[id(side)].unionByName(level)
        met = ahead[-1].join(back[-1].select("id"), "id", "left_semi")
    # On the far half, what lies on a shortest path is what the meeting nodes lead to, level by level.
    on_path = [written(met.select("id"))]
    for level in reversed(back[:-1]):
        near = _around(ways, on_path[-1], types).select(F.col("other").alias("id")).distinct()
        on_path.append(written(level.select("id").join(near, "id", "left_semi")))
    # Back from the target: one lookup per step, at most ``most`` of them.
    chain = [target]
    for level in reversed(on_path[:-1]):
        here = spark.createDataFrame([(chain[-1],)], "id bigint")
        near = _around(ways, here, types).select(F.col("other").alias("id"))
        chain.append(level.join(near, "id", "left_semi").agg(F.min("id").alias("id")).first().id)
    for level in reversed(ahead[1:]):
        chain.append(level.where(F.col("id") == chain[-1]).first().parent)
    steps = spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(zip(chain[::-1], [None, *chain[::-1]]))], "step int, id bigint, parent bigint")
    relation = _around(ways, steps, types).groupBy(F.col("node").alias("parent"), F.col("other").alias("id")).agg(F.min("type").alias("type"))
    return relation.join(F.broadcast(steps), ["parent", "id"], "right").select("step", "id", "type").orderBy("step")


def paths(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 1, rel_type: str | None = None, limit: int = 20) -> DataFrame:
    """Relation chains from the first matching node that use no edge twice.

    Shorter chains come first, then by the ids along the way.  A level is only
    expanded while fewer than ``limit`` chains were found, so what is expanded
    stays below ``limit`` chains.
    """
    kept = edges.where(F.col("type") == rel_type) if rel_type else edges
    edge = F.struct(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "type")
    ways = both_ways(kept).select("node", "other", "type", edge.alias("edge"))
    origin = first_match(nodes, start).select(F.col("id").alias("at"))
    frontier = origin.select(
        "at", F.array("at").alias("ids"), F.array().cast("array<string>").alias("rel_types"),
        F.array().cast("array<struct<a:bigint,b:bigint,type:string>>").alias("used"),
    )
    found, total = None, 0
    for _ in range(depth):
        step = (
            F.broadcast(frontier).join(ways, F.col("at") == F.col("node"))
            .where(~F.array_contains("used", F.col("edge")))
            .select(
                F.col("other").alias("at"), F.concat("ids", F.array("other")).alias("ids"),
                F.concat("rel_types", F.array("type")).alias("rel_types"), F.concat("used", F.array("edge")).alias("used"),
            )
        )
        order = [F.size("ids"), F.col("ids"), F.col("rel_types")]
        frontier = written(step.orderBy(*order).limit(limit - total))
        found = frontier if found is None else found.unionByName(frontier)
        total += frontier.count()
        if total >= limit:
            break
    named = nodes.select(F.col("id").alias("at"), "name", "label")
    return found.join(named, "at").select(F.col("at").alias("id"), "name", "label", "ids", "rel_types").orderBy(F.size("ids"), "ids", "rel_types")
