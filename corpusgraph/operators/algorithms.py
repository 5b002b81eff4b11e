"""Iterative graph algorithms as DataFrame loops.

Adjacency is cut into parts of bounded size before any loop starts: a node with
many edges gets several salts, and its state row is repeated once per salt, so
no join key is ever larger than ``part_rows``.  Loops write their state to
Parquet after each round: a checkpointed table hands all predicates known of
its columns on, and planning time would double with every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgraph.functions import brandes, louvain
from corpusgraph.session import broadcast_if_small, cut_lineage, discard, fits_broadcast, spread, written

PART_ROWS = 100_000
#: A level or connected part with at most this many adjacency rows (16 bytes each and a weight) is solved in one task.
TASK_ROWS = 4_000_000
#: The same where a task gets the part packed, 4 bytes a row; nodes of a packed piece, and pieces that lots are dealt to.
HELD_ROWS, CHUNK, LOTS = 32_000_000, 4096, 997
#: Most rows of a map from nodes to nodes that is sent to every task.
MAPPED_ROWS = 2_000_000


def undirected(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """(src, dst, weight) in both directions, parallel edges added up, self loops kept once."""
    w = (weight if weight is not None else F.lit(1.0)).cast("double").alias("w")
    ends = F.array(
        F.struct(F.col("src").alias("s"), F.col("dst").alias("d")), F.struct(F.col("dst").alias("s"), F.col("src").alias("d"))
    )
    ends = F.when(F.col("src") == F.col("dst"), F.slice(ends, 1, 1)).otherwise(ends)
    return edges.select(w, F.inline(ends)).groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("w").alias("weight"))


def cut_adjacency(adjacency: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """Salted adjacency (src, salt, dst, weight) and node facts (id, out, weight_sum, parts)."""
    facts = adjacency.groupBy(F.col("src").alias("id")).agg(
        F.count("*").alias("out"), F.sum("weight").alias("weight_sum")
    ).withColumn("parts", F.ceil(F.col("out") / part_rows).cast("int"))
    hot = facts.where("parts > 1").select(F.col("id").alias("src"), "parts")
    salted = adjacency.join(broadcast_if_small(hot), "src", "left").select(
        "src",
        F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts").cast("bigint")), F.lit(0).cast("bigint")).cast("int").alias("salt"),
        "dst",
        "weight",
    )
    return salted, facts


def per_salt(state: DataFrame) -> DataFrame:
    """The state rows repeated for each salt of their node, keyed (src, salt)."""
    return state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumnRenamed("id", "src")


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, every: int = 5,
             part_rows: int = PART_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Undirected PageRank, (1-d) + d·Σ rank/out, a fixed number of rounds.

    Isolated nodes keep 1-d.  Connected parts of at most ``task_rows`` adjacency
    rows are solved in a task each.  In larger ones contributions are summed
    map-side, so a node that everybody points to costs one partial sum per task.
    """
    adjacency = written(undirected(edges).withColumn("weight", F.lit(1.0)))
    small, adjacency = in_parts(adjacency, task_rows)
    if small is not None:
        # As in the rounds below, a repeated node gives as often, an edge to null is given nothing back.
        copies = nodes.groupBy(F.col("id").alias("src")).agg(F.count("*").alias("copies"))
        small = small.join(broadcast_if_small(copies, MAPPED_ROWS), "src", "left").fillna(0, ["copies"])

        def solve(key: tuple, rows: pa.Table) -> pa.Table:
            ids, first, at = np.unique(rows["src"].to_numpy(), return_index=True, return_inverse=True)
            share, rank = rows["copies"].to_numpy()[first] / np.bincount(at), np.full(len(ids), 1.0 - damping)
            known = rows["dst"].is_valid().to_numpy()
            at, to = at[known], np.searchsorted(ids, rows["dst"].drop_null().to_numpy())
            for _ in range(iterations):
                rank = (1.0 - damping) + damping * np.bincount(to, weights=(rank * share)[at], minlength=len(ids))
            return pa.table({"id": ids, "pagerank": rank})

        found = small.groupBy("part").applyInArrow(solve, "id long, pagerank double")
        if adjacency is None:
            return nodes.select("id").join(found, "id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(1.0 - damping)))
    salted, facts = cut_adjacency(adjacency, part_rows)
    # Partitioned once by the loop's join key: no round shuffles the edges again.
    salted = cut_lineage(spread(salted.select("src", "salt", "dst"), "src", "salt"))
    # The static node facts; each round reads the previous ranks exactly once, so plans grow by a line per round.
    base = written(
        nodes.select("id").join(facts.select("id", "out", "parts"), "id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    )
    state = base.withColumn("rank", F.lit(1.0 - damping))
    for i in range(1, iterations + 1):
        given = salted.join(per_salt(state.where("out IS NOT NULL")), ["src", "salt"]).groupBy(F.col("dst").alias("id")).agg(
            F.sum(F.col("rank") / F.col("out")).alias("got")
        )
        state = base.join(given, "id", "left").withColumn(
            "rank", F.lit(1.0 - damping) + damping * F.coalesce("got", F.lit(0.0))
        ).drop("got")
        if i % every == 0 and i < iterations:
            state = written(state)
    ranks = state.select("id", F.col("rank").alias("pagerank"))
    if small is None:
        return ranks
    return ranks.join(found.withColumnRenamed("pagerank", "solved"), "id", "left").select("id", F.coalesce("solved", "pagerank").alias("pagerank"))


def in_parts(adjacency: DataFrame, task_rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The adjacency of connected parts that a task can hold, with their ``part``, and that of the larger ones; None for no rows."""
    if task_rows <= 0:
        return None, adjacency
    ids = adjacency.select(F.col("src").alias("id")).distinct()
    parts = written(connected_components(ids, adjacency).select(F.col("id").alias("src"), F.col("component").alias("part")))
    cut = adjacency.join(broadcast_if_small(parts, MAPPED_ROWS), "src")
    sizes = written(cut.groupBy("part").agg((F.count("*") <= task_rows).alias("held")))
    held = sizes.agg(F.bool_or("held"), F.bool_and("held")).first()
    if held[0] is None or held[1]:
        return cut, None
    if not held[0]:
        return None, adjacency
    cut = cut.join(broadcast_if_small(sizes), "part")
    return cut.where("held").drop("held"), cut.where("not held").drop("held", "part")


def connected_components(nodes: DataFrame, edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) with the smallest member id as the component.

    Every node first moves to its least neighbour, which leaves few edges of a
    dense graph.  The large-star and small-star contractions then alternate
    until the edge set is a forest of stars; all are a partial ``min`` per node
    and a join or two.
    """
    ends = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("v"), F.least("src", "dst").alias("u"))
    ends = written(ends.distinct())  # read twice
    near = ends.select(F.inline(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))))
    first = written(near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")))
    to = broadcast_if_small(first, MAPPED_ROWS)
    moved = ends.join(to, "v").select(F.col("m").alias("w"), "u").join(to.select(F.col("v").alias("u"), "m"), "u").where("w <> m")
    pairs = written(moved.select(F.greatest("w", "m").alias("v"), F.least("w", "m").alias("u")).distinct())
    discard(ends)
    mark = _signature(pairs)
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = written(large.where("v <> u").distinct())
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        last, pairs = pairs, written(small.unionByName(low.select("v", F.col("m").alias("u"))).distinct())
        discard(last, large)
        before, mark = mark, _signature(pairs)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = pairs.groupBy(F.col("v").alias("m")).agg(F.min("u").alias("component"))
    roots = first.join(roots, "m", "left").select(F.col("v").alias("id"), F.coalesce("component", "m").alias("component"))
    return nodes.select("id").join(roots, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _signature(pairs: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set."""
    row = pairs.select(F.xxhash64("v", "u").cast("decimal(38,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    return tuple(row)


def modularity(adjacency: DataFrame, membership: DataFrame) -> float:
    """Modularity of a partition (id, community) of an undirected weighted adjacency."""
    m = membership.select(F.col("id").alias("src"), F.col("community").alias("cs"))
    d = membership.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    total = adjacency.agg(F.sum("weight").alias("t")).first().t or 0.0
    if not total:
        return 0.0
    inside = adjacency.join(m, "src").join(d, "dst").groupBy("cs").agg(
        F.sum("weight").alias("tot"), F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight")).otherwise(0.0)).alias("inner")
    )
    q = inside.agg(F.sum(F.col("inner") / total - (F.col("tot") / total) * (F.col("tot") / total)).alias("q")).first().q
    return float(q or 0.0)


def communities(nodes: DataFrame, edges: DataFrame, weight: Column | None = None, rounds: int = 10, levels: int = 5,
                tolerance: float = 1e-4, part_rows: int = PART_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """Modularity communities as (id, community); every community is connected, its name its smallest member.

    A level moves nodes between communities, splits communities into their
    connected parts and contracts the parts; the next level starts from the
    communities and moves parts.  A level of at most ``task_rows`` adjacency
    rows, and each connected part of that size of a larger first one, is solved
    to the end in one task, larger ones take at most ``rounds`` rounds and there
    are at most ``levels`` of them.  In a round one half of
    the nodes may move, by a hash of node and round, which keeps neighbours
    from swapping places.  Nodes without edges are communities of their own.
    """
    adjacency = written(undirected(edges, weight))
    mapping = nodes.select("id", F.col("id").alias("part"))
    start = None
    total = adjacency.agg(F.sum("weight").alias("t")).first().t
    if not fits_broadcast(adjacency, task_rows):
        small, adjacency = in_parts(adjacency, task_rows)
        if small is not None:  # no community reaches beyond a part
            mapping = written(_renamed(mapping, _solved_by_part(small, total)))
        if adjacency is None:
            return mapping.select("id", F.col("part").alias("community"))
    for level in range(levels + 1):
        if level == levels or fits_broadcast(adjacency, task_rows):
            break
        moved, gained = _local_moves(adjacency, start, rounds, tolerance, part_rows, total)
        if not gained:
            break
        parts = _connected_parts(adjacency, moved)
        mapping = written(_renamed(mapping, parts.select("id", F.col("component").alias("to"))))
        start = parts.groupBy(F.col("component").alias("id")).agg(F.min("community").alias("community"))
        start = written(start)
        s, d = (parts.select(F.col("id").alias(c), F.col("component").alias(f"p{c}")) for c in ("src", "dst"))
        adjacency = written(adjacency.join(s, "src").join(d, "dst").groupBy(F.col("psrc").alias("src"), F.col("pdst").alias("dst")).agg(F.sum("weight").alias("weight")))
    if fits_broadcast(adjacency, task_rows):
        found = _solved_in_a_task(adjacency, start, total)
    else:  # what the last level left, split once more
        found = _connected_parts(adjacency, start if start is not None else _own(adjacency)).select("id", F.col("component").alias("to"))
    mapping = written(_renamed(mapping, found))
    names = mapping.groupBy("part").agg(F.min("id").alias("community"))
    return mapping.join(names, "part").select("id", "community")


def _renamed(mapping: DataFrame, step: DataFrame) -> DataFrame:
    """``mapping`` (id, part) with each part's name in ``step`` (id, to); parts that it lacks stay."""
    step = step.select(F.col("id").alias("part"), "to")
    return mapping.join(step, "part", "left").select("id", F.coalesce("to", "part").alias("part"))


def _own(adjacency: DataFrame) -> DataFrame:
    return adjacency.select(F.col("src").alias("id"), F.col("src").alias("community")).distinct()


def _connected_parts(adjacency: DataFrame, membership: DataFrame) -> DataFrame:
    """(id, community, component): the connected parts of every community."""
    s, d = (membership.select(F.col("id").alias(c), F.col("community").alias(f"c{c}")) for c in ("src", "dst"))
    inside = adjacency.where("src < dst").join(s, "src").join(d, "dst").where("csrc = cdst").select("src", "dst")
    return written(connected_components(membership, inside).join(membership, "id"))


def _local_moves(adjacency: DataFrame, start: DataFrame | None, rounds: int, tolerance: float, part_rows: int, total: float | None) -> tuple[DataFrame, bool]:
    """(id, community) after at most ``rounds`` rounds, and whether modularity rose.

    A round is one pass over the adjacency: the links of each node into the
    communities around it tell its best move, and, summed over the nodes' own
    communities, the modularity of the state that the pass began with.
    """
    if not total:
        return None, False
    salted, facts = cut_adjacency(adjacency.where("src <> dst"), part_rows)
    salted = cut_lineage(spread(salted, "src", "salt"))
    loops = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0))
    strength = adjacency.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("k"), loops.alias("loop"))
    state = strength.join(facts.select("id", "parts"), "id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    if start is None:
        state = state.withColumn("community", F.col("id"))
    else:
        state = state.join(start, "id")
    state = written(state)
    first = best = None
    kept = state
    for i in range(2 * rounds + 1):
        volume = state.groupBy("community").agg(F.sum("k").alias("volume"))
        toward = per_salt(state.select("id", "community", "parts")).join(salted, ["src", "salt"]).groupBy(
            F.col("dst").alias("id"), "community"
        ).agg(F.sum("weight").alias("links"))
        own = state.select("id", "k", "loop", "parts", F.col("community").alias("mine"))
        options = (
            toward.unionByName(state.select("id", "community", F.lit(0.0).alias("links")))
            .groupBy("id", "community").agg(F.sum("links").alias("links"))
            .join(volume, "community").join(own, "id")
        )
        here = F.col("community") == F.col("mine")
        rest = F.col("volume") - F.when(here, F.col("k")).otherwise(0.0)
        gain = F.round(F.col("links") - F.col("k") * rest / total, 9)
        active = F.pmod(F.xxhash64("id", F.lit(i // 2)), F.lit(2)) == i % 2
        moved = written(options.groupBy("id").agg(
            F.first("k").alias("k"), F.first("loop").alias("loop"), F.first("parts").alias("parts"), F.first("mine").alias("mine"),
            F.sum(F.when(here, F.col("links"))).alias("inner"),
            F.max_by("community", F.struct(gain, here, -F.col("community"))).alias("to"),
        ).withColumn("community", F.when(active, F.col("to")).otherwise(F.col("mine"))))
        share = F.sum("k") / total
        q = moved.groupBy("mine").agg((F.sum(F.col("inner") + F.col("loop")) / total - share * share).alias("q")).agg(F.sum("q")).first()[0]
        if first is None:
            first = best = q
        elif q > best or i % 2:  # the halves of a round are judged together
            kept, rose = (state, q - best) if q > best else (kept, 0.0)
            best = max(best, q)
            if i % 2 == 0 and rose <= tolerance:
                break
        else:
            break
        state = moved.select("id", "k", "loop", "parts", "community")
    return kept.select("id", "community"), best > first + tolerance


def _solved_by_part(parts: DataFrame, total: float) -> DataFrame:
    """(id, to): the communities of connected parts, one task each; ``total`` is the weight of the whole graph."""

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        # Each node starts alone, named by itself as in a single task.
        own = np.unique(rows["src"].to_numpy())
        ends = [np.concatenate((rows[c].to_numpy(), own)) for c in ("src", "dst")]
        ids, found = louvain.solve(*ends, np.concatenate((rows["weight"].to_numpy(), np.full(len(own), np.nan))), total=total)
        return pa.table({"id": ids, "to": found})

    return parts.groupBy("part").applyInArrow(solve, "id long, to long")


def _solved_in_a_task(adjacency: DataFrame, start: DataFrame | None, total: float | None) -> DataFrame:
    """(id, to): the communities of a small adjacency, all levels."""
    begin = start if start is not None else _own(adjacency)
    rows = adjacency.select("src", "dst", "weight").unionByName(
        begin.select(F.col("id").alias("src"), F.col("community").alias("dst"), F.lit(None).cast("double").alias("weight"))
    )

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            t = pa.Table.from_batches(parts)
            ids, found = louvain.solve(*(t[c].to_numpy() for c in ("src", "dst", "weight")), total=total)
            yield pa.RecordBatch.from_pydict({"id": ids, "to": found})

    return rows.coalesce(1).mapInArrow(solve, "id long, to long")


def betweenness(nodes: DataFrame, edges: DataFrame, samples: int = 1000, seed: int = 42, scale: bool = False,
                part_rows: int = PART_ROWS, most: int = 100, task_rows: int = HELD_ROWS, batch: int = 64, deal: int = 42) -> DataFrame:
    """Shortest-path betweenness from ``samples`` source nodes (all nodes when fewer).

    Connected parts of at most ``task_rows`` adjacency rows go to tasks whole,
    as packed arrays, once for every ``deal`` of their sources.  A larger one
    stays distributed: ``batch`` sources at a time advance together as a key
    column, dependencies are summed back level by level and added up after each
    batch, so the state is ``batch`` rows per node at most.  With ``scale`` the
    sums are multiplied by nodes / samples.
    """
    adjacency = written(undirected(edges.where(F.col("src") != F.col("dst"))))
    draw = F.md5(F.concat_ws("_", F.col("id").cast("string"), F.lit(str(seed))))
    sources = written(nodes.select("id").orderBy(draw, "id").limit(samples))
    small, adjacency = in_parts(adjacency, task_rows)
    sums = None if small is None else _from_each_task(small, sources, deal)
    if adjacency is not None:
        sources = sources.join(adjacency.select(F.col("src").alias("id")).distinct(), "id", "left_semi") if small is not None else sources
        place = F.pmod(F.xxhash64("id"), F.lit(-(-sources.count() // batch)))
        for number in range(-(-sources.count() // batch)):
            part = _from_many_tasks(adjacency, sources.where(place == number), part_rows, most)
            if part is not None:
                sums = part if sums is None else written(sums.unionByName(part).groupBy("id").agg(F.sum("b").alias("b")))
    score = nodes.select("id")
    if sums is None:
        return score.withColumn("betweenness", F.lit(0.0))
    factor = F.lit(0.5)
    if scale:
        factor = factor * nodes.count() / max(1, min(samples, nodes.count()))
    return score.join(sums, "id", "left").select("id", F.coalesce(F.col("b") * factor, F.lit(0.0)).alias("betweenness"))


def _from_each_task(parts: DataFrame, sources: DataFrame, deal: int) -> DataFrame:
    """(id, b): summed dependencies; a task gets a connected part and ``deal`` of its sources."""
    member = _numbered(parts)
    turn = (F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1) / deal
    dealt = written(sources.join(member, "id").select("part", F.floor(turn).cast("int").alias("lot"), "at"))
    lots = dealt.groupBy("part").agg((F.max("lot") + 1).alias("lots"))
    packed = _packed(parts.join(broadcast_if_small(lots), "part", "left_semi"), member)
    empty = F.lit(None).cast("binary")
    rows = packed.join(broadcast_if_small(lots), "part").select(
        "part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.col("chunk").alias("at"), "sizes", "near"
    ).unionByName(dealt.select("part", "lot", F.col("at").cast("long"), empty.alias("sizes"), empty.alias("near")))

    def sum_up(key: tuple, rows: pa.Table) -> pa.Table:
        chunk = pc.is_valid(rows["near"])
        held = rows.filter(chunk).sort_by("at")
        graph = brandes.Graph.packed(held["sizes"].to_pylist(), held["near"].to_pylist())
        total = graph.summed(np.sort(rows.filter(pc.invert(chunk))["at"].to_numpy()))
        some = np.flatnonzero(total)
        return pa.table({"part": pa.repeat(key[0], len(some)), "at": pa.array(some, pa.int32()), "b": total[some]})

    # Lots stay apart: few bytes of rows mean much work.
    found = rows.repartition(LOTS, "part", "lot").groupBy("part", "lot").applyInArrow(sum_up, "part long, at int, b double")
    return found.groupBy("part", "at").agg(F.sum("b").alias("b")).join(member, ["part", "at"]).select("id", "b")


def _numbered(parts: DataFrame) -> DataFrame:
    """(id, part, at): the nodes of each connected part, numbered from 0."""
    member = parts.select(F.col("src").alias("id"), "part").distinct()
    return written(member.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1))


def _packed(parts: DataFrame, member: DataFrame) -> DataFrame:
    """(part, chunk, sizes, near): the neighbours of ``CHUNK`` nodes as two arrays of 32-bit numbers, written once."""
    at = broadcast_if_small(member, MAPPED_ROWS)
    rows = parts.join(at.select(F.col("id").alias("src"), F.col("at").alias("s")), "src").join(at.select(F.col("id").alias("dst"), F.col("at").alias("d")), "dst")

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        s, d = (rows[c].to_numpy() for c in ("s", "d"))
        order = np.argsort(s.astype(np.int64) << 32 | d)
        sizes = np.bincount(s - key[1].as_py() * CHUNK, minlength=1)
        return pa.table({"part": [key[0].as_py()], "chunk": [key[1].as_py()], "sizes": [sizes.astype("<i4").tobytes()], "near": [d[order].astype("<i4").tobytes()]})

    chunked = rows.select("part", F.floor(F.col("s") / CHUNK).alias("chunk"), "s", "d")
    return written(chunked.groupBy("part", "chunk").applyInArrow(pack, "part long, chunk long, sizes binary, near binary"))


def _from_many_tasks(adjacency: DataFrame, sources: DataFrame, part_rows: int, most: int) -> DataFrame | None:
    """(id, b): summed dependencies of one batch of sources; None if no path has an inner node."""
    salted, facts = cut_adjacency(adjacency, part_rows)
    salted = cut_lineage(spread(salted.select("src", "salt", "dst"), "src", "salt"))
    parts = written(facts.select("id", "parts"))
    frontier = written(sources.select(F.col("id").alias("source"), "id", F.lit(1.0).alias("paths")))
    levels, seen = [frontier], frontier.select("source", "id")
    while len(levels) <= most:
        reached = _spread(frontier.select("source", "id", "paths"), parts, salted).groupBy("source", F.col("dst").alias("id")).agg(
            F.sum("paths").alias("paths")
        )
        frontier = written(reached.join(seen, ["source", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionByName(frontier.select("source", "id"))
    else:
        raise RuntimeError(f"shortest paths longer than {most} hops: raise ``most``")
    below = levels[-1].withColumn("delta", F.lit(0.0))
    collected = None
    for level in reversed(levels[:-1]):
        share = below.select("source", "id", ((1.0 + F.col("delta")) / F.col("paths")).alias("share"))
        back = _spread(share, parts, salted).groupBy("source", F.col("dst").alias("id")).agg(F.sum("share").alias("share"))
        below = written(
            level.join(back, ["source", "id"], "left").select(
                "source", "id", "paths", (F.col("paths") * F.coalesce("share", F.lit(0.0))).alias("delta")
            )
        )
        part = below.where("source <> id").select("id", "delta")
        collected = part if collected is None else collected.unionByName(part)
    return None if collected is None else written(collected.groupBy("id").agg(F.sum("delta").alias("b")))


def _spread(rows: DataFrame, parts: DataFrame, salted: DataFrame) -> DataFrame:
    """The rows of (source, id, …) sent along every edge of their node."""
    return per_salt(rows.join(parts, "id")).join(salted, ["src", "salt"])


def node_metrics(nodes: DataFrame, ranks: DataFrame, groups: DataFrame, bridges: DataFrame) -> DataFrame:
    """One table with all computed metrics per node."""
    return nodes.join(ranks, "id", "left").join(groups, "id", "left").join(bridges, "id", "left")


def rank_by(metrics: DataFrame, metric: str, k: int = 25) -> DataFrame:
    """The top ``k`` nodes by a metric."""
    return metrics.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), "id").limit(k)


def community_sizes(metrics: DataFrame, k: int = 8) -> DataFrame:
    """The largest communities."""
    sizes = metrics.where("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "community").limit(k)


def algorithm_status(metrics: DataFrame, computed_at: Column) -> DataFrame:
    """When the metrics were computed and how many nodes carry them."""
    return metrics.agg(F.count("pagerank").alias("node_count")).withColumn("last_computed", computed_at)
