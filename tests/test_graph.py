"""Graph, resolution and vector operators against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import louvain
from corpusgraph.functions.similarity import jaro_winkler_score
from corpusgraph.operators import algorithms, graph, resolution, vectors, walks


def edge_table(spark, pairs):
    return spark.createDataFrame([(int(a), int(b), "R", 1) for a, b in pairs], "src bigint, dst bigint, type string, count bigint")


def node_table(spark, ids):
    return spark.createDataFrame([(int(i), "Person", f"n{i}") for i in ids], "id bigint, label string, name string")


PATH = [(i, i + 1) for i in range(1, 7)]
STAR = [(0, i) for i in range(1, 8)]
CLIQUES = [(a, b) for a, b in itertools.combinations(range(5), 2)] + [(a + 10, b + 10) for a, b in itertools.combinations(range(5), 2)] + [(0, 10)]


def brute_betweenness(nodes, pairs):
    near = {n: set() for n in nodes}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)

    def bfs(s):
        dist, count, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v], count[v] = dist[u] + 1, 0.0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    count[v] += count[u]
        return dist, count

    info = {s: bfs(s) for s in nodes}
    score = dict.fromkeys(nodes, 0.0)
    for s, t in itertools.combinations(nodes, 2):
        if t not in info[s][0]:
            continue
        for v in nodes:
            if v in (s, t) or v not in info[s][0] or v not in info[t][0]:
                continue
            if info[s][0][v] + info[t][0][v] == info[s][0][t]:
                score[v] += info[s][1][v] * info[t][1][v] / info[s][1][t]
    return score


@pytest.mark.parametrize("pairs,part_rows", [(PATH, 100_000), (STAR, 2), (CLIQUES, 3)])
def test_betweenness(spark, pairs, part_rows):
    nodes = sorted({x for p in pairs for x in p}) + [99]
    got = algorithms.betweenness(node_table(spark, nodes), edge_table(spark, pairs), part_rows=part_rows, task_rows=0 if part_rows < 100 else 10**6, batch=7)
    want = brute_betweenness(nodes, pairs)
    for r in got.collect():
        assert r.betweenness == pytest.approx(want[r.id], abs=1e-9)


def test_pagerank_with_hot_node(spark):
    rng = random.Random(1)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(60)} | {(0, i) for i in range(1, 30)}
    nodes = [*range(30), 77]
    adj = np.zeros((30, 30))
    for a, b in pairs:
        adj[a, b] = adj[b, a] = 1
    rank = np.full(30, 0.15)
    for _ in range(20):
        rank = 0.15 + 0.85 * (adj @ (rank / adj.sum(axis=0)))
    got = {r.id: r.pagerank for r in algorithms.pagerank(node_table(spark, nodes), edge_table(spark, pairs), part_rows=4).collect()}
    assert got[77] == pytest.approx(0.15)
    for i in range(30):
        assert got[i] == pytest.approx(rank[i], abs=1e-9)


def test_registered_metrics_take_the_whole_projection(spark, sf, monkeypatch):
    from workload import resolution_queries as queries

    edges = queries.entity_edges(spark, sf).count()
    for name in ("communities", "betweenness"):
        given = {}
        monkeypatch.setattr(algorithms, name, lambda nodes, edges, given=given, **options: given.update(edges=edges.count(), options=set(options)) or nodes.withColumn("betweenness", F.lit(0.0)))
        getattr(queries, name)(spark, sf)
        assert given["edges"] == edges and given["options"] <= {"weight"}


def test_communities_of_two_cliques(spark):
    edges = edge_table(spark, CLIQUES)
    rows = algorithms.communities(node_table(spark, [0, 1, 2, 3, 4, 10, 11, 12, 13, 14, 50]), edges).collect()
    found = {r.id: r.community for r in rows}
    assert {found[i] for i in range(5)} == {0} and {found[i] for i in range(10, 15)} == {10} and found[50] == 50
    q = algorithms.modularity(algorithms.undirected(edges), spark.createDataFrame(list(found.items()), "id bigint, community bigint"))
    assert q > 0.4


def quality(edges, found):
    """Modularity of a partition, from its definition."""
    total, inside, volume = 2.0 * len(edges), 0.0, {}
    for a, b in edges:
        inside += 2.0 * (found[a] == found[b])
        for v in (a, b):
            volume[found[v]] = volume.get(found[v], 0) + 1
    return inside / total - sum((x / total) ** 2 for x in volume.values())


def planted(groups, size, inner, outer, seed):
    rng, n = random.Random(seed), groups * size
    return [(a, b) for a in range(n) for b in range(a) if rng.random() < (inner if a // size == b // size else outer)]


def parted(edges, found):
    """Whether every community is connected."""
    up = {v: v for v in found}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        if found[a] == found[b]:
            up[top(a)] = top(b)
    return len({top(v) for v in found}) != len(set(found.values()))


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]
        yield [[items[0]], *rest]


def in_a_task(edges):
    both = [(*e, 1.0) for a, b in edges for e in ((a, b), (b, a))] + [(v, v, float("nan")) for v in sorted({v for e in edges for v in e})]
    ids, names = louvain.solve(*(np.array(c) for c in zip(*both)))
    return dict(zip(ids.tolist(), names.tolist()))


def test_communities_in_a_task_reach_the_optimum():
    ring = [(10 * c + a, 10 * c + b) for c in range(12) for a in range(5) for b in range(a)] + [(10 * c, (10 * c + 11) % 120) for c in range(12)]
    found = in_a_task(ring)
    assert quality(ring, found) >= quality(ring, {v: v // 10 for v in found}) - 1e-9 and not parted(ring, found)
    rng = random.Random(3)
    for _ in range(12):
        edges = list({tuple(sorted(rng.sample(range(7), 2))) for _ in range(rng.randint(6, 14))})
        found = in_a_task(edges)
        every = max(quality(edges, {v: i for i, g in enumerate(p) for v in g}) for p in partitions(sorted(found)))
        assert quality(edges, found) >= every - 0.05 and not parted(edges, found)
        assert all(found[c] == c for c in found.values())


def test_communities_over_many_tasks(spark, monkeypatch):
    """Levels that are cut over tasks come close to the planted groups, and a round has one pass over the edges."""
    edges = planted(8, 20, 0.4, 0.02, 5)
    nodes, table = node_table(spark, [*range(160), 999]), edge_table(spark, edges)
    cuts = []
    cut = algorithms.cut_lineage
    monkeypatch.setattr(algorithms, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    whole = quality(edges, {v: v // 20 for v in range(160)})
    for task_rows, levels in ((0, 2), (600, 3)):
        cuts.clear()
        found = {r.id: r.community for r in algorithms.communities(nodes, table, rounds=4, levels=levels, task_rows=task_rows).collect()}
        assert len(found) == 161 and found[999] == 999 and all(found[c] == c for c in found.values())
        assert not parted(edges, found)
        assert quality(edges, {k: v for k, v in found.items() if k != 999}) > whole - 0.1
        # A level: its state and edges, a cut per half round, and what splitting and contracting take.
        assert len(cuts) <= 2 + levels * (2 * 4 + 1 + 24)


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    nodes = list(range(200)) + list(range(300, 342))
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.id: r.component for r in algorithms.connected_components(node_table(spark, nodes), edge_table(spark, pairs)).collect()}
    assert got == {n: find(n) for n in nodes}


@pytest.mark.parametrize("block", [2, 1000])
def test_shared_pairs_with_hot_group(spark, block):
    rng = random.Random(2)
    rows = [(g, m) for g in range(6) for m in rng.sample(range(20), 5)] + [(9, m) for m in range(20)]
    want = {}
    for g in {g for g, _ in rows}:
        for a, b in itertools.combinations(sorted({m for h, m in rows if h == g}), 2):
            want[a, b] = want.get((a, b), 0) + 1
    got = graph.shared_pairs(spark.createDataFrame(rows + rows[:3], "grp bigint, member bigint"), block)
    assert {(r.a, r.b): r["count"] for r in got.collect()} == want


def test_shortest_path(spark):
    edges = edge_table(spark, PATH + [(20, 21)])
    assert [(r.step, r.id) for r in walks.shortest_path(edges, 1, 7).collect()] == [(i, i + 1) for i in range(7)]
    assert walks.shortest_path(edges, 1, 7, most=5).count() == 0
    assert walks.shortest_path(edges, 1, 21).count() == 0
    assert [(r.step, r.id) for r in walks.shortest_path(edges, 3, 3).collect()] == [(0, 3)]


def test_paths_do_not_reuse_edges(spark):
    edges, nodes = edge_table(spark, [(1, 2), (2, 3)]), node_table(spark, [1, 2, 3])
    assert [r.ids for r in walks.paths(nodes, edges, "n1", depth=3).collect()] == [[1, 2], [1, 2, 3]]


NAMES = [
    "john smith", "jon smith", "johnny smith", "smith john", "j smith", "john smyth", "maria garcia", "mariah garcia", "garcia maria", "m garcia",
    "jo", "joe", "joey", "aa", "a", "ab", "christopher nolan", "christoper nolan", "kristopher nolan", "nolan christopher", "abcd", "abce", "abcdef",
    "bcd", "acd", "the ritz hotel", "ritz hotel", "ritz hotels", "hotel ritz",
]


@pytest.mark.parametrize("above,part_rows", [(5000, 2000), (5000, 2), (3, 2)])
def test_candidates_lose_no_match(spark, above, part_rows):
    rng = random.Random(11)
    letters = "abcde"
    names = sorted(set(NAMES) | {"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(150)})
    df = spark.createDataFrame([(i, "Person", n) for i, n in enumerate(names)], "id bigint, label string, name string")
    keyed = resolution.block_keys(df, above).withColumn("normalized", F.col("name"))
    keyed = keyed.withColumn("block", F.when(F.lit(above) < len(names), F.substring("name", 1, 1)).otherwise(""))
    found = resolution.score_forms(resolution.candidate_forms(keyed, 0.85, part_rows)).where("similarity >= 0.85")
    want = {
        (a, b) for a, b in itertools.combinations(names, 2)
        if jaro_winkler_score(a, b) >= 0.85 and (above >= len(names) or a[0] == b[0])
    }
    assert {tuple(sorted((r.a, r.b))) for r in found.collect()} == want


def test_resolution_chain(spark):
    names = ["Jonathan Smithe", "Jonathan Smith", "Jonathon Smith", "Mary Major", "Dr. Mary Major", "Bob"]
    df = spark.createDataFrame([(i, "Person", n) for i, n in enumerate(names)], "id bigint, label string, name string")
    mentions = spark.createDataFrame([(i, 100 + i, "MENTIONED_IN", 1) for i in range(6)] + [(1, 7, "MENTIONED_IN", 1)],
                                     "src bigint, dst bigint, type string, count bigint")
    links = resolution.match_links(resolution.block_keys(df), mentions)
    groups = {r.id: r["group"] for r in resolution.merge_groups(df, links).collect()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    canon = resolution.canonicalize(df, resolution.merge_groups(df, links), graph.degree(df, mentions))
    rows = {r.group: r for r in canon.collect()}
    assert rows[0].canonical_name == "Jonathan Smith" and rows[0].aliases == ["Jonathan Smithe", "Jonathon Smith"]
    mapping = resolution.canonical_map(resolution.merge_groups(df, links), canon)
    moved = resolution.rewrite_edges(mentions, mapping)
    assert {(r.src, r.dst) for r in moved.collect()} == {(1, 100), (1, 101), (1, 102), (1, 7), (3, 103), (3, 104), (5, 105)}


def test_ambiguous_pairs_need_a_shared_document(spark):
    df = spark.createDataFrame([(1, "Person", "dwayne"), (2, "Person", "duaynes")], "id bigint, label string, name string")
    assert 0.85 <= jaro_winkler_score("dwayne", "duaynes") < 0.95
    apart = spark.createDataFrame([(1, 10, "MENTIONED_IN", 1), (2, 11, "MENTIONED_IN", 1)], "src bigint, dst bigint, type string, count bigint")
    together = spark.createDataFrame([(1, 10, "MENTIONED_IN", 1), (2, 10, "MENTIONED_IN", 1)], "src bigint, dst bigint, type string, count bigint")
    keyed = resolution.block_keys(df)
    assert resolution.match_links(keyed, apart).count() == 0
    assert resolution.match_links(keyed, together).count() == 1


@pytest.mark.parametrize("point_block,query_block", [(20_000, 2_000), (7, 5)])
def test_knn_batch(spark, point_block, query_block):
    rng = np.random.default_rng(4)
    vecs = rng.normal(size=(40, 6)).astype("float32")
    vecs[7] = vecs[3]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "point_id bigint, embedding array<float>")
    bad = spark.createDataFrame([(99, None), (98, [1.0])], "point_id bigint, embedding array<float>")
    queries = table.withColumnRenamed("point_id", "query_id")
    got = vectors.knn_batch(table.unionByName(bad), queries, 4, True, point_block, query_block)
    unit = vecs.astype("float64") / np.linalg.norm(vecs.astype("float64"), axis=1, keepdims=True)
    sims = np.round(unit @ unit.T, 6)
    for q in range(40):
        order = sorted((i for i in range(40) if i != q), key=lambda i: (-sims[q, i], i))[:4]
        rows = got.where(F.col("query_id") == q).orderBy("rank").collect() if q % 13 == 0 else None
        if rows is not None:
            assert [r.point_id for r in rows] == order


def test_tasks_of_the_graph_queries_stay_bounded(spark, capsys):
    """However few partitions a session asks for, a shuffle has pieces enough for large tables."""
    from workload import graph_queries

    found = graph_queries.degree(spark, "/root/testdata/sf0.001")
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    found.explain()
    spark.conf.set("spark.sql.shuffle.partitions", few)
    plan = capsys.readouterr().out
    assert ", 2)" not in plan and ", 1000), ENSURE_REQUIREMENTS" in plan
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_tasks_that_compare_pairs_grow_in_number(spark, monkeypatch):
    rows = [(g, m) for g in range(40) for m in range(g % 7, 30, 1 + g % 3)]
    table = spark.createDataFrame(rows + rows[:9], "grp bigint, member bigint")
    asked = []
    monkeypatch.setattr(graph, "spread", lambda df, *keys, least=0: asked.append(least) or df.repartition(max(least, 2), *keys))
    want = [tuple(r) for r in graph.frequent_pairs(table, 2, 9).collect()]
    monkeypatch.setattr(graph, "PAIR_ROWS", 100)
    assert [tuple(r) for r in graph.frequent_pairs(table, 2, 9).collect()] == want and len(want) == 9
    assert asked == [1, 1, -(-len(rows) // 100), -(-len(rows) // 100)]


@pytest.mark.parametrize("name", [
    "entity_network", "hubs", "shared_connections", "co_occurring", "co_occurring_samples", "degree", "list_entities", "person_profile", "find_entities",
])
def test_a_query_bounds_its_own_tasks(spark, sf, capsys, name):
    """A session of large scans and two pieces a shuffle does not decide what a task of the query holds."""
    import re

    import workload.everything  # noqa: F401  (fills the registry)
    from corpusgraph.session import BOUNDED
    from workload.registry import QUERIES

    loose = dict(zip(BOUNDED, ("1g", "1g", "2"), strict=True)) | {"spark.sql.shuffle.partitions": "2"}
    kept = {key: spark.conf.get(key) for key in loose}
    try:
        for key, value in loose.items():
            spark.conf.set(key, value)
        QUERIES[name](spark, sf).explain()
        found = {key: spark.conf.get(key) for key in BOUNDED}
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    pieces = re.findall(r"hashpartitioning\(.*, (\d+)\), ENSURE_REQUIREMENTS", capsys.readouterr().out)
    assert found == BOUNDED and set(pieces) == {"1000"}


@pytest.mark.parametrize("copies,k", [(1, 3), (900, 3), (1, 40)])
def test_knn_batch_beyond_single_precision(spark, monkeypatch, copies, k):
    """Points closer than a float tells apart, copies, zero and broken vectors, against brute force; rows are copied less often."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 5))
    vecs = [v.tolist() for v in np.concatenate([base, base[:60] + 1e-7 * rng.normal(size=(60, 5)), np.repeat(base[:1], copies, axis=0)])]
    vecs += [[0.0] * 5, [float("nan")] * 5, [1e300] * 5]
    points = spark.createDataFrame(list(enumerate(vecs)), "point_id bigint, embedding array<double>")
    queries = points.where("point_id < 60 OR point_id > 350").withColumnRenamed("point_id", "query_id")
    with np.errstate(all="ignore"):
        m = np.asarray(vecs)
        unit = m / np.linalg.norm(m, axis=1, keepdims=True)
        sims = np.round(unit @ unit.T, vectors.PLACES)
    monkeypatch.setattr(vectors, "PAIRS", 2)
    got = {}
    for r in vectors.knn_batch(points, queries, k, True, 400, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.point_id, r.score))
    for q in (0, 7, 59, 351, 360, len(vecs) - 1):
        want = sorted((-sims[q, i], i) for i in range(len(vecs)) if i != q and np.isfinite(sims[q, i]))[:k]
        assert [p for _, p, _ in sorted(got[q])] == [i for _, i in want]
        assert np.allclose([s for *_, s in sorted(got[q])], [-s for s, _ in want], atol=1e-11)
    assert len(vecs) - 3 not in got and len(vecs) - 2 not in got


@pytest.mark.parametrize("minimum", [1, 2, 3, 5])
def test_frequent_pairs_match_brute_force(spark, minimum):
    """Two hot groups, repeated rows, ties at the cut, and pairs that do not count."""
    rng = random.Random(minimum)
    rows = [(g, m) for m in range(60) for g in rng.sample(range(25), rng.randint(1, 9))]
    rows += [(g, m) for g in (100, 101) for m in range(0, 60, 1 + g % 2)] + rows[:30] + [(500 + m, m) for m in range(60)]
    sets = {}
    for g, m in rows:
        sets.setdefault(m, set()).add(g)
    skip = [(0, 1), (2, 4), (3, 9)]
    counted = [(-len(sets[a] & sets[b]), a, b) for a, b in itertools.combinations(sorted(sets), 2) if (a, b) not in skip]
    want = sorted(c for c in counted if -c[0] >= minimum)
    table, without = spark.createDataFrame(rows, "grp long, member long"), spark.createDataFrame(skip, "a long, b long")
    for most in (7, 5000):
        got = graph.frequent_pairs(table, minimum, most, without, block=8).collect()
        assert sorted((-r["count"], r.a, r.b) for r in got) == want[:most]
    assert graph.frequent_pairs(table.limit(0), minimum, 5).count() == 0


def test_two_ended_paths_match_one_ended_search(spark, tmp_path):
    """Length, and among shortest paths the smallest predecessors from the target back; one stored adjacency serves all."""
    rng = random.Random(12)
    pairs = {tuple(rng.sample(range(40), 2)) for _ in range(60)} | {(100 + i, 101 + i) for i in range(8)} | {(i, 50) for i in range(0, 30, 3)}
    walks.write_adjacency(edge_table(spark, sorted(pairs)), str(tmp_path))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def brute(source, target, most):
        far = {source: 0}
        level = [source]
        while level:
            level = sorted({o for n in level for o in near.get(n, ()) if o not in far})
            far |= {n: max(far.values()) + 1 for n in level}
        if far.get(target, most + 1) > most:
            return []
        chain = [target]
        while chain[-1] != source:
            chain.append(min(n for n in near[chain[-1]] if far.get(n) == far[chain[-1]] - 1))
        return chain[::-1]

    for source, target, most in [(0, 1, 6), (3, 17, 6), (50, 8, 6), (100, 108, 8), (100, 108, 7), (0, 104, 6), (5, 5, 6), (5, 777, 6)]:
        got = walks.shortest_path(None, source, target, most, stored=str(tmp_path), spark=spark).collect()
        assert [r.id for r in got] == brute(source, target, most)
        assert [r.step for r in got] == list(range(len(got))) and all((r.type is None) == (r.step == 0) for r in got)
    plan = walks._around(walks.adjacency(None, str(tmp_path), spark), spark.createDataFrame([(50,)], "id bigint"))._jdf.queryExecution().toString()
    assert "(bucket#" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(node,50)" in plan


@pytest.mark.parametrize("task_rows", [0, 30, 1000])
def test_metrics_of_connected_parts(spark, task_rows):
    """A small part, a larger one and a lone node: the same results whether parts go to tasks or not."""
    rng = random.Random(5)
    pairs = CLIQUES[:10] + sorted({tuple(sorted(rng.sample(range(20, 40), 2))) for _ in range(60)})
    ids = [0, 1, 2, 3, 4, *range(20, 40), 99]
    nodes, edges = node_table(spark, ids), edge_table(spark, pairs)
    between = {r.id: r.betweenness for r in algorithms.betweenness(nodes, edges, task_rows=task_rows, deal=3).collect()}
    assert between == pytest.approx(brute_betweenness(ids, pairs), abs=1e-9)
    near = np.zeros((100, 100))
    for a, b in pairs:
        near[a, b] = near[b, a] = 1
    rank = np.full(100, 0.15)
    for _ in range(20):
        rank = 0.15 + 0.85 * (near @ (rank / np.maximum(near.sum(axis=0), 1)))
    ranks = {r.id: r.pagerank for r in algorithms.pagerank(nodes, edges, task_rows=task_rows).collect()}
    assert ranks == pytest.approx({i: rank[i] for i in ids}, abs=1e-9)
    found = {r.id: r.community for r in algorithms.communities(nodes, edges, task_rows=task_rows).collect()}
    assert set(found) == set(ids) and {found[i] for i in range(5)} == {0} and found[99] == 99
    alone = quality(pairs, {i: 20 if i in range(20, 40) else found[i] for i in ids})
    assert quality(pairs, found) >= alone - 1e-9


def test_pagerank_of_parts_takes_repeated_nodes_and_null_ends(spark):
    edges = spark.createDataFrame([(0, 1, "R", 1), (1, 2, "R", 1), (2, None, "R", 1), (None, 1, "R", 1), (3, None, "R", 1), (4, 5, "R", 1)],
                                  "src bigint, dst bigint, type string, count bigint")
    nodes = spark.createDataFrame([(0,), (1,), (1,), (2,), (3,), (4,), (None,)], "id bigint")  # 5 is no node
    by = [sorted((r.id if r.id is not None else -1, round(r.pagerank, 9)) for r in algorithms.pagerank(nodes, edges, iterations=3, task_rows=n).collect()) for n in (0, 100)]
    assert by[0] == by[1] and len(by[0]) == 7
