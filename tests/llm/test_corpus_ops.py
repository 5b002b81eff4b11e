"""Jaccard join, sharding, mixing, quality, neighbour search and the pipeline against brute force and edge rows."""

import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusgraph.llm import ann, common, mixing, ngramjoin, quality, sharding

DOCS = "doc_id long, text string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s") for r in rows], DOCS)


# n-gram Jaccard join

def sets_of(text, words):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute_components(rows, words, percent):
    sets = [sets_of(t, words) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return sorted((repr(d), len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed, groups=8, size=9):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 12, 40, 160, 500]))]
        for _ in range(size):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append((rnd.randrange(10**6), " ".join(text)))
    return rows


@pytest.mark.parametrize("words,percent,block", [(4, 85, 2000), (5, 80, 3)])
def test_components_equal_brute_force(spark, monkeypatch, words, percent, block):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)  # small blocks cut every bucket into cells
    rows = near_copies(words)
    rows += [(2_000_000 + i, rows[3][1].upper()) for i in range(30)]
    rows += [(3_000_000, None), (3_000_001, ""), (3_000_002, " \t\n"), (3_000_003, "one two"), (3_000_004, "ONE  two"), (3_000_005, "long " * 30_000), rows[0]]
    table = docs(spark, rows).withColumn("component_id", F.lit("x")).withColumn("node", F.lit(1))
    got = ngramjoin.jaccard_components(table, words, percent)
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows, words, percent)
    left = ngramjoin.keep_one(table, words, percent)
    want = {eval(d) for d, _, c in brute_components(rows, words, percent) if eval(d) == c}
    assert {r.doc_id for r in left.collect()} == want and left.columns == table.columns


def test_linked_sets_share_a_piece():
    rnd = np.random.default_rng(4)
    for percent in (80, 85, 95):
        for _ in range(150):
            n = int(rnd.choice([1, 2, 5, 9, 20, 60, 200, 900]))
            a = rnd.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            keep = a[: max(1, -(-percent * n // 100))] if rnd.random() < 0.5 else a
            b = np.concatenate([keep, rnd.integers(0, 1 << 63, int(rnd.integers(0, max(1, n // 8))), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            apart = len(a) + len(b) - 2 * both
            x, y = ngramjoin.parity_bits(a), ngramjoin.parity_bits(b)
            k = min(len(x), len(y))
            assert ngramjoin.apart(ngramjoin.folded(x, k), ngramjoin.folded(y, k)) <= apart
            if 100 * both >= percent * (len(a) + len(b) - both):
                assert apart <= ngramjoin.most_apart(len(a) + len(b), percent)
                assert set(ngramjoin.piece_keys(a, percent).tolist()) & set(ngramjoin.piece_keys(b, percent).tolist())


def test_join_of_empty_table_and_chain_of_links(spark):
    assert ngramjoin.jaccard_components(docs(spark, [])).count() == 0
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.id: r.comp for r in common.components(edges).collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# sharding

def ring_brute(points, shards, slack):
    """One key after the other, in ring order, round by round."""
    walks, n = sharding.walks(shards), sum(points.values())
    room = sharding.capacities(n, shards, slack).tolist()
    left, out = dict(points), Counter()
    for r in range(shards):
        for s in range(shards):
            for p in sorted(left):
                if walks[p][r] == s:
                    take = min(left[p], room[s])
                    out[p, s] += take
                    left[p] -= take
                    room[s] -= take
    return +out


def test_shards_are_balanced_and_whole(spark):
    rows = [(i * 7919, f"text {i}") for i in range(1003)] + [(None, "a"), (None, None), (5, ""), (5, ""), (5, "b")]
    table = docs(spark, rows).withColumn("slot", F.lit("x"))
    out = sharding.shard_rows(table, 16).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(rows, key=repr)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 16
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    again = sharding.shard_rows(table.repartition(5), 16).collect()
    assert sorted(((r.doc_id, r.text, r.shard, r.slot) for r in again), key=repr) == sorted(((r.doc_id, r.text, r.shard, r.slot) for r in out), key=repr)
    assert sharding.shard_rows(docs(spark, []), 16).count() == 0


@pytest.mark.parametrize("slack", [0.0, 0.1])
def test_placement_equals_brute_force_and_moves_little(slack):
    rnd = np.random.default_rng(2)
    points = {int(p): int(n) for p, n in zip(rnd.choice(sharding.POINTS, 600, replace=False), rnd.poisson(20, 600)) if n}
    hot = max(points, key=points.get)
    points[hot] += sum(points.values()) // 2  # one key with a third of all rows
    counts = pd.DataFrame({"point": list(points), "part": 0, "n": list(points.values())})
    owner = {}
    for shards in (16, 17):
        plan = sharding.place(counts, shards, slack)
        got = Counter()
        for r in plan.itertuples():
            got[r.point, r.shard] += r.high - r.low + 1
            owner.setdefault(shards, {}).update({(r.point, k): r.shard for k in range(r.low, r.high + 1)})
        assert got == ring_brute(points, shards, slack)
        load = Counter()
        for (_, s), n in got.items():
            load[s] += n
        assert max(load.values()) <= max(sharding.capacities(sum(points.values()), shards, slack))
    moved = sum(owner[16][k] != owner[17][k] for k in owner[16]) / len(owner[16])
    assert moved < 0.35


# mixing

def test_rates_meet_targets(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, int(rnd.integers(1, 400)), [float(x) for x in rnd.dirichlet([0.3, 0.3, 0.3])]) for i in range(3000)]
    rated = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    tokens, p = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    goal = np.array([0.7, 0.2, 0.1]) * tokens.sum()
    out, have = mixing.fit_rates(rated, goal)
    rate = np.array([r.rate for r in out.orderBy("doc_id").collect()])
    assert (rate >= 0).all()
    assert np.allclose(rate @ (p * tokens[:, None]), have) and np.abs(have - goal).max() <= 0.002 * goal.max()
    # The same descent on all rows at once.
    a = p * (tokens / np.sqrt((tokens**2).mean()))[:, None]
    g = goal / np.sqrt((tokens**2).mean()) / len(a)
    assert np.abs(rate @ a / len(a) - g).max() < 0.002 * g.max()


@pytest.mark.parametrize("rare,long", [(0.08, 20), (0.01, 0), (0.01, 20)])
def test_rates_meet_targets_with_long_texts_and_rare_domains(spark, rare, long):
    rnd = np.random.default_rng(8)
    kinds = rnd.choice(3, 3000, p=[1 - 2 * rare, rare, rare])
    p = np.full((3000, 3), 0.03) + 0.91 * np.eye(3)[kinds]
    p = np.concatenate([p, [[0.98, 0.01, 0.01]] * long]) if long else p
    tokens = np.concatenate([rnd.integers(20, 400, 3000), np.full(long, 200_000)]).astype(int)
    rated = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p))], "doc_id long, tokens long, p array<double>")
    goal = np.array([0.8, 0.1, 0.1]) * tokens.sum()
    out, have = mixing.fit_rates(rated, goal)
    rate = np.array([r.rate for r in out.orderBy("doc_id").collect()])
    assert (rate >= 0).all() and np.allclose(rate @ (p * tokens[:, None]), have)
    assert np.abs(have - goal).max() <= 1e-4 * goal.max()
    # Out of reach within a caller's bound: the miss is told, the bound is kept.
    out, have = mixing.fit_rates(rated, goal, low=1.0, high=1.1)
    assert np.abs(have - goal).max() > 1e-4 * goal.max()
    assert out.filter("rate < 1 OR rate > 1.1").count() == 0


def test_mixing_tells_what_it_reached(spark):
    rows = [(i, "good plain words here" if i % 3 else "bad bad stuff !!!") for i in range(90)]
    labels = spark.createDataFrame([(i, "clean" if i % 3 else "junk") for i in range(60)], "doc_id long, domain string")
    told = mixing.mix_rates(docs(spark, rows), labels, {"clean": 0.5, "junk": 0.1, "toxic": 0.4}).schema["rate"].metadata
    assert told["domains"] == ["clean", "junk", "toxic"] and told["reached"][2] == 0 < told["targets"][2]
    assert mixing.mix_rates(docs(spark, []), labels, {"clean": 1.0}).schema["rate"].metadata["reached"] == [0.0]


def test_mixing_edges(spark):
    rows = [(i, "good plain words here" if i % 3 else "bad bad stuff !!!") for i in range(90)] + [(200, None), (201, ""), (None, "good words"), (1, "good plain words here")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)] + [(61, None, 0), (62, 1, None), (None, 1, 1), (63, 0, 0), (63, 1, 0)], "doc_id long, quality int, toxic int")
    known = mixing.domains(labels)
    assert known.count() == 60
    weights = {"clean": 0.9, "junk": 0.1, "toxic": 0.0}
    out = mixing.mix_rates(docs(spark, rows).withColumn("rate", F.lit(9)), known, weights).collect()
    assert len(out) == len(rows) and all(r.p[2] == 0 for r in out)
    assert {r.doc_id: r.rate for r in out}[200] == 1.0
    assert np.mean([r.rate for r in out if r.doc_id and r.doc_id < 90 and r.doc_id % 3]) > np.mean([r.rate for r in out if r.doc_id is not None and r.doc_id < 90 and r.doc_id % 3 == 0])
    mixed = mixing.mix(docs(spark, rows), known, weights, low=1.0)
    assert mixed.columns == ["doc_id", "text", "source"] and {r.doc_id for r in mixed.collect()} == {d for d, _ in rows}
    none = spark.createDataFrame([], "doc_id long, domain string")
    assert {tuple(r.p) for r in mixing.mix_rates(docs(spark, rows), none, weights).collect()} == {(1 / 3,) * 3}
    assert mixing.mix_rates(docs(spark, []), known, weights).count() == 0


# quality

def test_gradient_is_the_slope():
    import pyarrow as pa

    rnd = np.random.default_rng(0)
    lists = [rnd.choice(6, rnd.integers(1, 5), replace=False) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({"grade": pa.array(rnd.integers(0, 4, 40), pa.int32()), "at": pa.array(lists, pa.list_(pa.int64()))})
    w, cuts = rnd.normal(size=6), np.array([-1.0, 0.2, 1.5])
    _, gw, gc, n = quality.gradient([batch], w, cuts)
    assert n == 40
    for k in range(9):
        d = np.zeros(9)
        d[k] = 1e-6
        up = quality.gradient([batch], w + d[:6], cuts + d[6:])[0]
        down = quality.gradient([batch], w - d[:6], cuts - d[6:])[0]
        assert (up - down) / 2e-6 == pytest.approx(np.concatenate([gw, gc])[k], abs=1e-4)


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    grades = quality.graded(spark.read.parquet(f"{sf}/labels.parquet"))
    model = quality.fit(table, grades.filter("doc_id % 4 <> 3"))
    assert (np.diff(model.cuts) >= 0).all() and (model.weights <= 0).all()
    held = table.join(grades.filter("doc_id % 4 = 3"), "doc_id")
    out = quality.rate(held, model).select("grade", "expected_grade", "tails", quality.accepted(F.col("tails")).alias("keep")).toPandas()
    assert out.keep[out.grade == 2].mean() > 0.96
    assert out.keep[out.grade == 1].mean() < 0.1 and out.keep[out.grade == 0].mean() < 0.25
    assert all(a >= b for a, b in out.tails)
    assert out.groupby("grade").expected_grade.mean().is_monotonic_increasing


def test_quality_edges(spark):
    rows = [(i, "fine words" if i % 2 else "AWFUL!!! stuff") for i in range(40)] + [(50, None), (51, ""), (None, "fine"), (1, "fine words"), (52, "fine words " * 50_000)]
    table = docs(spark, rows).withColumn("tails", F.lit(0))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(50, None, None)], "doc_id long, quality int, toxic int")
    out = quality.rate(table, quality.fit(table, quality.graded(labels))).collect()
    assert len(out) == len(rows) and all(0 <= r.expected_grade <= 2 for r in out)
    one = quality.fit(table, quality.graded(labels.filter("quality = 1")))
    assert not len(one.index) and quality.rate(table, one).filter("tails[1] > 0.5").count() == len(rows)
    assert quality.rate(docs(spark, []), quality.fit(docs(spark, []), quality.graded(labels.limit(0)))).count() == 0


def test_quality_without_labels_or_good_rows(spark):
    table = docs(spark, [(i, "fine words") for i in range(20)] + [(50, None)])
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    for given, keeps in ((labels.limit(0), 21), (labels, 0)):
        out = quality.rate(table, quality.fit(table, quality.graded(given))).withColumn("keep", quality.accepted(F.col("tails"))).collect()
        assert all(len(r.tails) == 2 and r.tails[0] >= r.tails[1] for r in out) and sum(r.keep for r in out) == keeps


# neighbours

def test_index_returns_every_code_within_the_radius():
    rnd = np.random.default_rng(1)
    codes = rnd.integers(0, 256, (700, 8), dtype=np.uint8)
    codes[300:] = codes[rnd.integers(0, 40, 400)] ^ (rnd.random((400, 8)) < 0.2).astype(np.uint8)
    for radius in (0, 3, 7, 8, 13, 26):
        index = ann.MultiIndex(codes, radius)
        for q in codes[::97]:
            gap = np.bitwise_count(codes ^ q).sum(axis=1)
            assert index.within(q).tolist() == np.flatnonzero(gap <= radius).tolist()


def test_neighbours_recall_and_edges(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(900, 24)).astype(np.float32)
    x[300:600] = x[7]  # a third of all rows is one vector
    rows = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    odd = [(5000, None, 1), (5050, [0.0] * 24, 1), (5100, [float("nan")] + [1.0] * 23, 1), (5150, [None] + [1.0] * 23, 1), (5200, [1.0, 2.0], 1), (None, rows[0][1], 1), (5250, [float("inf")] + [0.0] * 23, 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score int")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    for block in (4096, 7):
        got = ann.neighbours(table, table.filter("vec_id % 50 = 0"), query_block=block).toPandas()
        assert set(got["query_id"]) == set(range(0, 900, 50))
        hits = 0
        for q, part in got.groupby("query_id"):
            part = part.sort_values("rank")
            assert part["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(part.vec_id)
            sims = unit @ unit[q]
            sims[q] = -9
            want = np.lexsort((np.arange(900), -np.round(sims, 12)))[:5]
            hits += len(set(want) & set(part.vec_id))
            assert np.allclose(sims[part.vec_id.to_numpy()], part.score)
            if 300 <= q < 600:
                assert part.vec_id.tolist() == want.tolist()
        assert hits / (18 * 5) >= 0.9
    few = table.filter("vec_id < 3")
    assert ann.neighbours(few, few.filter("vec_id = 0")).count() == 2
    assert ann.neighbours(table.limit(0), table.limit(0)).count() == 0


def test_neighbours_of_isolated_vectors_among_near_copies(spark):
    rnd = np.random.default_rng(6)
    x = np.repeat(rnd.normal(size=(20, 16)), 60, axis=0) + rnd.normal(size=(1200, 16)) * 1e-6
    x = np.concatenate([x, rnd.normal(size=(30, 16))])
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    codes = ann.learn(x)
    assert codes.radius <= 1
    unit = ann.units(x)
    asked = table.filter("vec_id >= 1200 OR vec_id % 100 = 0")
    for block in (4096, 9):
        got = ann.neighbours(table, asked, codes=codes, query_block=block).toPandas()
        assert len(got) == 42 * 5 and not (got["query_id"] == got.vec_id).any() and not got.duplicated(["query_id", "vec_id"]).any()
        assert np.allclose([unit[a] @ unit[b] for a, b in zip(got["query_id"], got.vec_id)], got.score)
        assert all(sorted(part["rank"]) == [1, 2, 3, 4, 5] for _, part in got.groupby("query_id"))
    # No more rows than there are, and all of them.
    few = table.filter("vec_id IN (0, 1200, 1201)")
    assert ann.neighbours(few, few, codes=codes).count() == 6


# pipeline

def test_pipeline_stages(spark, sf):
    """Each stage by its own input: what goes, and that columns stay."""
    before = spark.read.parquet(f"{sf}/documents.parquet")
    columns = before.columns
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, sf), "stage")
        old, new = before.select("doc_id", "text").toPandas(), after.select("doc_id", "text").toPandas()
        assert set(new.doc_id) <= set(old.doc_id) and len(new)
        texts = dict(zip(old.doc_id, old.text))
        assert all(texts[d] == t for d, t in zip(new.doc_id, new.text))
        if stage is corpus_pipeline.near_duplicate_stage:
            want = {eval(d) for d, _, c in brute_components(list(zip(old.doc_id.tolist(), old.text)), corpus_pipeline.SHINGLE, corpus_pipeline.SIMILAR) if eval(d) == c}
            assert set(new.doc_id) == want
        if stage is corpus_pipeline.decontamination_stage:
            items = [" ".join(t.lower().split()) for t in spark.read.parquet(f"{sf}/benchmark.parquet").toPandas().text]
            holds = {d for d, t in zip(old.doc_id, old.text) if any(i in " ".join(t.lower().split()) for i in items)}
            assert not holds & set(new.doc_id) and len(old) - len(new) <= len(holds) + 3
        if stage is corpus_pipeline.mixing_stage:
            assert set(new.doc_id) == set(old.doc_id)
        if stage is corpus_pipeline.sharding_stage:
            assert after.columns == [*columns, "shard", "slot"] and len(new) == len(old)
        else:
            assert after.columns == columns
        before = after


def test_crc_of_text(spark):
    row = docs(spark, [(1, "é")]).select(F.crc32(F.encode("text", "utf-8")).alias("c")).first()
    assert row.c == zlib.crc32("é".encode())
