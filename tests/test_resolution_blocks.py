"""Blocks of forms against the scalar measure."""

import itertools
import random

import numpy as np
import pytest

from corpusgraph.functions.formpairs import Forms
from corpusgraph.functions.similarity import jaro_winkler_score
from corpusgraph.operators import resolution


@pytest.mark.parametrize("split", [0, 60])
def test_block_scores_are_those_of_the_scalar_measure(split):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abcñ日") for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 20, 63, 64, 65, 90]))) for _ in range(150)})
    rng.shuffle(names)
    block = Forms(names)
    found = {}
    for i, j in block.candidates(split, 0.85):
        found |= {(names[a], names[b]): s for a, b, s in zip(i, j, block.scores(i, j)) if s >= 0.85}
    pairs = [(i, j) for i, j in itertools.combinations(range(len(names)), 2) if not split or i < split <= j]
    want = {tuple(sorted((names[i], names[j]))): jaro_winkler_score(*sorted((names[i], names[j]))) for i, j in pairs}
    assert found == {p: s for p, s in want.items() if s >= 0.85}
    i, j = np.array(pairs).T
    assert block.scores(i, j).tolist() == [jaro_winkler_score(names[a], names[b]) for a, b in pairs]


def test_forms_of_every_block_meet_once(spark):
    names = [f"name {i:03d}" for i in range(60)]
    keyed = spark.createDataFrame([(i, "Person", "", n) for i, n in enumerate(names)], "id bigint, label string, block string, normalized string")
    for rows in (resolution.similar_forms(keyed, 0.85, part_rows=7), resolution.candidate_forms(keyed, 0.85, part_rows=7)):
        got = [(r.a, r.b) for r in rows.collect()]
        assert len(got) == len(set(got))
        assert {p for p in got if jaro_winkler_score(*p) >= 0.85} == {p for p in itertools.combinations(names, 2) if jaro_winkler_score(*p) >= 0.85}


def test_links_write_no_pair_that_cannot_link(spark, monkeypatch):
    """Ambiguous pairs without a common document are dropped where they are found; the others and the sure ones stay."""
    rng = random.Random(8)
    names = sorted({"".join(rng.choice("abcd") for _ in range(7)) for _ in range(150)} | {"christopher nolan", "christoper nolan"})
    entities = [(i, "Person", "", n) for i, n in enumerate(names)]
    docs = {i: {rng.randrange(40)} for i in range(len(names))} | {i: {100 + i} for i in range(0, len(names), 2)}
    keyed = spark.createDataFrame(entities + [(5000, "Person", "", names[0])], "id bigint, label string, block string, normalized string")
    mentions = spark.createDataFrame([(i, d) for i, ds in docs.items() for d in ds] + [(5000, 7), (7, None), (9, None)], "src bigint, dst bigint")
    docs[5000] = {7}
    named = {i: n for i, _, _, n in entities} | {5000: names[0]}
    scores = {p: jaro_winkler_score(*sorted((named[p[0]], named[p[1]]))) for p in itertools.combinations(sorted(named), 2)}
    sure = {tuple(sorted((named[a], named[b]))) for (a, b), s in scores.items() if 0.95 <= s < 1}
    backed = {(a, b) for (a, b), s in scores.items() if 0.85 <= s < 0.95 and docs[a] & docs[b]}
    band = sum(0.85 <= s < 0.95 for s in scores.values())
    written, kept = resolution.written, []
    monkeypatch.setattr(resolution, "written", lambda df: kept.append(written(df)) or kept[-1])
    links = {tuple(sorted((r.src, r.dst))) for r in resolution.match_links(keyed, mentions).collect()}
    pairs = [df for df in kept if "similarity" in df.columns]
    assert len(pairs) == 1 and backed and sure
    assert links == {(0, 5000)} | backed | {tuple(sorted((names.index(a), names.index(b)))) for a, b in sure}
    assert pairs[0].count() < band / 4 and {(r.a, r.b) for r in pairs[0].collect()} >= sure


def test_components_leave_two_tables(spark, tmp_path, monkeypatch):
    """Tables of former rounds are gone; what the result reads stays."""
    from corpusgraph import session
    from corpusgraph.operators import algorithms

    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "src bigint, dst bigint")
    found = algorithms.connected_components(spark.range(62), edges)
    assert len([p for p in tmp_path.iterdir() if any(p.glob("*.parquet"))]) == 2
    assert {r.id: r.component for r in found.collect()} == {i: 0 if i < 61 else 61 for i in range(62)}
