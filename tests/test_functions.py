"""Arguments, text and identifier expressions on hand-made cases."""

import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from corpusgraph.functions import ids, markup, names, paging, similarity
from corpusgraph.functions import text as tx
from corpusgraph.operators import chunking, extraction, search, walks


def values(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize("page,limit,want", [
    ("3", "20", (3, 20)), (None, None, (1, 25)), (1, 500, (1, 100)), (-5, -10, (1, 1)), ("abc", "xyz", (1, 25)),
])
def test_paging(page, limit, want):
    assert paging.coerce_page(page, limit) == want


def test_query_argument():
    assert paging.coerce_query("  " + "x" * 600) == "x" * 500
    with pytest.raises(ValueError):
        paging.coerce_query("   ")


@pytest.mark.parametrize("depth,want", [(10, 4), (0, 1), (-5, 1), (3, 3)])
def test_depth(depth, want):
    assert walks.clamp_depth(depth) == want


def test_route_and_refusal(spark):
    texts = ["x" * 49, "x" * 50, " " * 60 + "x", None]
    assert values(spark, tx.route_extraction(F.col("text")), texts) == ["needs_ocr", "completed", "needs_ocr", "error"]
    assert values(spark, tx.is_refusal(F.col("text")), ["I'm SORRY, no", "fine text"]) == [True, False]


def test_choose_text(spark):
    df = spark.createDataFrame([
        (1, "a" * 50, "short one"), (2, "a" * 49, "fallback"), (3, "I cannot " + "a" * 60, "EMPTY "), (4, None, "12345"),
    ], "i int, p string, f string")
    rows = df.select("i", tx.choose_text(F.col("p"), F.col("f")).alias("c")).select("i", "c.*").orderBy("i").collect()
    assert [(r.text, r.method, r.error) for r in rows] == [
        ("a" * 50, "primary", None), ("fallback", "fallback", None), (None, "error", "no_text_extracted"), (None, "error", "no_text_extracted"),
    ]


def test_clean_text(spark):
    assert values(spark, tx.clean_text(F.col("text")), ["a\x00b﻿é€", "plain"]) == ["ab??", "plain"]


def test_labels(spark):
    said = [" Court Filing.", "an email here", "nothing", '"photograph"']
    assert values(spark, tx.normalize_label(F.col("text")), said) == ["court_filing", "email", "other", "photograph"]


def test_names(spark):
    said = ["  Dr. John  SMITH, Jr.", "the Éva O'Neil-Ray", "Mr", None]
    assert values(spark, names.normalize_name(F.col("text")), said) == ["john smith jr", "éva o'neil-ray", "mr", None]


def test_markup(spark):
    html = '<p>a <mark class="x">b</mark> & <b>"c"</b></p>'
    assert values(spark, markup.keep_tags(F.col("text")), [html]) == ['a <mark>b</mark> & "c"']
    assert values(spark, markup.escape_html(F.col("text")), ['<a&"']) == ["&lt;a&amp;&quot;"]


def test_ids_agree_with_python(spark):
    texts = ["abc", "doc 1", "é", "x" * 50]
    got = values(spark, ids.uuid5(F.col("text")), texts)
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, t)) for t in texts]
    assert values(spark, ids.uuid_point_id(ids.uuid5(F.col("text"))), texts) == [
        uuid.uuid5(uuid.NAMESPACE_URL, t).int % 10**18 for t in texts
    ]
    assert values(spark, ids.chunk_point_id(F.col("text"), F.lit(3)), texts) == [
        int(hashlib.md5(f"{t}_v2_3".encode()).hexdigest()[:16], 16) % 10**18 for t in texts
    ]

    def poly(text):
        h = 0
        for c in text:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        return abs(h - 2**32 if h >= 2**31 else h)

    assert values(spark, ids.hash_point_id(F.col("text")), texts) == [poly(t) for t in texts]


@pytest.mark.parametrize("a,b,want", [
    ("martha", "marhta", 0.961111), ("dixon", "dicksonx", 0.813333), ("dwayne", "duane", 0.84), ("abc", "xyz", 0.0), ("", "a", 0.0), ("ab", "ab", 1.0),
])
def test_jaro_winkler(a, b, want):
    assert similarity.jaro_winkler_score(a, b) == pytest.approx(want, abs=1e-6)


def cut(spark, text, **opt):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    return chunking.chunk_text(df, **opt).orderBy("chunk_index").collect()


@pytest.mark.parametrize("n", [0, 6000, 6001, 6100, 11900, 20000])
def test_chunks_without_breaks(spark, n):
    rows = cut(spark, "x" * n)
    if n <= 6000:
        assert [(r.start_char, r.end_char) for r in rows] == [(0, n)]
        return
    assert rows[0].end_char == 6000 and rows[-1].end_char == n
    for a, b in zip(rows, rows[1:]):
        assert b.start_char == a.end_char - 500


def test_chunk_strict_keeps_the_tail(spark):
    text = "word " * 1180  # 5900 characters, one window of 5600 and a tail inside the next
    loose, strict = cut(spark, text, size=5600, overlap=500), cut(spark, text, size=5600, overlap=500, strict=True)
    assert len(strict) >= len(loose) and loose[-1].end_char == len(text)


def test_chunk_breaks_at_sentence(spark):
    text = "a" * 5990 + ". " + "b" * 3000
    first = cut(spark, text)[0]
    assert first.end_char == 5991 and first.text.endswith(".")


def test_chunk_most(spark):
    assert len(cut(spark, "y" * 50_000, size=1000, overlap=100, most=5)) == 5


def test_chunks_cover_the_text(spark):


    rng = random.Random(3)
    text = "".join(rng.choice("abc   .\n") for _ in range(5000))
    rows = cut(spark, text, size=700, overlap=60)
    covered = set()
    for r in rows:
        assert r.text == text[r.start_char : r.end_char].strip() and len(r.text) <= 700
        covered |= set(range(r.start_char, r.end_char))
    assert all(i in covered for i in range(len(text)) if not text[i].isspace())


def test_entity_json(spark):
    said = [
        '{"people": ["A B", 3], "organizations": [], "locations": ["C"]}',
        'Sure! {"people": ["X"], "other": {"a": {"b": 1}}} done',
        '{"people": ["A", "B"], "locations": ["C',
        "none",
        '{"unrelated": 1} and "people": ["Z"]',
    ]
    got = values(spark, extraction.parse_entity_json(F.col("text")), said)
    assert [None if g is None else (g.people, g.organizations, g.locations) for g in got] == [
        (["A B"], [], ["C"]), (["X"], [], []), (["A", "B"], [], []), None, (["Z"], [], []),
    ]


def test_findings(spark):
    text = "FINDING: Big one\nCONFIDENCE: high\nTYPE: Timeline Event\nENTITIES: NONE, A , B\n\nFINDING: abc\n\nDESCRIPTION: no title"
    df = spark.createDataFrame([(1, text)], "analysis_id int, analysis string")
    (row,) = extraction.parse_findings(df).collect()
    assert (row.title, row.confidence, row.finding_type, row.entities) == ("Big one", 0.85, "timeline_event", ["A", "B"])
    df = spark.createDataFrame([(1, "intro\n1. first item is long enough\nmore\n- short\n* second item also long enough")], "analysis_id int, analysis string")
    rows = extraction.parse_findings_naive(df).orderBy("item_no").collect()
    assert [r.title for r in rows] == ["first item is long enough", "second item also long enough"]


def test_entity_spans_brute(spark):
    docs = spark.createDataFrame([(1, "Ann Lee met ann. Annette saw Ann Lee"), (2, "nothing")], "doc_id bigint, text string")
    names_ = spark.createDataFrame([(1, "Ann"), (1, "Ann Lee"), (2, "Zed")], "doc_id bigint, name string")
    rows = extraction.entity_spans(docs, names_).orderBy("start_char").collect()
    assert [(r.start_char, r.length, r.name) for r in rows] == [(0, 3, "Ann"), (12, 3, "Ann"), (29, 3, "Ann")]


def test_names_in_blocks_match_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)] + ["É", "ß"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(60)] + [(99, None), (98, ""), (97, "w1 " * 3000)]
    names = [(" ".join(rng.choices(words, k=rng.randint(1, 4))), rng.choice(["Person", "Location"])) for _ in range(50)] + [("", "Location"), ("w1  W1", "Person"), ("...", "Location")]
    table, known = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(names, "name string, kind string")
    lists = {tuple(n.lower().split()) for n, k in names if len(n.split()) >= (2 if k == "Person" else 1)} - {("...",)}
    holds = lambda t, n: any(t[i : i + len(n)] == list(n) for i in range(len(t)))
    want = sorted((d, len(n)) for d, t in docs for n in lists if holds((t or "").lower().split(), n))
    for block in (200_000, 7):
        got = extraction.gazetteer_entities(table, known, block).collect()
        assert sorted((r.doc_id, len(r.name.split())) for r in got) == want and len(set(got)) == len(got)
    assert extraction.gazetteer_entities(table, known.limit(0)).count() == 0


def test_spans_match_repeated_searches():
    """The automaton against one search per name."""
    import re

    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice("aAbB _é1") for _ in range(rng.randint(0, 40)))
        names_ = sorted({"".join(rng.choice("abA é") for _ in range(rng.randint(1, 4))) for _ in range(6)})
        hits = []
        for order, name in enumerate(names_):
            at = 0
            while m := re.compile(re.escape(name), re.I).search(text, at):
                word = lambda i: 0 <= i < len(text) and re.match(r"[A-Za-z0-9_]", text[i]) is not None
                whole = word(m.start() - 1) != word(m.start()) and word(m.end() - 1) != word(m.end())
                hits += [(m.start(), order, m.end(), name)] if whole else []
                at = m.end() if whole else m.start() + 1
        want, free = [], 0
        for start, _, end, name in sorted(hits):
            if start >= free:
                want.append((start, end - start, name))
                free = end
        assert [(s["start_char"], s["length"], s["name"]) for s in extraction.find_spans(text, names_)] == want


def test_answers_of_any_depth_and_length(spark):
    """Against a scan of the characters and Python's parser."""
    import json

    def wanted(text):
        start, depth, inside, at = text.find("{"), 0, False, max(text.find("{"), 0)
        while at < len(text) and start >= 0:
            c = text[at]
            if c == "\\":
                at += 1
            elif c == '"':
                inside = not inside
            elif not inside and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    return text[start : at + 1]
            at += 1
        return None

    deep = {"x": 1}
    for _ in range(12):
        deep = {"m": deep, "people": ["not here"]}
    answers = [
        json.dumps({"people": ['A "Z" B', "}{", "a\\"], "m": deep}),
        "Sure: " + json.dumps({"m": deep, "people": ["X {y"], "locations": ["L}"]}) + ' as "asked" {"people": ["other"]}',
        json.dumps({"people": ["P"] * 3 + ["long \\ \" {" * 60_000]}),
        '{"people": ["cut', "no brace", "}{", "", '{"people": ["A"]} and {"people": ["B"]}', '\\{"people": ["after a backslash"]}',
    ]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)] + [(99, None)], "id int, raw string")
    got = {r.id: r.o for r in df.select("id", extraction.first_object(F.col("raw")).alias("o")).collect()}
    assert got == {i: wanted(a) for i, a in enumerate(answers)} | {99: None}
    parsed = {r.id: r.e and r.e.people for r in df.select("id", extraction.parse_entity_json(F.col("raw")).alias("e")).collect()}
    assert parsed[0] == ['A "Z" B', "}{", "a\\"] and parsed[1] == ["X {y"] and parsed[4] is None and parsed[7] == ["A"]
    assert parsed[2] == json.loads(answers[2])["people"]


def test_an_answer_is_parsed_once(spark, capsys):
    """No filter below the spreading of rows parses, too, and the parts of an answer share one parse."""
    said = ['{"people": ["A"], "locations": ["B", 3]}', None, "none", 'x "people": ["Z"]', "", '{"a": 1}', 'see {"a": 1} {"people": ["Q"]}']
    rows = spark.createDataFrame(list(enumerate(said)), "id int, raw string").repartition(3)
    lists = extraction.entity_lists(rows, "id", "raw")
    got = {r.id: (r.people, r.organizations, r.locations) for r in lists.collect()}
    assert got == {0: (["A"], [], ["B"]), 3: (["Z"], [], []), 5: ([], [], []), 6: (["Q"], [], [])}
    spark.conf.set("spark.sql.debug.maxToStringFields", 10_000)
    lists.select("id", *[F.array_join(k, "|").alias(k) for k in extraction.KINDS]).explain()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    plan = capsys.readouterr().out.lower()
    assert plan.count("generate") == 1 and "filter (" not in plan and plan.count("parsejson") + plan.count("parse_json") == 1


def test_query_terms():
    assert search.query_terms("The Long-term long Österreich") == ["long", "term", "österreich"]


def test_stored_index_gives_the_same_ranking(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "red green red"), (2, "green blue"), (3, "red red green green blue"), (4, "blue")], "doc_id bigint, text string"
    )
    search.write_token_index(docs, str(tmp_path / "idx"))
    index = spark.read.parquet(str(tmp_path / "idx"))
    for query in ("red green", "blue"):
        direct = [tuple(r) for r in search.fulltext(docs, query).select("doc_id", "score").collect()]
        assert direct == [tuple(r) for r in search.fulltext(docs, query, index=index).select("doc_id", "score").collect()]
    with pytest.raises(ValueError):
        search.fulltext(docs, "the of")


def test_sources_side_by_side_match_single_ones():
    """Packed pieces of a graph with hubs, and a path too long for tables of levels, against one source at a time."""
    import numpy as np

    from corpusgraph.functions import brandes

    rng = np.random.default_rng(6)
    ends = np.concatenate([rng.integers(0, 300, (900, 2)), [(0, i) for i in range(1, 300)]])
    for ends in (ends, np.array([(i, i + 1) for i in range(40)])):
        pairs = np.unique([(a, b) for x, y in ends for a, b in ((x, y), (y, x)) if a != b], axis=0)
        whole = brandes.Graph.of(*pairs.T)
        n = len(whole.ids)
        sizes, near = np.bincount(pairs[:, 0], minlength=n).astype("<i4"), pairs[:, 1].astype("<i4")
        cut = sizes[: n // 3].sum()
        packed = brandes.Graph.packed([sizes[: n // 3].tobytes(), sizes[n // 3 :].tobytes()], [near[:cut].tobytes(), near[cut:].tobytes()])
        sources = np.arange(0, n, 3)
        want = sum(whole.dependencies(i) for i in sources)
        assert want.max() > 1 and np.allclose(packed.summed(sources), want, atol=1e-9)
