"""The stored indexes against scans of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from corpusgraph.operators import search, textindex


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["red", "blue", "Red-blue", "the"]
    rows = [(i, " ".join(rng.choices(words, [1] * 40 + [8, 6, 3, 9], k=rng.randint(1, 30))), "s") for i in range(600)]
    rows += [(1000 + i, "red blue", "s") for i in range(300)]  # a third of all documents ties
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "red " * 400 + "blue", "s"), (5003, "%_\\ 100% ÄÖ", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").cache()


@pytest.fixture(scope="module")
def paths(docs, tmp_path_factory):
    base = tmp_path_factory.mktemp("index")
    textindex.write_block_index(docs, f"{base}/words", segment=50)
    textindex.write_trigram_index(docs, "doc_id", "text", f"{base}/grams", segment=50)
    textindex.write_trigram_index(docs, "doc_id", "text", f"{base}/starts", anchored=True, segment=50)
    return {n: f"{base}/{n}" for n in ("words", "grams", "starts")}


@pytest.mark.parametrize("query", ["red blue", "w3 w7", "w1", "nowhere red"])
def test_ranked_pages_equal_the_scan(spark, docs, paths, query):
    terms = search.query_terms(query)
    total = F.lit(docs.count())
    whole = search.rank_documents(search.postings(docs, terms), terms, total).orderBy(F.desc(F.round("score", 9)), "doc_id").collect()
    for limit, offset in ((1, 0), (25, 30), (5, 895)):
        got = textindex.ranked(spark, paths["words"], query, limit, offset).collect()
        want = whole[offset : offset + limit]
        assert [r.doc_id for r in got] == [r.doc_id for r in want]
        assert [round(r.score, 9) for r in got] == [round(r.score, 9) for r in want]


def test_pages_show_the_scan_s_snippets(docs, paths):
    key = lambda rows: [(r.doc_id, round(r.score, 9), r.snippet) for r in rows]
    assert key(textindex.fulltext(docs, paths["words"], "red w5", limit=7).collect()) == key(search.fulltext(docs, "red w5", limit=7).collect())
    with pytest.raises(ValueError):
        textindex.fulltext(docs, paths["words"], "the")


def test_blocks_are_read_by_folder_and_skipped_by_bound(spark, paths):
    plan = textindex._read(spark, paths["words"], "token", ["red"])._jdf.queryExecution().toString()
    assert "(bucket#" in plan.split("PartitionFilters: ")[1].split("]")[0] and "EqualTo(token,red)" in plan.split("PushedFilters: ")[1].split("]")[0]
    blocks = spark.read.parquet(f"{paths['words']}/blocks").where("token = 'red'")
    assert blocks.count() > 5 and blocks.agg(F.max("n")).first()[0] < 120
    # The one document that repeats "red" bounds its segment above all others.
    assert textindex.ranked(spark, paths["words"], "red", 1).first().doc_id == 5002


@pytest.mark.parametrize("name", ["red blue", "D-b", "100%", "_\\", "äö", "zzz", "re", ""])
def test_substrings_and_prefixes_equal_the_scan(docs, paths, name):
    like = search.like_pattern(name)
    got = sorted(r.doc_id for r in textindex.containing(docs, paths["grams"], name).collect())
    assert got == sorted(r.doc_id for r in docs.where(F.col("text").ilike(f"%{like}%")).collect())
    got = sorted(r.doc_id for r in textindex.containing(docs, paths["starts"], name, prefix=True).collect())
    assert got == sorted(r.doc_id for r in docs.where(F.col("text").ilike(f"{like}%")).collect())


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    textindex.write_block_index(none, str(tmp_path / "w"))
    textindex.write_trigram_index(none, "doc_id", "text", str(tmp_path / "g"))
    assert textindex.ranked(spark, str(tmp_path / "w"), "red").count() == 0
    assert textindex.containing(none, str(tmp_path / "g"), "red").count() == 0


def test_trigrams_are_code_points_and_need_no_loop(spark, capsys):
    """Against brute force, with line ends, combining marks and characters beyond the basic plane; one pattern finds them."""
    texts = ["", "ab", "abc", "aBcabC", "a\nb\r\nc\u2028d", "x\U0001f600y\U0001f600\U0001f601z", "\U0001f600\U0001f601", "e\u0301e\u0301 é", "aaaa", "\x00\x02\x02t", "日本語日本語", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", textindex.trigrams(F.col("text")).alias("g"))
    want = [t if t is None else list(dict.fromkeys(t.lower()[i : i + 3] for i in range(len(t.lower()) - 2))) for t in texts]
    assert [r.g for r in rows.orderBy("id").collect()] == want
    rows.explain()
    assert "lambda" not in capsys.readouterr().out


def test_blocks_are_gathered_where_their_texts_lie(spark, tmp_path, monkeypatch):
    """Against brute force, with null and repeated ids and segments of several batches; no shuffle of words, no sample."""
    texts = ["Red, red blue", None, "", "the IS", "ÄÖ äö 12-ab", "red"] * 7
    rows = [(None if i % 5 == 4 else i % 9, t) for i, t in enumerate(texts)]
    want = {}
    for doc, text in rows:
        for w in (text or "").lower().replace(",", " ").replace("-", " ").split():
            if w not in search.STOP_WORDS:
                want.setdefault(w, {}).setdefault(doc, 0)
                want[w][doc] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plans, write = [], textindex._write
    monkeypatch.setattr(textindex, "_write", lambda *a: (plans.append(a[-1]._jdf.queryExecution().executedPlan().toString()), write(*a)))
    monkeypatch.setattr(type(docs), "repartitionByRange", None)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("10000", "2"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            path = str(tmp_path / most)
            textindex.write_block_index(docs, path, segment=20)
            got, parts = {}, []
            for r in spark.read.parquet(f"{path}/blocks").collect():
                assert r.n == len(r.docs) == len(r.tfs) and r.max_tf == max(r.tfs)
                got.setdefault(r.token, {}).update(zip(r.docs, r.tfs))
                parts.append((r.token, r.segment))
            assert got == want and len(parts) == len(set(parts)) and len({s for _, s in parts}) > 1
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [p.count("Exchange") for p in plans] == [1, 1]
