"""Vector codes, packing and hard negatives against brute force and edge rows."""

import random
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusgraph.llm import hardneg, packing, veccodes

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [[float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("-inf")] + [1.0] * 7, None, [], [1.0, 2.0]]


def vectors(spark, rows):
    """Rows (id, vector, label) under the tables' names, with columns that clash with the operators' own."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumn("code", F.lit("x")).withColumn("error", F.lit(-1)).withColumn("v", F.lit(0)).withColumn("score", F.lit(0))


def kept(rows, dims):
    return [r for r in rows if r[1] is not None and len(r[1]) == dims and all(x is not None and np.isfinite(x) for x in r[1])]


# vector codes

def test_limb_products_are_exact():
    rnd = np.random.default_rng(1)
    for bits, dims in product((1, 20, 24, 27, 29), (1, 7, 16, 100)):
        a, b = (rnd.integers(-(1 << bits), 1 << bits, (5, dims), endpoint=True) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        assert veccodes.products(a, b).tolist() == want
    for x in (np.array([[0, -1, (1 << 40) + 3, -(1 << 40)]]),):
        assert sum(limb.astype(int) << (24 * i) for i, limb in enumerate(veccodes.limbs(x, 24))).tolist() == x.tolist()


def brute_codes(rows, parts, entries, rounds, scale):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    whole = [[int(np.floor(x * scale)) for x in r[1]] for r in rows]
    width = len(whole[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            for k, g in groups.items():
                books[p][k] = tuple(sum(col) // len(g) for col in zip(*g))
    told = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in t) for t in told]
    by_label = Counter()
    for r, e in zip(rows, errors):
        by_label[r[2]] += e
    sha = veccodes.digest(np.array(books))
    return sorted((repr(r[0]), "".join(f"{k:02x}" for _, k in t), e, by_label[r[2]], sha) for r, t, e in zip(rows, told, errors))


@pytest.mark.parametrize("scale", [4, 1024, 1 << 22])
def test_codes_match_brute_force(spark, scale):
    rnd = random.Random(scale)
    rows = [(i * 3 - 40, [rnd.gauss(0, 1) for _ in range(8)], rnd.choice([0, 0, 0, 1, None])) for i in range(60)]
    rows += [(1000 + i, rows[7][1], 0) for i in range(40)] + [(5, rows[9][1], 1)] * 2 + [(None, rows[3][1], None)] + [(-500, [0.0] * 8, 2)]
    odd = [(-9999 - i, v, 0) for i, v in enumerate(ODD)]
    got = veccodes.compress(vectors(spark, rows + odd).repartition(5), parts=4, entries=9, rounds=3, scale=scale)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((repr(r[0]), *r[1:]) for r in got.collect()) == brute_codes(kept(rows, 8), 4, 9, 3, scale)


def test_codes_of_few_empty_and_huge(spark):
    three = vectors(spark, [(i, [float(i)] * 4, None) for i in range(3)])
    assert [(r.code, r.error, r.label_error) for r in veccodes.compress(three).orderBy("vec_id").collect()] == [("00" * 4, 0, 0), ("01" * 4, 0, 0), ("02" * 4, 0, 0)]
    assert veccodes.compress(three.limit(0)).count() == 0
    assert veccodes.compress(vectors(spark, [(1, None, 1), (2, [None], 1)])).count() == 0
    with pytest.raises(ValueError):
        veccodes.compress(vectors(spark, [(1, [1.0] * 6, 1)]))
    with pytest.raises(OverflowError):
        veccodes.compress(vectors(spark, [(i, [1e30] * 4, 1) for i in range(300)])).count()


# hard negatives

def test_table_lookups_give_inner_products():
    rnd = np.random.default_rng(2)
    for dims, size in product((1, 8, 13, 64), (1, 200, 1 << 20)):
        a, x = rnd.integers(-size, size, (4, dims)), rnd.integers(-size, size, (9, dims))
        got = hardneg.scores(hardneg.subset_sums(a, np.int64), hardneg.bit_planes(x))
        assert got.tolist() == (x @ a.T).tolist()
    for x in (np.zeros((2, 3), np.int64), np.full((2, 3), -1), np.full((1, 3), 5)):
        assert hardneg.scores(hardneg.subset_sums(np.eye(3, dtype=np.int64), np.int64), hardneg.bit_planes(x)).tolist() == x.tolist()


def brute_negatives(rows, every, positives, negatives, least, most, scale):
    use = [(i, [int(np.floor(x * scale)) for x in v], y) for i, v, y in rows if i is not None and y is not None]
    out = []
    for i, v, y in use:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, z) for j, w, z in use if j != i]
        for s, j, _ in sorted(r for r in scored if r[2] == y)[:positives]:
            fit = sorted(r for r in scored if r[2] != y and least * -s <= -100 * r[0] <= most * -s)
            out += [(i, j, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fit[:negatives])]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 256, 1 << 20])
def test_hard_negatives_match_brute_force(spark, scale, monkeypatch):
    monkeypatch.setattr(hardneg, "ROWS", 50)
    rnd = random.Random(scale)
    base = [rnd.gauss(0, 1) for _ in range(8)]
    rows = [(i, [b + rnd.gauss(0, 0.7) for b in base], rnd.choice([0, 0, 1, 2])) for i in range(-20, 150)]
    rows += [(1000 + i, rows[4][1], i % 2) for i in range(70)]  # a third of all rows, equal scores
    rows += [(10, rows[30][1], 0)] * 2 + [(30, rows[9][1], 7)] + [(None, base, 0), (3000, base, None), (3010, [0.0] * 8, 1)]
    odd = [(-1000 - 10 * i, v, 0) for i, v in enumerate(ODD)]
    table = vectors(spark, rows + odd).repartition(4)
    want = brute_negatives(kept(rows, 8), 10, 5, 3, 50, 95, scale)
    assert len(want) > 100
    for block in (4096, 6):
        got = hardneg.mine(table, F.col("vec_id") % 10 == 0, scale=scale, block=block)
        assert sorted(map(tuple, got.collect())) == want


def test_hard_negatives_of_few_and_none(spark):
    ask = F.col("vec_id") % 50 == 0
    table = vectors(spark, [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.9, 0.9], 1), (3, [-1.0, -1.0], 1)])
    assert [tuple(r) for r in hardneg.mine(table, ask, scale=100).collect()] == [(0, 1, 1, 2, 20000, 18000)]
    assert hardneg.mine(table.filter("vec_id > 0"), ask).count() == 0
    assert hardneg.mine(table.limit(0), ask).count() == 0
    assert hardneg.mine(vectors(spark, [(0, None, 1)]), ask).count() == 0


# packing

def legal(demand, plan, capacity, wholes):
    """Every piece placed once, sequences gapless, full or a power of two; number of sequences."""
    found = defaultdict(list)
    for length, n in demand.items():
        for rank in range(n):
            got = packing.places(plan, length, rank)
            assert got[0][0] == 0 and sum(g[1] for g in got) == length
            assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))
            for _, size, sequence, offset in got:
                found[sequence].append((offset, size))
    assert sorted(found) == list(range(wholes, wholes + len(found)))
    short = 0
    for pieces in found.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity and at & (at - 1) == 0
        short += at < capacity
    assert short < capacity.bit_length()
    return len(found)


def test_plans_are_legal_and_full():
    rnd = random.Random(4)
    cases = [{1: 1}, {5: 1}, {1500: 10}, {1100: 1000}, {1100: 300, 3: 2}, {2047: 7}, {1: 5000}, {683: 100, 1: 1}, {n: 1 for n in range(1, 2048)}]
    for demand in cases:
        legal(demand, packing.plan(demand, 3, 2048), 2048, 3)
    for _ in range(60):
        capacity = 2 ** rnd.randint(1, 8)
        demand = {rnd.randint(1, capacity - 1): rnd.randint(1, 10 ** rnd.randint(1, 3)) for _ in range(rnd.randint(1, 40))}
        legal(demand, packing.plan(demand, 0, capacity, classes=rnd.randint(1, 200)), capacity, 0)


def patterns_within(lengths, capacity):
    if not lengths:
        return [()]
    first, rest = lengths[0], lengths[1:]
    return [(k, *p) for k in range(capacity // first + 1) for p in patterns_within(rest, capacity - k * first)]


def test_column_generation_reaches_the_optimum():
    """Strong duality: no pattern at all is worth more than one, and the duals price the demand at the objective."""
    rnd = random.Random(5)
    for _ in range(25):
        capacity = rnd.randint(12, 40)
        lengths = rnd.sample(range(2, capacity), 5)
        demand = {n: rnd.randint(1, 60) for n in lengths}
        columns, x, dual = packing.generate(demand, capacity, gap=0.0)
        lengths = sorted(lengths)
        for i, n in enumerate(lengths):
            assert abs(sum(c[n] * t for c, t in zip(columns, x)) - demand[n]) < 1e-6
        volume = sum(n * k for n, k in demand.items()) / capacity
        best = max(np.dot(p, dual) for p in patterns_within(lengths, capacity))
        assert best <= 1 + 1e-6 or x.sum() <= volume + 1e-6
        if best <= 1 + 1e-6:
            assert abs(np.dot(dual, [demand[n] for n in lengths]) - x.sum()) < 1e-6


def test_words_give_the_tokenizer_s_ids(spark, sf):
    """The remembered words against the library on whole texts, odd characters among them."""
    words, plain = packing.Words(open(TOKENIZER).read()), Tokenizer.from_file(TOKENIZER)
    rnd = random.Random(6)
    alphabet = "aZ9é ß'ſİẞ.,;:!?\n\t\r\x0b\x0c\x1c\x85  ̸́ΣσЖ中😀#<|>-\x00" + "  ab"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["", " ", "it's, he'll.", "a<|endoftext|>b <|startoftext|>, x", "ΑΣ ΑΣ, Σ.", "x<|endoftext|>, y<|endoftext|>", "a--b-- 3%% é*** ß'. n't, o'", "_a_ __ (b) [c] `d` e\u0301, \u0301.", "İstanbul, İ.", "x" * 5000, "é, e ́.", "1,2 3, 4.5."]
    texts += spark.read.parquet(f"{sf}/documents.parquet").toPandas().text.tolist()
    for _ in range(2):
        for at in range(0, len(texts), 64):
            part = texts[at : at + 64]
            got = [np.frombuffer(b, "<u4").tolist() for b in words.ids(pa.array(part))]
            assert got == [e.ids for e in plain.encode_batch(part, add_special_tokens=False)]
    assert words.apart


def pieces_are_whole(rows, got, capacity):
    """Pieces of every document joined give its ids; sequences are gapless and unpadded."""
    plain = Tokenizer.from_file(TOKENIZER)
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and at & (at - 1) == 0
    total = sum(map(len, ids.values()))
    assert len(by_sequence) <= total // capacity + capacity.bit_length()


def test_marks_at_the_end_of_words_take_no_place(monkeypatch):
    """Words are remembered without the marks behind them, and those of the texts at hand are not learnt twice."""
    words, plain = packing.Words(open(TOKENIZER).read()), Tokenizer.from_file(TOKENIZER)
    ids = lambda texts: [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    texts = ["one, One. one!?", "", "one...", ".two", "one.\n(two) it's, 3;", "été, x\u0301. <b>", "a\x1c. b.\u00a0c", ".", "", ":"]
    assert words.ids(pa.array(["one, two. one two!? three"]).slice(0)) == ids(["one, two. one two!? three"])
    assert set(words) == {"one", "two", "three", ",", ".", "!?"}
    for array in (pa.array(texts), pa.array(["out."] + texts + ["out"]).slice(1, len(texts)), pa.array(texts, pa.large_string())):
        assert words.ids(array) == ids(texts)
    assert words.ids(pa.array(["", ""])) == [b"", b""] and words.ids(pa.array([], pa.string())) == []
    added = ["a<|endoftext|>.", "b, <|startoftext|>", "c."]
    assert words.ids(pa.array(added)) == ids(added)
    learnt = []
    learn = words.learn
    monkeypatch.setattr(words, "learn", lambda new: (learnt.extend(new), learn(new)), raising=False)
    monkeypatch.setattr(packing, "WORDS", 1)
    assert words.ids(pa.array(["one two four"])) == ids(["one two four"])
    assert learnt == ["four"] and set(words) == {"one", "two", "four"}


def test_packed_documents_are_whole(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(-1, None), (-2, ""), (-3, " \n"), (-4, "long word " * 6000), (-5, "x" * 9000)]
    rows += [(10**6 + i, "the same text of a third of all rows") for i in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(0)).withColumn("rank", F.lit("r"))
    for capacity in (2048, 64):
        got = packing.pack(table.repartition(6), TOKENIZER, capacity=capacity).collect()
        pieces_are_whole(rows, got, capacity)


def test_packing_of_repeats_nothing_and_odd_sizes(spark):
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    got = packing.pack(twice, TOKENIZER, capacity=4).collect()
    assert sum(r.length for r in got) == 3 + 3 + 2 and sorted({str(r.doc_id) for r in got}) == ["1", "None"]
    empty = packing.pack(twice.limit(0), TOKENIZER)
    assert empty.count() == 0 and empty.columns == ["doc_id", *(f.split()[0] for f in packing.RESULT.split(", "))]
    with pytest.raises(ValueError):
        packing.pack(twice, TOKENIZER, capacity=100)
