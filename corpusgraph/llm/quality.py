"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= j) = sigmoid(t_j - w.x): one shared weight per hashed feature and
ordered thresholds t_0 < t_1 < ... give the expected grade and the probability
of each tail P(grade >= j).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import CACHE, rows_of, stored

#: Most labelled rows that a model is fitted on, and parts they are kept in.
SAMPLE = 20_000
PARTS = 12
#: A feature counts in a model if so many sampled documents have it and its
#: count below some threshold is so many standard deviations off its share.
LEAST_DOCS = 8
LEAST_Z = 6.0
#: Least probability of the top grade for a document to be accepted.
LEAST_TAIL = 0.5
#: Grades of a document: harmful, poor, good.
GRADES = 3
#: Letters of a longer word's stem, a feature of its own.
STEM = 5
ROUNDS = 40
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class FeatureHashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[token] = xxhash.xxh3_64_intdigest(token) >> 1
        return value


def features(text: str | None, seen: FeatureHashes) -> np.ndarray:
    """Distinct hashed features of a whole text: words, marks, letter case and repetition.

    A feature is present or absent, so one telling word counts alike in a short
    and in a very long text.
    """
    text = text or ""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.array([seen["#empty"]], np.int64)
    distinct = set(tokens)
    out = {t.lower() for t in distinct}
    out.update([f"{t[:STEM]}~" for t in out if len(t) > STEM])
    n, letters = len(tokens), sum(map(len, tokens))
    upper = sum(map(str.isupper, text))
    marks = sum(len(t) for t in tokens if not t[0].isalnum())
    # Shares say little of a few words.
    if n >= 30:
        out.add(f"#upper {min(10, 10 * upper // max(1, letters))}")
        out.add(f"#marks {min(10, 20 * marks // max(1, letters))}")
        out.add(f"#distinct {10 * len(distinct) // n}")
    return np.unique(np.array([seen[t] for t in out], np.int64))


def graded(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 harmful, 1 poor, 2 good. Rows with nulls or without a single verdict go."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", grade.alias("grade"))
    return known.groupBy("doc_id").agg(F.min("grade").alias("grade"), F.max("grade").alias("top")).filter("grade = top").select("doc_id", "grade")


def bounded(rows: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """At most about ``most`` rows, chosen by a hash of ``key``; all of them if they are fewer."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / n))


@dataclass
class OrdinalModel:
    index: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    cuts: np.ndarray  # ordered thresholds

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        return np.array([self.score(f) for f in found])

    def score(self, found: np.ndarray) -> float:
        if not len(self.index):
            return 0.0
        at = np.minimum(np.searchsorted(self.index, found), len(self.index) - 1)
        return float(self.weights[at[self.index[at] == found]].sum())

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1..top, one column each."""
        return 1 / (1 + np.exp(-(score[:, None] - self.cuts[None, :])))


def featurised(docs: DataFrame, extra: list[str]) -> DataFrame:
    """``extra`` columns and ``found`` (array<long>) per document."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = FeatureHashes()
        for whole in batches:
            for batch in rows_of(whole):
                found = [features(t, seen) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in extra), pa.array(found, pa.list_(pa.int64()))], names=[*extra, "found"])

    return docs.select(*extra, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in extra) + ", found array<long>")


def _csr(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grades, ids, starts, at = [], [], [], 0
    for b in batches:
        lists = b.column("at")
        grades.append(b.column("grade").to_numpy(zero_copy_only=False))
        ids.append(lists.flatten().to_numpy(zero_copy_only=False))
        starts.append(at + (lists.offsets.to_numpy() - lists.offsets[0].as_py())[:-1])
        at += len(ids[-1])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (grades, ids, starts))


def gradient(batches, weights: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
    """Log loss of a part and its gradients by weight and by threshold."""
    grade, ids, starts = _csr(batches)
    if not len(grade):
        return 0.0, np.zeros_like(weights), np.zeros_like(cuts), 0
    row = np.repeat(np.arange(len(grade)), np.diff(np.append(starts, len(ids))))
    score = np.bincount(row, weights=weights[ids], minlength=len(grade))
    edges = np.concatenate(([-np.inf], cuts, [np.inf]))
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    hi, lo = sig(edges[grade + 1] - score), sig(edges[grade] - score)
    hi, lo = np.where(np.isinf(edges[grade + 1]), 1.0, hi), np.where(np.isinf(edges[grade]), 0.0, lo)
    p = np.maximum(hi - lo, 1e-12)
    dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
    by_score = dhi - dlo  # of -log p
    by_weight = np.bincount(ids, weights=by_score[row], minlength=len(weights))
    by_cut = np.zeros(len(cuts) + 2)
    np.add.at(by_cut, grade + 1, -dhi)
    np.add.at(by_cut, grade, dlo)
    return float(-np.log(p).sum()), by_weight, by_cut[1:-1], len(grade)


def telling(found: DataFrame, counts: dict[int, int], least_docs: int, least_z: float = LEAST_Z) -> DataFrame:
    """``f, n``: the features whose documents lie unevenly about some threshold between grades."""
    total, top = sum(counts.values()), max(counts, default=0)
    seen = found.select("grade", F.explode("found").alias("f")).groupBy("f").agg(
        F.count("*").alias("n"), *(F.count(F.when(F.col("grade") <= g, 1)).alias(f"below{g}") for g in range(top))
    )
    far = F.lit(False)
    for g in range(top):
        p = sum(counts.get(x, 0) for x in range(g + 1)) / max(1, total)
        far = far | (F.abs(F.col(f"below{g}") - F.col("n") * p) - 0.5 >= least_z * F.sqrt(F.col("n") * p * (1 - p)))
    return seen.filter((F.col("n") >= least_docs) & far).select("f", "n")


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, ridge: float = 2e-4, least_docs: int = LEAST_DOCS, grades: int = GRADES) -> OrdinalModel:
    """A cumulative-link model of ``ratings`` (``doc_id, grade`` from 0 up) on the texts of ``docs``.

    Fitted on at most ``sample`` rated documents, by full-gradient steps whose
    sums Spark adds up over the parts of the stored sample; the model's size is
    bounded by the sample. There are ``grades`` grades, or more if rated so. One
    grade only gives a model without weights whose thresholds follow the counts;
    with no rated document nothing speaks against a text, and all are accepted.
    """
    spark = docs.sparkSession
    rated = stored(bounded(ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").select("doc_id", F.col("grade").cast("int").alias("grade")), sample), "ratings")
    # The bound on ``sample`` bounds this broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")
    found = stored(featurised(texts, ["doc_id", "grade"]), "rated-features")
    counts = {r.grade: r.n for r in found.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    top = max([grades - 1, *counts])
    total = sum(counts.values())
    below = np.cumsum([counts.get(g, 0) for g in range(top)])
    share = np.clip((below + 0.5) / (total + 1), 1e-4, 1 - 1e-4)
    cuts = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-6 * np.arange(top))
    if not total:
        cuts = 1e-6 * np.arange(-top, 0)
    kept = telling(found, counts, least_docs).orderBy("f").toPandas()
    index, seen_in = kept["f"].to_numpy(np.int64), kept["n"].to_numpy(float)
    if len(counts) < 2 or not len(index):
        return OrdinalModel(index[:0], np.zeros(0), cuts)
    shared = spark.sparkContext.broadcast(index)

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            lists = []
            for f in b.column("found"):
                f = f.values.to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(index, f), len(index) - 1)
                at = at[index[at] == f]
                lists.append(at if len(at) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(lists, pa.list_(pa.int64()))], names=["grade", "at"])

    coded = stored(found.repartition(PARTS, F.xxhash64("doc_id")).mapInArrow(positions, "grade int, at array<long>"), "coded")
    n = len(index)
    weights, moved, speed = np.zeros(n), np.zeros(n + top), np.zeros(n + top)
    point = np.concatenate([weights, cuts])
    # Steps scaled by how often a feature is seen: rare features move as fast as common ones.
    scale = np.concatenate([1 / np.sqrt(seen_in / total), np.ones(top)])
    best, best_loss, size = point, np.inf, 0.5
    for r in range(1, rounds + 1):
        state = spark.sparkContext.broadcast((point[:n].copy(), point[n:].copy()))

        def part(batches, state=state):
            loss, by_weight, by_cut, rows = gradient(batches, *state.value)
            yield pa.RecordBatch.from_pydict({"loss": [loss], "rows": [rows], "g": [np.concatenate([by_weight, by_cut]).tobytes()]})

        # One row per part of the bounded sample.
        sums = coded.mapInArrow(part, "loss double, rows long, g binary").collect()
        state.unpersist()
        rows = max(1, sum(s["rows"] for s in sums))
        loss = sum(s["loss"] for s in sums) / rows + ridge / 2 * float(point[:n] @ point[:n])
        if loss < best_loss:
            best, best_loss = point, loss
        elif loss > 1.02 * best_loss:
            # Overshot: go back to the best point and on from there in smaller steps.
            point, size, moved = best, size / 2, 0 * moved
            continue
        g = sum(np.frombuffer(s["g"], float) for s in sums) / rows
        g[:n] += ridge * point[:n]
        g *= scale
        moved = 0.9 * moved + 0.1 * g
        speed = 0.99 * speed + 0.01 * g * g
        step = size * (moved / (1 - 0.9**r)) / (np.sqrt(speed / (1 - 0.99**r)) + 1e-6) / (1 + r / 20)
        point = point - step
        # Features only count against a document: a short text is not poor for want of praise.
        point[:n] = np.minimum(point[:n], 0)
        point[n:] = np.maximum.accumulate(point[n:] + 1e-6 * np.arange(top))
    return OrdinalModel(index, best[:n], best[n:])


def rate(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs`` with ``expected_grade`` (double) and ``tails`` (P(grade >= 1), P(grade >= 2), ...).

    A null or empty text is rated by its emptiness; columns named like the new
    ones are replaced, all others pass through.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def tails(texts: pd.Series) -> pd.Series:
        seen = FeatureHashes()
        score = held.value.scores([features(t, seen) for t in texts])
        return pd.Series(list(held.value.tails(score)))

    rated = docs.drop("expected_grade", "tails").withColumn("tails", tails(F.col("text")))
    return rated.withColumn("expected_grade", F.aggregate("tails", F.lit(0.0), lambda a, x: a + x))


def accepted(tails: Column, grade: int = 2, least: float = LEAST_TAIL) -> Column:
    """Whether a document reaches ``grade`` with probability ``least`` or more."""
    return F.element_at(tails, grade) >= least
