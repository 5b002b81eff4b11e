"""Mixing sources to target weights by soft membership.

A classifier fitted on a labelled table gives every document a probability for
each domain. Newton steps on one multiplier per domain then find nonnegative
document rates, near 1, whose expected tokens per domain meet the targets.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import stored
from corpusgraph.llm.quality import bounded

#: Most labelled rows that the classifier is fitted on, and its hashed features.
SAMPLE = 10_000
FEATURES = 1 << 16
#: Rounds a problem may take before it is an error, weight of the pull to rate 1 against the misfit, and misfit that ends the search.
ROUNDS = 60
PULL = 1e-3
CLOSE = 1e-4
#: Step lengths tried in one pass, and powers of ten by which the pull may fall for the targets' sake.
STEPS = 8
WEAKER = 6


def domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain`` of the labelled table: junk, toxic or clean. Rows with nulls or contrary labels go."""
    name = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").otherwise("clean")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select("doc_id", name.alias("domain"))
    return known.groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("other")).filter("domain = other").select("doc_id", "domain")


def _words(docs: DataFrame) -> DataFrame:
    """Words and marks of the whole text, each once, as the classifier's features."""
    tokens = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+", gaps=False, toLowercase=True)
    cased = F.concat_ws(" ", F.coalesce("text", F.lit("")), F.when(F.coalesce("text", F.lit("")).rlike(r"(\p{Lu}{3,}\W+){5}"), "shouting"))
    return tokens.transform(docs.withColumn("_text", cased)).drop("_text")


def posteriors(docs: DataFrame, labelled: DataFrame, names: list[str], sample: int = SAMPLE) -> DataFrame:
    """``doc_id, tokens, p`` per row of ``docs``: whitespace tokens and a probability for each of ``names``.

    The classifier is fitted on at most ``sample`` labelled documents; every
    document is rated. Domains that no label shows get probability 0; with no
    usable label all domains are equally likely.
    """
    rated = stored(bounded(labelled.filter(F.col("domain").isin(names)), sample), "domains")
    # The bound on ``sample`` bounds this broadcast.
    train = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")
    code = F.array_position(F.array(*map(F.lit, names)), F.col("domain")) - 1
    train = stored(_words(train.withColumn("label", code.cast("double"))).select("label", F.array_distinct("_words").alias("_words")), "domain-words")
    tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    rows = docs.select("doc_id", "text", tokens.alias("tokens"))
    seen = sorted(int(r.label) for r in train.select("label").distinct().collect())
    if len(seen) < 2:
        flat = [1.0 if seen == [k] else 0.0 if seen else 1 / len(names) for k in range(len(names))]
        return rows.select("doc_id", "tokens", F.array(*map(F.lit, flat)).alias("p"))
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=FEATURES, binary=True)
    model = Pipeline(stages=[hashed, LogisticRegression(featuresCol="_tf", family="multinomial", regParam=0.003, maxIter=25, probabilityCol="_p", maxBlockSizeInMB=8)]).fit(train)
    out = model.transform(_words(rows).select("doc_id", "tokens", F.array_distinct("_words").alias("_words")))
    p = vector_to_array("_p")
    # The model knows labels 0..max; one it never saw has no probability.
    return out.select("doc_id", "tokens", F.array(*(F.get(p, F.lit(k)) if k in seen else F.lit(0.0) for k in range(len(names)))).alias("p"))


def _rates(p: np.ndarray, tokens: np.ndarray, dual: np.ndarray, low: float, high: float) -> np.ndarray:
    """Rates at the given multipliers: a row's own shares decide, not its length. No tokens, no change."""
    return np.where(tokens > 0, np.clip(1 - p @ dual, low, high), 1.0)


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return p, batch.column("tokens").to_numpy(zero_copy_only=False).astype(float)


def fit_rates(rated: DataFrame, targets: np.ndarray, rounds: int = ROUNDS, pull: float = PULL, low: float = 0.0, high: float = np.inf) -> tuple[DataFrame, np.ndarray]:
    """``rated`` with ``rate``, and the expected tokens per domain that the rates give.

    Of the rates in [low, high] whose expected tokens per domain are within
    ``CLOSE`` of ``targets``, those near 1 in squares weighted by tokens. If no
    rates meet the targets, those that minimise the squared misfit plus
    ``pull`` times these squares, as shares of all tokens; the misfit shows in
    the second result. Either is a convex problem in K multipliers, solved by
    Newton steps. One step is one pass over the stored posteriors that adds up
    the gradient and the K x K curvature for a few step lengths; rows keep no
    state. Raises if ``rounds`` steps do not settle a problem.
    """
    k = len(targets)
    spark = rated.sparkSession
    total = rated.agg(F.sum("tokens")).first()[0]
    if not total:
        return rated.withColumn("rate", F.lit(1.0)), np.zeros(k)
    goal = targets / total
    close = CLOSE * max(np.abs(goal).max(), 1e-12)
    width = 1 + k + k * k

    def sums(duals: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Per candidate: value of the dual without its penalty, tokens per domain, curvature."""

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(duals), width))
            for b in batches:
                p, tokens = _columns(b, k)
                for i, dual in enumerate(duals):
                    r, s = _rates(p, tokens, dual, low, high), p @ dual
                    free = tokens * ((1 - s > low) & (1 - s < high))
                    out[i, 0] += tokens @ (-((r - 1) ** 2) / 2 - r * s)
                    out[i, 1 : 1 + k] += (r * tokens) @ p
                    out[i, 1 + k :] += ((p * free[:, None]).T @ p).ravel()
            yield pa.RecordBatch.from_pydict({"sums": [out.tobytes()]})

        # One row per part, of a few K x K numbers.
        rows = rated.select("tokens", "p").mapInArrow(part, "sums binary").collect()
        added = sum(np.frombuffer(x.sums).reshape(len(duals), width) for x in rows) / total
        return [(x[0] + goal @ d, x[1 : 1 + k], x[1 + k :].reshape(k, k)) for x, d in zip(added, duals)]

    def settle(dual: np.ndarray, at: tuple, penalty: float) -> tuple[np.ndarray, tuple]:
        """The optimum for a penalty on the multipliers, or the first point on the way that meets the targets."""
        for _ in range(rounds):
            value, have, curve = at
            slope = have - goal - penalty * dual
            if np.abs(have - goal).max() <= close or np.abs(slope).max() <= close / 10:
                return dual, at
            step = np.linalg.solve(curve + penalty * np.eye(k), slope)
            tries = [dual + step / 4**j for j in range(STEPS)]
            found = sums(tries)
            best = min(range(STEPS), key=lambda i: found[i][0] + penalty / 2 * tries[i] @ tries[i])
            dual, at = tries[best], found[best]
        raise RuntimeError(f"rates did not settle in {rounds} rounds; misfit {np.abs(at[1] - goal).max():.2e} of all tokens")

    dual = np.zeros(k)
    first = last = settle(dual, sums([dual])[0], pull)
    # A smaller penalty lets the multipliers grow until the targets are met, if rates can meet them at all.
    for penalty in (pull / 10**j for j in range(1, WEAKER + 1)):
        if np.abs(last[1][1] - goal).max() <= close:
            break
        last = settle(*last, penalty)
    dual, (_, have, _) = last if np.abs(last[1][1] - goal).max() <= close else first
    held = spark.sparkContext.broadcast(dual)

    @F.pandas_udf("double")
    def rate(tokens: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(_rates(np.stack(p.to_numpy()), tokens.to_numpy(), held.value, low, high))

    return rated.withColumn("rate", rate("tokens", "p")), have * total


def mix_rates(
    docs: DataFrame, labelled: DataFrame, weights: dict[str, float], growth: float = 1.0,
    sample: int = SAMPLE, low: float = 0.0, high: float = np.inf, seed: int = 17, rounding: str = "sampled",
) -> DataFrame:
    """``doc_id, tokens, p, rate, copies`` per row of ``docs``.

    ``weights`` are the domains' shares of ``growth`` times the tokens of
    ``docs``. ``rate`` is the expected number of copies; ``copies`` is
    an integer, drawn by a hash of doc_id and ``seed`` so that its mean is the
    rate (``rounding="nearest"`` takes the nearest integer instead). The
    metadata of ``rate`` name the tokens wanted and reached per domain; a miss,
    when no rates in [low, high] meet the targets, is logged too. Null and
    empty texts have no tokens and keep rate 1. A null doc_id is drawn like any
    other; rows of one doc_id with one text share their draw. Extra columns are
    ignored, an empty table gives an empty result.
    """
    names = list(weights)
    rated = stored(posteriors(docs, labelled, names, sample), "posteriors")
    there = rated.agg(F.sum("tokens")).first()[0] or 0
    goal = np.array([weights[d] for d in names], float)
    goal = goal / goal.sum() * there * growth
    rates, have = fit_rates(rated, goal, low=low, high=high)
    if np.abs(have - goal).max(initial=0) > CLOSE * goal.max(initial=0):
        logging.getLogger(__name__).warning("no rates in bounds meet the targets: tokens wanted %s, reached %s", dict(zip(names, goal.tolist())), dict(zip(names, have.tolist())))
    rates = rates.withMetadata("rate", {"domains": names, "targets": goal.tolist(), "reached": have.tolist()})
    if rounding == "nearest":
        copies = F.floor(F.col("rate") + 0.5)
    else:
        draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        copies = F.floor(F.col("rate") + draw)
    return rates.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """``docs`` with each row as often as its ``copies`` say; columns as given.

    Rows that repeat a doc_id all take the largest number of copies among them;
    rows without a doc_id stay once.
    """
    drawn = mix_rates(docs, labelled, weights, **options).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("copies").alias("_copies"))
    joined = docs.join(drawn, "doc_id", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))
    return joined.filter("_copies > 0").withColumn("_copy", copies).select(*docs.columns)
