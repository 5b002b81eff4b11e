"""Exact quantiles and outliers against numpy."""

import numpy as np
import pytest

from corpusgraph.operators import evidence


@pytest.mark.parametrize("kind", ["spread", "hot", "few", "one", "none"])
def test_quantiles_are_exact(spark, kind):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=5000).tolist(),
        "hot": [1.5] * 2000 + rng.normal(size=4000).tolist(),  # a third of all rows is one value
        "few": [3.0, 1.0, 2.0, 2.0], "one": [7.0], "none": [],
    }[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.75, 1.0] if kind != "spread" else [0.25, 0.751]
    got = evidence.exact_quantiles(df, "x", shares, most=300)
    assert got == pytest.approx(np.quantile(values, shares).tolist()) if values else got == [None] * len(shares)


def test_outliers(spark):
    rows = [(i, float(i % 10)) for i in range(200)] + [(900, 500.0), (901, None), (902, -80.0)]
    found = {r.k: (r.z_score, r.outside_iqr) for r in evidence.outliers(spark.createDataFrame(rows, "k long, n double"), "k", "n").collect()}
    values = np.array([v for _, v in rows if v is not None])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    assert set(found) == {900, 902} and all(outside for _, outside in found.values())
    assert found[900][0] == pytest.approx((500 - values.mean()) / values.std(ddof=1), abs=1e-6) and q1 - 1.5 * (q3 - q1) > -80
    assert evidence.outliers(spark.createDataFrame([], "k long, n double"), "k", "n").count() == 0
