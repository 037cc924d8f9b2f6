"""Distributed order statistics against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.functions.numeric import decimal_round, round_to
from pluvia.operators import metrics, rank


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the values are one value."""
    return spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 > 0, 0.0).otherwise((F.col("id") * 7919 % 1013).cast("double")).alias("v"), (F.col("id") * 31 % 997).cast("double").alias("w")
    )


def test_exact_quantiles(skewed):
    pdf = skewed.toPandas()
    got = {(r["column"], r["prob"]): r["value"] for r in rank.exact_quantiles(skewed, ["v", "w"], [0.0, 0.35, 0.5, 0.99, 1.0]).collect()}
    for (c, p), v in got.items():
        assert v == pytest.approx(np.quantile(pdf[c], p), abs=1e-9), (c, p)
    assert len(got) == 10


def test_global_position_is_the_row_number(skewed):
    out = rank.global_position(skewed, ["v", "id"], "p").select("p", "v", "id").toPandas().sort_values("p")
    assert list(out["p"]) == list(range(30_000))
    want = skewed.toPandas().sort_values(["v", "id"])
    assert list(out["id"]) == list(want["id"])


def test_average_rank_and_spearman(skewed):
    pdf = skewed.toPandas()
    got = rank.average_rank(skewed, "v").toPandas().set_index("id")["rank_global"]
    want = pdf.set_index("id")["v"].rank(ascending=False).astype(int)
    assert (got.sort_index() == want.sort_index()).all()
    rho = rank.spearman(skewed, "v", "w").first()["spearman"]
    assert rho == pytest.approx(pdf["v"].rank().corr(pdf["w"].rank()), abs=1e-9)


def test_ranking_metrics(rows):
    df = rows("y int, p double", (1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2), (0, 0.1))
    r = metrics.ranking_metrics(df, "y", "p").first()
    pairs = [(a, b) for a in (0.9, 0.8, 0.2) for b in (0.8, 0.3, 0.1)]
    assert r["roc_auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / 9)
    assert r["average_precision"] == pytest.approx((1 / 1 + 2 / 3 + 3 / 5) / 3)


def test_rounding(spark):
    rng = np.random.default_rng(3)
    vals = [float(x) for x in np.round(rng.uniform(-50, 50, 3000), 2)] + [1.005, 2.675, 11.35, 12.05, -0.01, 0.125]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = df.select("x", decimal_round(F.col("x"), 1).alias("t"), round_to(F.col("x"), 1).alias("s")).collect()
    for r in got:
        assert r["t"] == round(r["x"], 1)
        assert r["s"] == np.round(r["x"], 1)


def test_gini(rows):
    df = rows("zone string, rain_mm double", *[("a", float(v)) for v in (0, 0, 1, 2, 2, 5)], ("b", 0.0))
    got = {r["zone"]: r["gini"] for r in rank.gini(df).collect()}
    x = np.array([1, 2, 2, 5.0])
    want = 2 * (np.arange(1, 5) * x).sum() / (4 * x.sum()) - 5 / 4
    assert got["a"] == pytest.approx(want) and got["b"] == 0.0
