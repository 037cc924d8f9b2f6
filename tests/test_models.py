"""Isolation forest properties and exact tree attribution."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.operators import boosting, features, joins
from pluvia.operators import isolation_forest as forest

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (4000, 3))
    x[:10] += 9.0
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, a double, b double, c double")


def test_outliers_rank_on_top_whatever_the_order(cloud):
    model = forest.fit(cloud, COLS, ["id"], trees=60)
    top = model.score(cloud, "s").orderBy(F.desc("s")).limit(10)
    assert {r["id"] for r in top.collect()} == set(range(10))
    again = forest.fit(cloud.orderBy(F.rand(5)).repartition(13), COLS, ["id"], trees=60)
    a = model.score(cloud, "s").orderBy("id").toPandas()["s"]
    b = again.score(cloud, "s").orderBy("id").toPandas()["s"]
    assert np.allclose(a, b)
    flagged = (a > 0).mean()
    assert 0.005 <= flagged <= 0.011  # contamination share lies above the offset


def test_scores_cover_0_to_100(cloud):
    model = forest.fit(cloud, COLS, ["id"], trees=20)
    out = forest.anomaly_scores(model, cloud, ["id"]).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert tuple(out) == (0.0, 100.0)


def test_attribution_adds_up_to_the_margin(spark, cloud):
    labelled = cloud.withColumn("y", ((F.col("a") > 0.3) & (F.col("b") < 0.5)).cast("int"))
    model = boosting.fit_boosted_trees(labelled, COLS, "y", rounds=8)
    out = boosting.attributions(model, boosting.predict(model, labelled, COLS), COLS)
    pdf = out.withColumn("total", sum((F.col(f"shap_{c}") for c in COLS), F.lit(0.0))).toPandas()
    # the margin of a boosted model is half the log odds
    margin = 0.5 * np.log(pdf["p"] / (1 - pdf["p"]))
    base = margin - pdf["total"]
    assert base.std() < 1e-8
    assert pdf["shap_c"].abs().mean() < pdf["shap_a"].abs().mean()


def test_holdout_and_buffer(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    split = features.stratified_holdout(df, "y", "k")
    got = {r["y"]: (r["t"], r["n"]) for r in split.groupBy("y").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()}
    assert got == {0: (225, 900), 1: (25, 100)}
    days = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-01-31')) AS date")
    events = spark.sql("SELECT DATE '2020-01-10' AS start_date, DATE '2020-01-11' AS end_date")
    left = features.exclude_event_buffer(days, joins.expand_dates(events))
    assert left.count() == 31 - 8


def test_imputation_uses_fit_rows_only(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (0, 100.0), (0, None)], "fit int, x double")
    out = features.impute_training_medians(df, ["x"], F.col("fit") == 1)
    assert sorted(r["x"] for r in out.collect()) == [1.0, 2.0, 2.0, 3.0, 100.0]
    with pytest.raises(ValueError, match="median"):
        features.impute_training_medians(df, ["x"], F.col("fit") == 7)


def test_no_row_is_judged_by_a_model_that_saw_it(cloud):
    rows = cloud.limit(400).withColumns({"y": (F.col("a") > 0.3).cast("int"), "part": F.col("id") % 4})
    first = F.col("part") == 0
    folds = {"held": [(~first, first)], "whole": [(F.col("part") < 2, F.col("part") >= 2), (F.col("part") >= 2, F.col("part") < 2)]}
    out = boosting.out_of_fold(rows, COLS, "y", folds, rounds=3)
    parts = {(r["split"], r["part"]): r["n"] for r in out.groupBy("split", "part").agg(F.count("*").alias("n")).collect()}
    sizes = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {("held", 0): sizes[0], **{("whole", p): sizes[p] for p in range(4)}}
    quality = {r["split"]: r for r in boosting.holdout_quality(out, "y").collect()}
    assert quality["whole"]["n"] == 400 and quality["held"]["tp"] + quality["held"]["fn"] == quality["held"]["positives"]


def test_attributions_and_base_add_up(spark, cloud):
    inf = float("inf")
    paths = [(1.0, [(0, -inf, 0.2, 0.6), (1, 0.0, inf, 0.5)]), (-2.0, [(0, 0.2, inf, 0.4)]), (0.5, [(0, -inf, 0.2, 0.6), (1, -inf, 0.0, 0.5)])]
    out = boosting.attribute(paths, cloud.limit(200), COLS).toPandas()
    margin = np.where(out["a"] > 0.2, -2.0, np.where(out["b"] > 0.0, 1.0, 0.5))
    total = out[[f"shap_{c}" for c in COLS]].sum(axis=1) + boosting.base_value(paths)
    assert np.allclose(total, margin) and (out["shap_c"] == 0).all()


def _descended(nodes, x, trees):
    """Path lengths by walking every tree for every row."""
    table = {(r.tree, r.node): r for r in nodes.itertuples()}
    out = []
    for row in x:
        total = 0
        for t in range(trees):
            n = 1
            while table[t, n].feature >= 0:
                n = 2 * n + int(row[table[t, n].feature] > table[t, n].threshold)
            total += int(np.rint((np.floor(np.log2(n)) + forest.average_path(table[t, n].size)) * forest.STEPS))
        out.append(total)
    return np.array(out)


def test_cell_tables_equal_walks(spark, cloud, monkeypatch):
    """Rows do not walk the trees one by one; values on a cut, unknown ones and trees too wide for a table agree."""
    model = forest.fit(cloud, COLS, ["id"], trees=12)
    nodes = model.nodes.toPandas()
    x = cloud.limit(60).toPandas()[COLS].to_numpy()
    cuts = nodes[nodes["feature"] >= 0]
    for i, (f, t) in enumerate(zip(cuts["feature"][:30], cuts["threshold"][:30])):
        x[i, f] = t
    x[40:50, 1] = np.nan
    want = _descended(nodes, x, 12)
    trees = forest._Trees(nodes, 3, model.limit)
    assert all(offsets is not None for offsets, _, _ in trees.tables) and (trees.totals(x) == want).all()
    monkeypatch.setattr(forest, "_CELLS", 1)
    walked = forest._Trees(nodes, 3, model.limit)
    assert all(offsets is None for offsets, _, _ in walked.tables) and (walked.totals(x) == want).all()


def test_draws_follow_the_hash(cloud):
    """The sums modulo 2^31 - 1 in the tasks are those that SQL computes."""
    got = forest.tree_samples(cloud, ["id"], 7, 20, 42, 4000).toPandas()
    hashes = cloud.select("id", forest.row_hash(["id"], 42).alias("h")).collect()
    want = set()
    for t in range(7):
        a, b = 1 + forest._digits(f"42|{t}|a") % (forest.PRIME - 1), forest._digits(f"42|{t}|b") % forest.PRIME
        want |= {(r["id"], t, u) for r in hashes if (u := (r["h"] * a + b) % forest.PRIME) < int(0.01 * forest.PRIME)}
    assert set(zip(got["id"], got["tree"], got["_u"])) == want and list(got.columns) == [*cloud.columns, "tree", "_u"]


def test_prepared_rows_are_built_once(spark, monkeypatch):
    """The medians and the rows read one stored table."""
    seen = []
    keep = features.stored
    monkeypatch.setattr(features, "stored", lambda df, name: seen.append(name) or keep(df, name))
    days = spark.sql("SELECT 'Z' AS zone, explode(sequence(DATE '1999-12-01', DATE '2000-01-31')) AS date").withColumn("x", F.day("date") * 1.0)
    events = spark.sql("SELECT DATE '1999-12-10' AS date")
    out = features.prepare(days, events, F.year("date") < 2000, ["x"])
    assert seen == ["prepared"] and "Generate" not in out._jdf.queryExecution().toString()
    assert out.filter("is_fit").count() == 31 - 7


def test_attribution_walks_the_ensemble_once_a_cell():
    """Twenty batches of the same cells, unknown and infinite values and values on a bound among them."""
    import math
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    from pluvia.operators import boosting

    class Counted(list):
        walks = 0

        def __iter__(self):
            Counted.walks += 1
            return super().__iter__()

    inf, taken = math.inf, []
    paths = Counted([(0.5, [(0, -inf, 1.0, 0.25), (1, 2.0, inf, 0.5)]), (-1.5, [(0, 1.0, 3.0, 0.75)]), (2.0, [(1, -inf, 2.0, 0.5)]), (0.25, [])])
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=paths))
    df = SimpleNamespace(
        sparkSession=SimpleNamespace(sparkContext=context), schema=T.StructType([T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())]),
        mapInPandas=lambda run, schema: taken.append(run),
    )
    boosting.attribute(paths, df, ["a", "b"])
    values = [-inf, 0.0, 1.0, 1.5, 3.0, 3.5, inf, math.nan]
    batch = pd.DataFrame([(a, b) for a in values for b in [-inf, 2.0, 2.5, inf, math.nan]], columns=["a", "b"])
    Counted.walks = 0
    got = list(taken[0](iter([batch] * 19 + [batch[:0]])))
    assert Counted.walks <= len(df.schema) + 1
    inside = lambda x, lo, hi: np.where((x > lo) & (x <= hi), 1.0, 0.0)
    a, b = batch["a"].to_numpy(), batch["b"].to_numpy()
    i, j = inside(a, -inf, 1.0), inside(b, 2.0, inf)
    want_a = 0.5 * (i - 0.25) * (j + 0.5) / 2 - 1.5 * (inside(a, 1.0, 3.0) - 0.75)
    want_b = 0.5 * (j - 0.5) * (i + 0.25) / 2 + 2.0 * (inside(b, -inf, 2.0) - 0.5)
    for out in got[:-1]:
        assert np.allclose(out["shap_a"], want_a, atol=1e-12) and np.allclose(out["shap_b"], want_b, atol=1e-12)
    assert len(got[-1]) == 0


def test_holdout_rows_are_not_shuffled_by_class(spark):
    from pluvia.operators import features

    rows = spark.range(4000).selectExpr("id", "cast(id % 10 = 0 as int) AS y")
    with_hint = features.stratified_holdout(rows, "y", "id")
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = with_hint._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    assert {r["y"]: r["n"] for r in with_hint.filter("is_test").groupBy("y").count().withColumnRenamed("count", "n").collect()} == {0: 900, 1: 100}


def _wet(spark, n, partitions=3):
    """Rows with a noisy rule, repeated values, zeros and a feature of one value."""
    x, y = F.col("id"), F.xxhash64("id") % 1000
    rows = spark.range(0, n, 1, partitions).select(
        "id", (F.floor(x * 7919 % 1013) / 10.0 - 20.0).alias("a"), (x * 31 % 5).cast("int").alias("b"), F.lit(3.0).alias("c"), F.abs(y).alias("r")
    )
    return rows.withColumn("y", (((F.col("a") > 10.0) & (F.col("b") < 2)) | (F.col("r") < 40)).cast("int")).drop("r")


def _by_mllib(rows, rounds):
    from pyspark.ml.classification import GBTClassifier

    n = rows.agg(F.sum("y").alias("pos"), F.count("*").alias("n")).first()
    weighed = boosting._assembled(rows, COLS).withColumn("label", F.col("y").cast("double")).withColumn("w", F.when(F.col("y") == 1, (n["n"] - n["pos"]) / n["pos"]).otherwise(1.0))
    return GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.1, subsamplingRate=0.9, featureSubsetStrategy="0.9", weightCol="w", seed=42, cacheNodeIds=False).fit(weighed)


@pytest.mark.parametrize("n", [25, 3000, 25_000])
def test_cells_grow_the_trees_of_mllib(spark, n):
    """Probabilities, margins and attributions are those of a fit that reads all rows for each level of each tree."""
    rows = _wet(spark, n)
    got, want = boosting.fit_boosted_trees(rows, COLS, "y", rounds=4), _by_mllib(rows, 4)
    assert isinstance(got, boosting.CellTrees)
    out = [boosting.predict(m, rows, COLS, margin="margin").orderBy("id").toPandas() for m in (got, want)]
    assert list(out[0].columns) == list(out[1].columns) == [*rows.columns, "p", "margin", "flagged"]
    assert np.allclose(out[0][["p", "margin"]], out[1][["p", "margin"]], rtol=1e-9, atol=1e-12) and (out[0]["flagged"] == out[1]["flagged"]).all()
    shap = [boosting.attributions(m, rows, COLS).orderBy("id").toPandas() for m in (got, want)]
    for c in COLS:
        assert np.allclose(shap[0][f"shap_{c}"], shap[1][f"shap_{c}"], rtol=1e-9, atol=1e-12)


def test_rounds_do_not_read_the_rows_again(spark):
    """The jobs of a fit do not grow with its rounds."""
    rows, sc, jobs = _wet(spark, 2000), spark.sparkContext, []
    for rounds in (2, 12):
        sc.setJobGroup(f"fit-{rounds}", "")
        boosting.fit_boosted_trees(rows, COLS, "y", rounds=rounds)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"fit-{rounds}")))
    sc.setJobGroup("other", "")
    assert jobs[0] == jobs[1] <= 8


def test_draws_are_those_of_spark(spark):
    """Blocks of any size continue the numbers of a partition."""
    for seed in (42, -7, 123456789012):
        df = spark.range(0, 2000, 1, 2).select(F.spark_partition_id().alias("p"), *[(F.rand(seed + m + 1) < 0.9).alias(f"d{m}") for m in range(3)]).toPandas()
        for p in range(2):
            draws, got = boosting._Draws(3, 0.9, seed, p), []
            for n in (256, 512, 232):
                order, left = draws.left_out(n)
                part = np.empty_like(left)
                part[:, order] = ~left
                got.append(part)
            assert (np.concatenate(got, axis=1) == df[df["p"] == p][["d0", "d1", "d2"]].to_numpy().T).all()


def test_unknown_values_still_fail(spark):
    rows = _wet(spark, 200)
    model = boosting.fit_boosted_trees(rows, COLS, "y", rounds=2)
    hole = rows.withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    for run in (lambda: boosting.fit_boosted_trees(hole, COLS, "y", rounds=2), lambda: boosting.predict(model, hole, COLS).agg(F.sum("p")).collect()):
        with pytest.raises(Exception):
            run()
