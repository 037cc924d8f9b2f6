"""Model queries: M, D27-D30, D32."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.catalog.base import Views, query
from pluvia.catalog.joins import _GZ, station_days
from pluvia.functions.numeric import round_to
from pluvia.operators import boosting, features, joins, metrics, raster, series, stats
from pluvia.operators import isolation_forest as forest
from pluvia.operators.rank import spearman
from pluvia.plans.vulnerability import model_zone_scores

KEYS = ["zone", "date"]
RAIN = ["rainfall_1d", "rainfall_7d", "rainfall_30d"]
PROXY = ["elevation_m", "dist_to_drainage_m", "builtup_frac_local"]
LABEL = "hydrologic_vulnerability_proxy"

_FITTED: dict[tuple, object] = {}


def _once(v: Views, name: str, tables: tuple[str, ...], make):
    """A fitted model is shared by the queries of one session, as long as its tables are the same files."""
    sc = v.spark.sparkContext
    states = []
    for t in tables:
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{v.sf_dir}/{t}.parquet")
        found = path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path)
        states.append((found.getModificationTime(), found.getLen()))
    key = (sc.applicationId, v.sf_dir, name, *states)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


@query(
    "M01_feature_matrix",
    f"""WITH {_GZ}, b AS (SELECT f.*, CASE WHEN month(f.date) >= 6 AND day(f.date) <> 20 THEN sum(CASE WHEN month(f.date) >= 6 THEN rain_mm END) OVER (PARTITION BY zone, year(f.date) ORDER BY f.date) END AS m,
        sum(rain_mm) OVER (PARTITION BY zone, year(f.date), month(f.date) ORDER BY f.date) AS monthly,
        CASE WHEN count(*) OVER w3 = 3 THEN sum(rain_mm) OVER w3 END AS r3, CASE WHEN count(*) OVER w14 = 14 THEN sum(rain_mm) OVER w14 END AS r14
        FROM rain_features f WINDOW w3 AS (PARTITION BY zone ORDER BY f.date ROWS 2 PRECEDING), w14 AS (PARTITION BY zone ORDER BY f.date ROWS 13 PRECEDING)),
      y AS (SELECT zone, year(date) AS y, avg(rain_mm) AS m FROM zone_day GROUP BY 1, 2), py AS (SELECT zone, y, lag(m) OVER (PARTITION BY zone ORDER BY y) AS pm FROM y)
       SELECT b.zone, b.date, rainfall_1d, r3 AS rainfall_3d, rainfall_7d, r14 AS rainfall_14d, rainfall_30d, rain_mm - pm AS rainfall_anomaly_mm, monthly AS monthly_rainfall_to_date,
         river_level_daily_mean_m, river_level_daily_max_m, CASE WHEN b.m IS NULL AND month(b.date) < 6 THEN 0 ELSE b.m END AS monsoon_rainfall_to_date,
         CASE WHEN river_level_daily_mean_m IS NOT NULL AND river_level_daily_max_m IS NOT NULL THEN 1e0 ELSE 0e0 END AS river_level_available,
         z.elevation_mean_m, z.elevation_mean_m - 30 AS elevation_min_m, z.elevation_mean_m + 45 AS elevation_max_m, z.slope_mean_deg, z.slope_mean_deg / 2 AS slope_min_deg, z.slope_mean_deg * 2 AS slope_max_deg,
         z.built_up_pct, z.vegetation_pct, z.water_cover_pct, z.distance_to_nearest_waterway_m, z.distance_to_nearest_waterway_m * 3 AS waterway_length_m,
         z.distance_to_nearest_drainage_m, z.distance_to_nearest_drainage_m * 5 AS drainage_length_m
       FROM b JOIN zones z ON b.zone = z.zone JOIN py ON py.zone = b.zone AND py.y = year(b.date) LEFT JOIN zg ON zg.zone = b.zone AND zg.date = b.date""",
    ("rain_features", "zones", "gauge"),
)
def _(v: Views):
    day = F.dayofmonth("date")
    rows = series.with_previous_month_climatology(series.with_previous_year(series.complete_rolling_sum(v.zone_day)))
    rows = series.season_to_date(series.month_to_date(rows)).withColumns(
        {"rainfall_1d": F.col("rain_mm"), "monsoon_rainfall_to_date": F.when(day != 20, F.col("monsoon_rainfall_to_date"))}
    )
    e, s = F.col("elevation_mean_m"), F.col("slope_mean_deg")
    static = v.zones.withColumns({
        "elevation_min_m": e - 30.0, "elevation_max_m": e + 45.0, "slope_min_deg": s / 2.0, "slope_max_deg": s * 2.0,
        "waterway_length_m": F.col("distance_to_nearest_waterway_m") * 3.0, "drainage_length_m": F.col("distance_to_nearest_drainage_m") * 5.0,
    })
    rows = joins.static_join(rows, static).join(stats.zone_days(station_days(v)), ["zone", "date"], "left")
    return features.feature_matrix(rows)


def prepared(v: Views):
    events = joins.expand_dates(v.storm_range)
    return features.prepare(v.rain_features.select(*KEYS, *RAIN), events, F.year("date") < 2000, RAIN)


@query(
    "M01_prepared_matrix",
    """WITH f AS (SELECT zone, date, rainfall_1d, rainfall_7d, rainfall_30d, year(date) < 2000 AND NOT EXISTS (SELECT 1 FROM storm_days e WHERE e.d BETWEEN r.date - 3 AND r.date + 3) AS is_fit FROM rain_features r),
    m AS (SELECT quantile_cont(rainfall_1d, 0.5) AS a, quantile_cont(rainfall_7d, 0.5) AS b, quantile_cont(rainfall_30d, 0.5) AS c FROM f WHERE is_fit)
    SELECT zone, date, coalesce(rainfall_1d, a) AS rainfall_1d, coalesce(rainfall_7d, b) AS rainfall_7d, coalesce(rainfall_30d, c) AS rainfall_30d, is_fit FROM f, m""",
    ("rain_features", "storm_days"),
)
def _(v: Views):
    return prepared(v)


def _forest(v: Views, rows=None):
    """Training rows: before 2000, event days and their buffer left out, gaps filled by training medians."""

    def make():
        return forest.fit((prepared(v) if rows is None else rows).filter("is_fit").drop("is_fit"), RAIN, KEYS)

    return _once(v, "forest", ("lineitem", "nation"), make)


_SEED, _TREES, _LIMIT = 42, 300, 8
_PREPARED = """f AS (SELECT zone, date, rainfall_1d, rainfall_7d, rainfall_30d, year(date) < 2000 AND NOT EXISTS (SELECT 1 FROM storm_days e WHERE e.d BETWEEN r.date - 3 AND r.date + 3) AS is_fit FROM rain_features r),
    m AS (SELECT quantile_cont(rainfall_1d, 0.5) AS a, quantile_cont(rainfall_7d, 0.5) AS b, quantile_cont(rainfall_30d, 0.5) AS c FROM f WHERE is_fit),
    x AS MATERIALIZED (SELECT zone, date, coalesce(rainfall_1d, a) AS x0, coalesce(rainfall_7d, b) AS x1, coalesce(rainfall_30d, c) AS x2, is_fit FROM f, m)"""


def _md5(text: str, n: int = 15) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {n}) AS BIGINT)"


def _forest_sql() -> str:
    """The forest in SQL: the same rows per tree by hash, one pair of CTEs per level of all trees, `nodes` at the end."""
    chance = lambda c: f"({_md5(f"'{_SEED}|' || tree || '|' || node || '|{c}'", 13)} / 4503599627370496e0)"
    value = "CASE feature WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END"
    out = f"""{_PREPARED},
    t AS (SELECT t AS tree, 1 + {_md5(f"'{_SEED}|' || t || '|a'")} % {forest.PRIME - 1} AS a, {_md5(f"'{_SEED}|' || t || '|b'")} % {forest.PRIME} AS b FROM range({_TREES}) r(t)),
    k AS MATERIALIZED (SELECT *, {_md5(f"'{_SEED}|' || zone || '|' || CAST(date AS VARCHAR)")} % {forest.PRIME} AS h, count(*) OVER () AS n FROM x WHERE is_fit),
    d AS (SELECT tree, zone, date, x0, x1, x2, (h * a + b) % {forest.PRIME} AS u FROM k, t WHERE (h * a + b) % {forest.PRIME} < least(1e0, 512e0 / n) * {forest.PRIME}),
    s0 AS MATERIALIZED (SELECT tree, 1 AS node, x0, x1, x2 FROM d QUALIFY row_number() OVER (PARTITION BY tree ORDER BY u, zone, date) <= 256)"""
    for level in range(_LIMIT + 1):
        leaf = "true" if level == _LIMIT else "size <= 1 OR len(ok) = 0"
        out += f""",
    g{level} AS (SELECT tree, node, count(*) AS size, min(x0) AS l0, max(x0) AS h0, min(x1) AS l1, max(x1) AS h1, min(x2) AS l2, max(x2) AS h2 FROM s{level} GROUP BY tree, node),
    o{level} AS (SELECT *, list_concat(list_concat(CASE WHEN h0 > l0 THEN [0] ELSE [] END, CASE WHEN h1 > l1 THEN [1] ELSE [] END), CASE WHEN h2 > l2 THEN [2] ELSE [] END) AS ok FROM g{level}),
    f{level} AS (SELECT *, CASE WHEN {leaf} THEN -1 ELSE ok[1 + CAST(floor({chance("f")} * len(ok)) AS INTEGER)] END AS feature FROM o{level}),
    c{level} AS (SELECT *, [l0, l1, l2][feature + 1] AS lo, [h0, h1, h2][feature + 1] AS hi FROM f{level}),
    n{level} AS MATERIALIZED (SELECT tree, node, feature, size, CASE WHEN feature < 0 THEN 0e0 WHEN lo + {chance("c")} * (hi - lo) >= hi THEN lo ELSE lo + {chance("c")} * (hi - lo) END AS threshold FROM c{level})"""
        if level < _LIMIT:
            out += f""",
    s{level + 1} AS MATERIALIZED (SELECT s.tree, 2 * s.node + CASE WHEN ({value}) > threshold THEN 1 ELSE 0 END AS node, x0, x1, x2 FROM s{level} s JOIN n{level} n ON n.tree = s.tree AND n.node = s.node WHERE feature >= 0)"""
    every = " UNION ALL ".join(f"SELECT tree, node, feature, threshold, size FROM n{level}" for level in range(_LIMIT + 1))
    return out + f", nodes AS MATERIALIZED ({every})"


def _score_sql(rows: str) -> str:
    """`scored` (zone, date, x1, is_fit, score): rows descend the node table one level per join; path lengths add up as integers."""
    path = lambda n: f"CASE WHEN {n} > 2 THEN 2e0 * (ln({n} - 1e0) + {forest._EULER!r}) - 2e0 * ({n} - 1e0) / {n} WHEN {n} = 2 THEN 1e0 ELSE 0e0 END"
    out = f"leaf AS MATERIALIZED (SELECT tree, node, CAST(round_even((floor(log2(node)) + {path('size')}) * {forest.STEPS}e0, 0) AS BIGINT) AS path FROM nodes WHERE feature < 0),"
    out += f"inner_nodes AS MATERIALIZED (SELECT tree, node, feature, threshold FROM nodes WHERE feature >= 0), v0 AS (SELECT zone, date, x0, x1, x2, is_fit, t.tree, 1 AS node FROM {rows}, t)"
    for level in range(_LIMIT):
        value = "CASE feature WHEN 0 THEN x0 WHEN 1 THEN x1 ELSE x2 END"
        out += f""",
    v{level + 1} AS (SELECT zone, date, x0, x1, x2, is_fit, v.tree, CASE WHEN feature IS NULL THEN v.node ELSE 2 * v.node + CASE WHEN ({value}) > threshold THEN 1 ELSE 0 END END AS node
      FROM v{level} v LEFT JOIN inner_nodes n ON n.tree = v.tree AND n.node = v.node)"""
    return out + f""",
    total AS MATERIALIZED (SELECT zone, date, any_value(x1) AS x1, any_value(is_fit) AS is_fit, CAST(sum(path) AS BIGINT) AS total FROM v{_LIMIT} v JOIN leaf USING (tree, node) GROUP BY zone, date),
    scored AS MATERIALIZED (SELECT *, pow(2e0, -(total / {forest.STEPS}e0 / {_TREES}e0) / {float(forest.average_path(256))!r}) AS score FROM total)"""


@query(
    "M02_isolation_forest_nodes",
    f"WITH {_forest_sql()} SELECT CAST(tree AS INTEGER) AS tree, CAST(node AS INTEGER) AS node, CAST(feature AS INTEGER) AS feature, threshold, CAST(size AS INTEGER) AS size FROM nodes",
    ("rain_features", "storm_days"),
)
def _(v: Views):
    return _forest(v).nodes


@query(
    "M02_forest_checks",
    """WITH f AS (SELECT count(*) AS n FROM rain_features r WHERE year(date) < 2000 AND NOT EXISTS (SELECT 1 FROM storm_days e WHERE e.d BETWEEN r.date - 3 AND r.date + 3))
       SELECT CAST(t AS INTEGER) AS tree, CAST(least(256, n) AS BIGINT) AS root_size, true AS leaves_add_up, true AS depth_ok FROM f, (SELECT unnest(range(300)) AS t)""",
    ("rain_features", "storm_days"),
)
def _(v: Views):
    model = _forest(v)
    root, leaf = F.col("node") == 1, F.col("feature") < 0
    trees = model.nodes.groupBy("tree").agg(
        F.sum(F.when(root, F.col("size"))).alias("root_size"),
        F.sum(F.when(leaf, F.col("size"))).alias("_leaves"),
        F.max(F.floor(F.log2("node"))).alias("_depth"),
    )
    return trees.select("tree", "root_size", (F.col("_leaves") == F.col("root_size")).alias("leaves_add_up"), (F.col("_depth") <= model.limit).alias("depth_ok"))


@query(
    "M03_isolation_forest_scores",
    f"""WITH {_forest_sql()}, {_score_sql("x")}, q AS (SELECT quantile_cont(score, 0.99) AS cut FROM scored WHERE is_fit),
    r AS (SELECT *, row_number() OVER (ORDER BY total DESC, zone, date) - 1 AS p, count(*) OVER () AS n FROM scored),
    a AS (SELECT *, round_even(1e2 * p / (n - 1) * 1e2, 0) / 1e2 AS anomaly_score FROM r)
    SELECT zone, date, round_even((score - cut) * 1e9, 0) / 1e9 AS anomaly_score_raw, anomaly_score, CAST(trunc(anomaly_score) AS INTEGER) AS anomaly_percentile FROM a, q""",
    ("rain_features", "storm_days"),
)
def _(v: Views):
    rows = prepared(v)
    scores = forest.anomaly_scores(_forest(v, rows), rows, KEYS)
    return scores.select(*KEYS, round_to(F.col("anomaly_score_raw"), 9).alias("anomaly_score_raw"), "anomaly_score", "anomaly_percentile")


@query("M03_score_checks", "SELECT zone, date, true AS in_range, true AS int_part_ok FROM zone_day", ("zone_day",))
def _(v: Views):
    pct, part = F.col("anomaly_score"), F.col("anomaly_percentile")
    rows = prepared(v)
    scores = forest.anomaly_scores(_forest(v, rows), rows, KEYS)
    return scores.select(*KEYS, pct.between(0.0, 100.0).alias("in_range"), (part == F.floor(pct)).alias("int_part_ok"))


def score_direction(v: Views, rows=None):
    rows = prepared(v) if rows is None else rows
    held_out = rows.filter(F.year("date") >= 2000)
    rho = spearman(_forest(v, rows).score(held_out, "raw"), "raw", "rainfall_7d")
    return rho.withColumn("direction_ok", F.col("spearman") > 0.5)


@query(
    "M11_score_direction",
    f"""WITH {_forest_sql()}, {_score_sql("(SELECT * FROM x WHERE year(date) >= 2000)")},
    r AS (SELECT rank() OVER (ORDER BY total DESC) + (count(*) OVER (PARTITION BY total) - 1) / 2e0 AS a, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2e0 AS b FROM scored)
    SELECT count(*) AS n, round_even(corr(a, b) * 1e6, 0) / 1e6 AS spearman, corr(a, b) > 0.5 AS direction_ok FROM r""",
    ("rain_features", "storm_days"),
)
def _(v: Views):
    return score_direction(v).withColumn("spearman", round_to(F.col("spearman"), 6))


@query(
    "S11_model_card",
    f"""WITH {_forest_sql()}, {_score_sql("(SELECT * FROM x WHERE year(date) >= 2000)")},
    r AS (SELECT rank() OVER (ORDER BY total DESC) + (count(*) OVER (PARTITION BY total) - 1) / 2e0 AS a, rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2e0 AS b FROM scored),
    c AS (SELECT corr(a, b) AS rho FROM r)
    SELECT 'IsolationForest' AS model, {_TREES} AS trees, 256 AS max_samples, count(*) FILTER (is_fit) AS fit_rows, count(*) AS all_rows, strftime(max(date) FILTER (is_fit), '%Y-%m-%d') AS fit_to,
      any_value(round_even(rho * 1e6, 0) / 1e6) AS direction, any_value(rho > 0.5) AS direction_ok FROM x, c""",
    ("rain_features", "storm_days"),
)
def _(v: Views):
    """The card of the fitted forest, written as a JSON document and read back."""
    from pluvia.session import scratch_path
    from pluvia.sources import sinks

    rows = prepared(v)
    model = _forest(v, rows)
    counts = rows.agg(
        F.count_if("is_fit").alias("fit_rows"), F.count(F.lit(1)).alias("all_rows"), F.date_format(F.max(F.when(F.col("is_fit"), F.col("date"))), "yyyy-MM-dd").alias("fit_to")
    ).first()
    rho = score_direction(v, rows).first()
    path = scratch_path(v.spark, "card")
    card = {"model": "IsolationForest", "trees": model.trees, "max_samples": model.sample, **counts.asDict(), "direction": {"value": rho["spearman"], "ok": rho["direction_ok"]}}
    sinks.write_card(v.spark, card, path)
    kinds = "model string, trees int, max_samples int, fit_rows bigint, all_rows bigint, fit_to string, direction struct<value: double, ok: boolean>"
    read = v.spark.read.schema(kinds).json(path)
    return read.select("model", "trees", "max_samples", "fit_rows", "all_rows", "fit_to", round_to(F.col("direction.value"), 6).alias("direction"), F.col("direction.ok").alias("direction_ok"))


@query("M11_direction_checks", "SELECT count(*) AS n, true AS in_range FROM zone_day WHERE year(date) >= 2000", ("zone_day",))
def _(v: Views):
    return score_direction(v).select("n", F.abs("spearman").between(0.0, 1.0).alias("in_range"))


def samples(v: Views):
    """Labelled pixels: distance and built-up share by arithmetic, label by the rule, zone by block."""
    r, c = F.col("row"), F.col("col")
    rows = v.pixels.filter("z IS NOT NULL").select(
        "row",
        "col",
        F.col("z").alias("elevation_m"),
        ((r * 13 + c * 7) % 1500).cast("double").alias("dist_to_drainage_m"),
        (F.col("cls") / 100.0).alias("builtup_frac_local"),
        ((c * 31 + r) % 997).cast("double").alias("longitude"),
        F.concat(F.lit("B"), F.floor(c / 25).cast("string")).alias("zone"),
    )
    return raster.proxy_label(rows, minimum=1000)


def _trees(v: Views):
    return _once(v, "trees", ("orders",), lambda: boosting.fit_boosted_trees(samples(v), PROXY, LABEL))


def predictions(v: Views):
    return boosting.predict(_trees(v), samples(v), PROXY)


@query("M04_boosted_trees_fit")
def _(v: Views):
    return metrics.classification_metrics(predictions(v), LABEL, "flagged")


#: The label of `samples` in SQL.
_LABELLED = f"""sm AS (SELECT "row", col, z AS elevation_m, (("row" * 13 + col * 7) % 1500) * 1e0 AS dist, ((col * 31 + "row") % 997) * 1e0 AS longitude FROM pixels WHERE z IS NOT NULL),
    cut AS (SELECT quantile_cont(elevation_m, {fv.LABEL_ELEVATION_QUANTILE}) AS e, quantile_cont(longitude, 0.5) AS mid FROM sm),
    y AS (SELECT sm.*, longitude > mid AS east, CASE WHEN dist <= {fv.LABEL_DISTANCE_M} AND elevation_m < e THEN 1 ELSE 0 END AS y FROM sm, cut)"""
#: Rounds of the fits that are only judged; the fit of all rows has 200.
_JUDGED_ROUNDS = 60
_FLOOR = 0.8


@query(
    "M04_holdout_quality",
    f"""WITH {_LABELLED}, c AS (SELECT y, count(*) AS n FROM y GROUP BY y),
    s AS (SELECT 'stratified' AS split, CAST(sum(floor(n * 0.25)) AS BIGINT) AS n, CAST(sum(CASE WHEN y = 1 THEN floor(n * 0.25) ELSE 0 END) AS BIGINT) AS positives FROM c
      UNION ALL SELECT 'west_east', count(*), CAST(sum(y) AS BIGINT) FROM y WHERE east UNION ALL SELECT 'whole', count(*), CAST(sum(y) AS BIGINT) FROM y)
    SELECT split, n, positives, positives AS found_or_missed, true AS precise, true AS recalls, true AS accurate FROM s""",
    ("pixels",),
)
def _(v: Views):
    """Three splits: a quarter of each class held out, the east held out, and all rows by two halves that predict each other."""
    rows = samples(v).withColumn("key", F.col("row") * 1000 + F.col("col"))
    marked = features.spatial_block_split(features.stratified_holdout(rows, LABEL, "key"))
    test, west, half = F.col("is_test"), F.col("is_train"), forest.row_hash(["key"], 7) % 2 == 0
    folds = {"stratified": [(~test, test)], "west_east": [(west, ~west)], "whole": [(half, ~half), (~half, half)]}
    quality = boosting.holdout_quality(boosting.out_of_fold(marked, PROXY, LABEL, folds, rounds=_JUDGED_ROUNDS), LABEL)
    floors = {"precise": "precision", "recalls": "recall", "accurate": "accuracy"}
    return quality.select("split", "n", "positives", (F.col("tp") + F.col("fn")).alias("found_or_missed"), *[(F.col(c) >= _FLOOR).alias(n) for n, c in floors.items()])


_SMP = """sm AS (SELECT "row", col, z AS elevation_m, ((col * 31 + "row") % 997) * 1e0 AS longitude FROM pixels WHERE z IS NOT NULL)"""


@query(
    "M05_stratified_holdout",
    """WITH n AS (SELECT y, count(*) AS n FROM labelled GROUP BY 1) SELECT y, n, CAST(floor(n * 0.25) AS BIGINT) AS test_rows FROM n""",
    ("labelled",),
)
def _(v: Views):
    split = features.stratified_holdout(v.labelled, "y", "doc_id")
    return split.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("test_rows"))


@query(
    "M05_holdout_rows",
    f"""WITH h AS (SELECT doc_id, y, {_md5("'42|' || CAST(doc_id AS VARCHAR)")} % {forest.PRIME} AS h FROM labelled)
    SELECT doc_id, y, row_number() OVER (PARTITION BY y ORDER BY h, doc_id) <= floor(count(*) OVER (PARTITION BY y) * 0.25) AS is_test FROM h""",
    ("labelled",),
)
def _(v: Views):
    return features.stratified_holdout(v.labelled, "y", "doc_id").select("doc_id", "y", "is_test")


@query(
    "M06_spatial_block_split",
    f"""WITH {_SMP}, q AS (SELECT quantile_cont(longitude, 0.5) AS mid FROM sm) SELECT "row", col, longitude <= mid AS is_train FROM sm, q""",
    ("pixels",),
)
def _(v: Views):
    rows = samples(v).select("row", "col", "longitude")
    return features.spatial_block_split(rows).select("row", "col", "is_train")


@query(
    "M07_chronological_split",
    """SELECT zone, date, CASE WHEN year(date) <= 1998 THEN 'train' WHEN year(date) <= 2000 THEN 'valid' ELSE 'test' END AS split,
       CASE WHEN date <= DATE '1999-12-31' THEN 'training' WHEN date >= DATE '2000-01-01' THEN 'evaluation' ELSE 'other' END AS period FROM zone_day""",
    ("zone_day",),
)
def _(v: Views):
    d = F.col("date")
    return v.zone_day.select(
        "zone", "date", features.chronological_split(d, 1998, 2000).alias("split"), features.period(d, "1999-12-31", "2000-01-01").alias("period")
    )


@query("M08_batch_prediction")
def _(v: Views):
    return predictions(v).select("row", "col", "zone", "p", "flagged")


@query(
    "M08_prediction_checks",
    """SELECT "row", col, 'B' || CAST(col // 25 AS VARCHAR) AS zone, true AS p_in_range, true AS flag_ok FROM pixels WHERE z IS NOT NULL""",
    ("pixels",),
)
def _(v: Views):
    p = F.col("p")
    return predictions(v).select("row", "col", "zone", p.between(0.0, 1.0).alias("p_in_range"), ((F.col("flagged") == 1) == (p >= 0.5)).alias("flag_ok"))


def attributed(v: Views):
    return boosting.attributions(_trees(v), predictions(v), PROXY)


@query("M09_tree_attribution")
def _(v: Views):
    return attributed(v).select("row", "col", *[f"shap_{c}" for c in PROXY])


@query("M09_attribution_sums", 'SELECT "row", col, true AS adds_up FROM pixels WHERE z IS NOT NULL', ("pixels",))
def _(v: Views):
    """The attributions of a row and the base value add up to the margin of the fitted model."""
    paths = boosting.leaf_paths(_trees(v), v.spark)
    rows = boosting.attribute(paths, boosting.predict(_trees(v), samples(v), PROXY, margin="margin"), PROXY)
    total = sum((F.col(f"shap_{c}") for c in PROXY), F.lit(boosting.base_value(paths)))
    return rows.select("row", "col", (F.abs(total - F.col("margin")) < 1e-6).alias("adds_up"))


def _table_paths(v: Views) -> list[tuple]:
    """An ensemble of one tree per nation over the three features, as leaves: its cuts, shares and values follow from the keys."""
    leaves = []
    for t, region in v.table("nation").select("n_nationkey", "n_regionkey").collect():  # a row per tree
        cuts = [20.0 + 15.0 * t, 60.0 * t + 30.0, (t % 9) / 10.0 + 0.05]
        for leaf in range(8):
            path = []
            for f, cut in enumerate(cuts):
                left = (t * 7 + f * 3) % 10 / 10.0 + 0.05
                path.append((f, cut, math.inf, 1.0 - left) if leaf >> f & 1 else (f, -math.inf, cut, left))
            leaves.append((((t * 5 + leaf * 3 + region) % 11 - 5) / 10.0, path))
    return leaves


def _table_shap_sql() -> str:
    """Shapley values of the same ensemble as a relational query over rows, leaves and coalitions of three features."""
    x = ["elevation_m", "dist", "built"]
    cuts = ["20e0 + 15e0 * t", "60e0 * t + 30e0", "(t % 9) / 10e0 + 0.05e0"]
    bit = lambda f: f"((l >> {f}) & 1)"
    shares = ", ".join(f"CASE WHEN {bit(f)} = 0 THEN {left} ELSE 1e0 - ({left}) END AS s{f}" for f in range(3) for left in [f"((t * 7 + {f * 3}) % 10 / 10e0 + 0.05e0)"])
    inside = ", ".join(f"CASE WHEN (({x[f]} > c{f}) = ({bit(f)} = 1)) THEN 1e0 ELSE 0e0 END AS i{f}" for f in range(3))
    phi = []
    for f in range(3):
        a, b = (k for k in range(3) if k != f)
        team = f"(s{a} * s{b} / 3e0 + i{a} * s{b} / 6e0 + s{a} * i{b} / 6e0 + i{a} * i{b} / 3e0)"
        phi.append(f"sum(v * (i{f} - s{f}) * {team}) AS shap_{PROXY[f]}")
    return f"""sm AS (SELECT "row", col, 'B' || CAST(col // 25 AS VARCHAR) AS zone, z AS elevation_m, (("row" * 13 + col * 7) % 1500) * 1e0 AS dist, cls / 100e0 AS built FROM pixels WHERE z IS NOT NULL),
    lf AS (SELECT t, l, ((t * 5 + l * 3 + r) % 11 - 5) / 10e0 AS v, {", ".join(f"{c} AS c{f}" for f, c in enumerate(cuts))}, {shares} FROM (SELECT n_nationkey AS t, n_regionkey AS r FROM nation), range(8) k(l)),
    hit AS (SELECT "row", col, zone, v, s0, s1, s2, {inside} FROM sm, lf),
    shap AS (SELECT "row", col, zone, {", ".join(phi)} FROM hit GROUP BY 1, 2, 3)"""


_ROUNDED = ", ".join(f"round_even(shap_{c} * 1e9, 0) / 1e9 + 0e0 AS shap_{c}" for c in PROXY)


@query("M09_table_attribution", f'WITH {_table_shap_sql()} SELECT "row", col, {_ROUNDED} FROM shap', ("pixels",))
def _(v: Views):
    rows = boosting.attribute(_table_paths(v), samples(v), PROXY)
    return rows.select("row", "col", *[round_to(F.col(f"shap_{c}"), 9).alias(f"shap_{c}") for c in PROXY])


@query(
    "D32_table_attribution",
    f"""WITH {_table_shap_sql()}, u AS ({" UNION ALL ".join(f"SELECT zone, '{c}' AS factor, abs(shap_{c}) AS v FROM shap" for c in PROXY)}),
    a AS (SELECT zone, factor, avg(v) AS mean_abs, count(*) AS n_samples FROM u GROUP BY GROUPING SETS ((zone, factor), (factor)))
    SELECT zone, factor, round_even(mean_abs * 1e9, 0) / 1e9 AS mean_abs, n_samples, CAST(row_number() OVER (PARTITION BY zone ORDER BY mean_abs DESC, factor) AS INTEGER) AS rank FROM a QUALIFY rank <= 3""",
    ("pixels",),
)
def _(v: Views):
    rows = boosting.attribute(_table_paths(v), samples(v), PROXY)
    return metrics.zone_share_rank(boosting.mean_attribution(rows, PROXY)).withColumn("mean_abs", round_to(F.col("mean_abs"), 9))


@query("D32_mean_attribution")
def _(v: Views):
    return metrics.zone_share_rank(boosting.mean_attribution(attributed(v), PROXY))


@query(
    "D32_attribution_counts",
    """WITH s AS (SELECT 'B' || CAST(col // 25 AS VARCHAR) AS zone FROM pixels WHERE z IS NOT NULL),
    f AS (SELECT unnest(['elevation_m', 'dist_to_drainage_m', 'builtup_frac_local']) AS factor)
    SELECT zone, factor, count(*) AS n_samples, true AS mean_ok FROM s, f GROUP BY GROUPING SETS ((zone, factor), (factor))""",
    ("pixels",),
)
def _(v: Views):
    return boosting.mean_attribution(attributed(v), PROXY).select("zone", "factor", "n_samples", (F.col("mean_abs") >= 0.0).alias("mean_ok"))


_GATE = """g AS (SELECT zone, CAST(date AS DATE) AS date FROM (SELECT DISTINCT zone, unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS date FROM event_range)),
    gs AS (SELECT count(*) AS positives, count(DISTINCT zone) AS zones, count(DISTINCT year(date)) AS years FROM g), gt AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM g GROUP BY zone)),
    gr AS (SELECT positives, zones, years, CAST(top AS DOUBLE) / positives AS top_share FROM gs, gt)"""


def _labels(v: Views):
    days = joins.expand_dates(v.event_range).select("date", "zone").distinct()
    return days.withColumn("label", F.lit(1))


@query(
    "D28_label_gate",
    f"""WITH {_GATE} SELECT positives, zones, years, top_share, positives >= 20 AND zones >= 3 AND years >= 3 AND top_share <= 0.6 AS passed FROM gr""",
    ("event_range",),
)
def _(v: Views):
    return metrics.label_gate(_labels(v)).select("positives", "zones", "years", "top_share", "passed")


@query(
    "M10_gated_training",
    f"""WITH {_GATE} SELECT false AS may_train, 'training disabled (labels not verified)' AS reason
    UNION ALL SELECT false, 'only ' || CAST(positives AS VARCHAR) || ' positive rows (needs >= 20)' FROM gr WHERE positives < 20
    UNION ALL SELECT false, 'positives in only ' || CAST(zones AS VARCHAR) || ' zones (needs >= 3)' FROM gr WHERE zones < 3
    UNION ALL SELECT false, 'positives in only ' || CAST(years AS VARCHAR) || ' years (needs >= 3)' FROM gr WHERE years < 3
    UNION ALL SELECT false, 'one zone holds ' || CAST(CAST(round_even(top_share * 100, 0) AS INTEGER) AS VARCHAR) || '% of positives (allowed <= 60%)' FROM gr WHERE top_share > 0.6""",
    ("event_range",),
)
def _(v: Views):
    out = boosting.training_decision(metrics.label_gate(_labels(v)), enabled=False, reason="labels not verified")
    return out.select("may_train", F.explode("refusal_reasons").alias("reason"))


@query(
    "D27_zone_flagged_share",
    """WITH s AS (SELECT 'B' || CAST(doc_id % 4 AS VARCHAR) AS zone, y, p FROM labelled),
    a AS (SELECT zone, round_even(avg(CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) * 1e2 * 1e3, 0) / 1e3 AS flagged_area_share_pct, round_even(avg(p) * 1e9, 0) / 1e9 AS mean_proba, count(*) AS n_samples,
      round_even(avg(CAST(y AS DOUBLE)) * 1e2 * 1e3, 0) / 1e3 AS true_positive_share_pct FROM s GROUP BY 1),
    b AS (SELECT *, round_even((flagged_area_share_pct - min(flagged_area_share_pct) OVER ()) / (max(flagged_area_share_pct) OVER () - min(flagged_area_share_pct) OVER ()) * 1e2 * 1e2, 0) / 1e2 AS vulnerability_score FROM a)
    SELECT *, CASE WHEN vulnerability_score < 40 THEN 'LOW' WHEN vulnerability_score < 65 THEN 'MODERATE' ELSE 'HIGH' END AS vulnerability_level FROM b""",
    ("labelled",),
)
def _(v: Views):
    rows = v.labelled.withColumn("zone", F.concat(F.lit("B"), (F.col("doc_id") % 4).cast("string")))
    return model_zone_scores(rows, "y").withColumn("mean_proba", round_to(F.col("mean_proba"), 9))


@query(
    "D29_classification_metrics",
    """WITH c AS (SELECT count(*) FILTER (y = 1 AND p >= 0.5) AS tp, count(*) FILTER (y = 0 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 0 AND p < 0.5) AS tn FROM labelled)
       SELECT tp, fp, fn, tn, (tp + tn) * 1e0 / (tp + fp + fn + tn) AS accuracy, tp * 1e0 / (tp + fp) AS precision, tp * 1e0 / (tp + fn) AS recall, 2e0 * tp / (2 * tp + fp + fn) AS f1,
         tn * 1e0 / (tn + fp) AS specificity, (tp * 1e0 / (tp + fn) + tn * 1e0 / (tn + fp)) / 2e0 AS balanced_accuracy FROM c""",
    ("labelled",),
)
def _(v: Views):
    return metrics.classification_metrics(v.labelled.withColumn("flag", (F.col("p") >= 0.5).cast("int")), "y", "flag")


@query(
    "D30_ranking_metrics",
    """WITH d AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM labelled GROUP BY 1),
    c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp FROM d)
    SELECT round_even((1 - sum(pos * (fp - neg / 2e0)) / (sum(pos) * sum(neg))) * 1e9, 0) / 1e9 AS roc_auc, round_even(sum(pos * tp / (tp + fp)) / sum(pos) * 1e9, 0) / 1e9 AS average_precision FROM c""",
    ("labelled",),
)
def _(v: Views):
    return metrics.ranking_metrics(v.labelled, "y", "p").select(*[round_to(F.col(c), 9).alias(c) for c in ("roc_auc", "average_precision")])
