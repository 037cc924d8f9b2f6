"""Readers and sinks on hand-written files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pluvia.operators import spatial
from pluvia.sources import readers, sinks, stores


def test_site_list_needs_its_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("City,Latitude,Longitude\n  Alpha ,18.5,73.8\n")
    (tmp_path / "b.csv").write_text("Town,Latitude\nx,1\n")
    r = readers.read_sites(spark, str(tmp_path / "a.csv")).first()
    assert (r["site"], r["lat"], r["lon"]) == ("Alpha", 18.5, 73.8)
    with pytest.raises(ValueError, match="City"):
        readers.read_sites(spark, str(tmp_path / "b.csv"))


def test_gauge_file_with_bad_values(spark, tmp_path):
    head = f"Station,Latitude,Longitude,{readers.GAUGE_TIME},{readers.GAUGE_LEVEL}"
    body = "Fl\xfcss,18.5,73.9,15-07-2024 10:30,545.2\nB,18.5,73.9,not a time,1\nC,18.5,73.9,15-07-2024 11:00,---\n"
    (tmp_path / "g.csv").write_bytes((head + "\n" + body).encode("latin-1"))
    got = {r["station"]: (r["ts"], r["level"]) for r in readers.read_gauges(spark, str(tmp_path / "g.csv")).collect()}
    assert got == {"Fl\xfcss": (dt.datetime(2024, 7, 15, 10, 30), 545.2), "C": (dt.datetime(2024, 7, 15, 11), None)}


def test_line_collection(spark, tmp_path):
    def feature(kind, coords, tag):
        return {"type": "Feature", "properties": {"name": tag, "waterway": tag}, "geometry": coords and {"type": kind, "coordinates": coords}}

    doc = {"type": "FeatureCollection", "features": [
        feature("LineString", [[0, 0], [1, 0], [1, 1]], "river"), feature("MultiLineString", [[[0, 0], [2, 0]], [[5, 5], [6, 6]]], "drain"),
        feature("Point", [0, 0], "river"), feature("LineString", None, "river"), feature("LineString", [[0, 0], [1, 1]], "dam"),
    ]}
    (tmp_path / "l.geojson").write_text(json.dumps(doc))
    water, drain = readers.split_line_classes(readers.read_lines(spark, str(tmp_path / "l.geojson")))
    assert water.count() == 1 and drain.count() == 2
    assert readers.line_segments(water).count() == 2
    last = readers.line_segments(water).orderBy(F.desc("seg")).first()
    assert (last["x1"], last["y1"], last["x2"], last["y2"]) == (1.0, 0.0, 1.0, 1.0)


def test_years_prune_partitions(spark, tmp_path):
    path = str(tmp_path / "cube")
    rows = spark.range(30).select((F.col("id") % 3 + 2000).cast("int").alias("year"), F.col("id").cast("double").alias("rain_mm"))
    sinks.write_table(rows, path, "year")
    got = readers.read_cube(spark, path, [2001])
    assert got.count() == 10
    assert "PartitionFilters: [isnotnull(year" in got._jdf.queryExecution().executedPlan().toString()


def test_card_and_json_columns(spark, tmp_path):
    sinks.write_card(spark, {"model": "x", "rows": 3}, str(tmp_path / "card"))
    assert readers.read_document(spark, str(tmp_path / "card")) == {"model": "x", "rows": 3}
    df = spark.createDataFrame([(["a", "b"], (1.5,))], "actions array<string>, risk_components struct<anomaly: double>")
    back = stores.decode_json(stores.encode_json(df), {"actions": "array<string>", "risk_components": "struct<anomaly: double>"})
    assert back.collect() == df.collect()


def test_box_and_site_series(spark):
    cube = spark.createDataFrame(
        [(dt.date(2020, 1, d), lat, lon, None if lon == 74.0 else float(d)) for d in (1, 2) for lat in (18.5, 18.75) for lon in (73.75, 74.0)],
        "date date, lat double, lon double, rain_mm double",
    )
    spatial.require_box_inside(cube, {"min_lat": 18.5, "max_lat": 18.7, "min_lon": 73.8, "max_lon": 74.0})
    with pytest.raises(ValueError, match="study box"):
        spatial.require_box_inside(cube, {"min_lat": 18.0, "max_lat": 18.7, "min_lon": 73.8, "max_lon": 74.0})
    sites = spark.createDataFrame([("s", 18.6, 73.99), ("t", 18.625, 73.9)], "site string, lat double, lon double")
    got = spatial.site_series(sites, cube).orderBy("site", "date").collect()
    # the sea cells at 74.0 hold no value; the tie of the second site goes to the lower latitude
    assert [(r["site"], r["grid_lat"], r["grid_lon"], r["rain_mm"]) for r in got] == [
        ("s", 18.5, 73.75, 1.0), ("s", 18.5, 73.75, 2.0), ("t", 18.5, 73.75, 1.0), ("t", 18.5, 73.75, 2.0)]
    ids = [r["cell_id"] for r in spatial.stable_cell_ids(cube, "G").orderBy("lat", "lon").collect()]
    assert ids == ["G001", "G002", "G003", "G004"]


def test_alerts_of_a_day_read_their_partitions_only(spark, tmp_path):
    path = str(tmp_path / "alerts")
    rows = spark.range(40).select(
        F.concat(F.lit("a"), F.col("id")).alias("alert_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("date"),
        F.when(F.col("id") < 20, "public").otherwise("municipal").alias("channel"), F.lit("z").alias("zone"),
    )
    stores.append_alerts(rows, path)
    one = rows.filter("date = DATE'2024-01-04'").withColumn("period", F.date_format("date", stores.BY_DAY))
    before = stores._stored_periods(spark, path, one)
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan or "PartitionFilters: [period" in plan
    assert {f.split("period=")[1].split("/")[0] for f in before.inputFiles()} >= {"d2024-01-04"} and before.count() == 4
    listed = stores.list_alerts(spark, path, "public", date=dt.date(2024, 1, 4))
    assert listed.count() == 2 and "PartitionFilters" in listed._jdf.queryExecution().executedPlan().toString()
    stores.append_alerts(rows.filter("date >= DATE'2024-01-04'"), path)
    assert spark.read.parquet(path).count() == 40
    stores.replace_alerts(rows.filter("date = DATE'2024-01-04'").limit(1), path)
    assert spark.read.parquet(path).count() == 39


def test_the_same_reports_twice_are_stored_once(spark, tmp_path):
    from pluvia.streaming.intake import report_intake

    zones = spark.createDataFrame([("a",)], "zone string")
    data = [("a", "FLOODING", "x", dt.datetime(2024, 1, 1)), ("a", "OTHER", "y", None), ("a", "OTHER", "z", dt.datetime(2023, 1, 1))]
    reports = spark.createDataFrame(data, "zone string, report_type string, description string, ts timestamp_ntz")
    checked = stores.validated_reports(reports, F.lit(True))
    path, incoming, out = (str(tmp_path / n) for n in ("store", "in", "out"))
    for _ in range(2):
        stores.append_reports(checked, path)
        reports.coalesce(1).write.mode("append").json(incoming)
        report_intake(spark, incoming, zones, out, str(tmp_path / "cp")).awaitTermination(120)
    assert stores.stored_reports(spark, path).count() == 3
    assert spark.read.parquet(out).count() == 3
    assert stores.stored_reports(spark, path).columns == spark.read.parquet(out).columns


def test_variant_columns(spark, tmp_path):
    rows = spark.createDataFrame([(1, (1.5, None), ["a", "b"])], "id int, risk_components struct<anomaly: double, other: string>, actions array<string>")
    stores.as_variants(rows).write.parquet(str(tmp_path / "v"))
    fields = {"anomaly": ("risk_components", "$.anomaly", "double"), "gone": ("risk_components", "$.none", "int"), "all": ("actions", "$", "array<string>")}
    r = stores.decoded(spark.read.parquet(str(tmp_path / "v")), fields).first()
    assert (r["anomaly"], r["gone"], r["all"]) == (1.5, None, ["a", "b"])


def test_alerts_are_shuffled_once(spark, tmp_path):
    """Dropping repeated ids and clustering for the writer share one exchange; periods are named without the ids."""
    path = str(tmp_path / "alerts")
    rows = spark.range(60).select(
        F.concat(F.lit("a"), F.col("id") % 30).alias("alert_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 3).cast("int")).alias("date"),
        F.when(F.col("id") % 2 == 0, "public").otherwise("municipal").alias("channel"), F.lit("z").alias("zone"),
    )
    named = rows.withColumn("period", F.date_format("date", stores.BY_DAY))
    plan = stores._once_each(named)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange ") == 1
    for _ in range(2):
        stores.append_alerts(rows, path)
        stored = spark.read.parquet(path)
        assert stored.count() == 30 and stored.select("alert_id").distinct().count() == 30
    stores.append_alerts(rows.withColumn("alert_id", F.concat(F.lit("b"), "alert_id")), path)
    assert spark.read.parquet(path).count() == 60


def test_alert_ids_are_made_after_the_exchange(spark, tmp_path, monkeypatch):
    """Rows travel by what their ids are made of; the store holds what it holds without, and a second run adds nothing."""
    from pluvia.operators import alerts as al

    days = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-02-10')) AS date")
    rows = days.crossJoin(spark.createDataFrame([("Z1",), ("Z2",), (None,)], "zone string")).crossJoin(spark.createDataFrame([("public",), ("municipal",)], "channel string"))
    batch = rows.withColumn("risk_level", F.lit("HIGH")).withColumn("alert_id", al.alert_id())
    batch = batch.unionByName(batch.filter("zone = 'Z1'"))
    seen, keep = [], stores._once_each
    monkeypatch.setattr(stores, "_once_each", lambda df, keys: seen.append(df.columns) or keep(df, keys))
    paths = [str(tmp_path / "plain"), str(tmp_path / "made")]
    for path, made in zip(paths, ({}, {"id_of": al.ID_OF, "made": al.alert_id()})):
        made = {"by": stores.BY_MONTH, **made}
        stores.append_alerts(batch.filter("date < DATE'2024-01-20'"), path, **made)
        stores.append_alerts(batch, path, **made)
        stores.append_alerts(batch, path, **made)
    plain, made = (spark.read.parquet(p).drop("created_at") for p in paths)
    assert plain.columns == made.columns and made.count() == 41 * 6
    assert plain.exceptAll(made).isEmpty() and made.exceptAll(plain).isEmpty()
    assert ["alert_id" in c for c in seen] == [True] * 3 + [False] * 3
