"""Tile joins against brute force, with most of the data in one spot."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.functions.geo import segment_tiles, utm
from pluvia.operators import raster, spatial


def _clustered(rng, n, scale=1000.0):
    pts = rng.uniform(0, scale, (n, 2))
    pts[: n // 2] = rng.normal(700.0, 0.01, (n // 2, 2))  # half of them inside a few centimetres
    return pts


def test_nearest_point(spark):
    rng = np.random.default_rng(5)
    t, q = _clustered(rng, 3000), _clustered(rng, 600)
    q[:20] = rng.uniform(-4000, 5000, (20, 2))
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(t)], "t int, x double, y double")
    queries = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(q)], "q int, x double, y double")
    got = {r["q"]: (r["t"], r["d2"]) for r in spatial.nearest_point(queries, "q", targets, tie=("t",)).collect()}
    d2 = ((q[:, None, :] - t[None, :, :]) ** 2).sum(axis=2)
    assert len(got) == len(q)
    for i in range(len(q)):
        assert got[i][1] == pytest.approx(d2[i].min(), rel=1e-9, abs=1e-12)


def test_nearest_line(spark):
    rng = np.random.default_rng(6)
    a = _clustered(rng, 400)
    b = a + rng.normal(0, 40, a.shape)
    q = rng.uniform(-200, 1200, (200, 2))
    seg = spark.createDataFrame([tuple(map(float, (*s, *e))) for s, e in zip(a, b)], "x1 double, y1 double, x2 double, y2 double")
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "id int, x double, y double")
    got = {r["id"]: r["distance_m"] for r in spatial.nearest_line_distance(pts, "id", seg).collect()}
    d = b - a
    for i, p in enumerate(q):
        t = np.clip(((p - a) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
        assert got[i] == pytest.approx(np.sqrt(((p - (a + t[:, None] * d)) ** 2).sum(axis=1)).min(), rel=1e-9)


def test_empty_line_layer_gives_null(spark):
    seg = spark.createDataFrame([], "x1 double, y1 double, x2 double, y2 double")
    rect = spark.createDataFrame([("z", 0.0, 0.0, 10.0, 10.0)], "zone string, lo_x double, lo_y double, hi_x double, hi_y double")
    assert spatial.line_length_in_zones(seg, rect, 5.0).first()["length_m"] is None
    pts = spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double")
    assert spatial.nearest_line_distance(pts, "id", seg).first()["distance_m"] is None


def test_point_on_the_border_is_outside(spark):
    rect = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 0.5, 0.0, 2.0, 1.0)], "zone string, lo_x double, lo_y double, hi_x double, hi_y double")
    pts = spark.createDataFrame([(1, 0.0, 0.5), (2, 0.7, 0.5), (3, 1.5, 0.5), (4, 9.0, 9.0)], "id int, lon double, lat double")
    got = {r["id"]: r["zone"] for r in spatial.point_in_zone(pts, rect, 0.4).collect()}
    assert got == {1: None, 2: "a", 3: "b", 4: None}


def test_utm_known_points(spark):
    # central meridian and a symmetric pair: easting mirrors around 500 km
    df = spark.createDataFrame([(75.0, 0.0), (74.0, 18.5), (76.0, 18.5)], "lon double, lat double")
    x, y = utm(F.col("lon"), F.col("lat"))
    r = df.select(x.alias("x"), y.alias("y")).collect()
    assert r[0]["x"] == pytest.approx(500000.0) and r[0]["y"] == pytest.approx(0.0, abs=1e-9)
    assert r[1]["x"] + r[2]["x"] == pytest.approx(1_000_000.0) and r[1]["y"] == pytest.approx(r[2]["y"])
    assert 394_000 < r[1]["x"] < 395_000 and 2_045_000 < r[1]["y"] < 2_047_000


def test_horn_slope_of_a_plane(spark):
    z = [(r, c, 3.0 * c) for r in range(6) for c in range(6)]
    df = spark.createDataFrame(z, "row int, col int, z double")
    out = {(r["row"], r["col"]): r["slope_deg"] for r in raster.horn_slope(df, 30.0, 30.0).collect()}
    assert out[(2, 2)] == pytest.approx(np.degrees(np.arctan(0.1)))
    holed = df.filter("NOT (row = 2 AND col = 2)")
    out = {(r["row"], r["col"]): r["slope_deg"] for r in raster.horn_slope(holed, 30.0, 30.0).collect()}
    assert out[(1, 1)] is None and out[(3, 3)] is None and out[(4, 4)] is not None


def _fractions(cls, hits, size):
    r = size // 2
    out = {}
    for (row, col) in cls:
        seen = [cls.get((y, x), 0) for y in range(row - r, row + r + 1) for x in range(col - r, col + r + 1)]
        valid = sum(c != 0 for c in seen)
        out[(row, col)] = sum(c in hits for c in seen) / valid if valid else None
    return out


def test_fractions_in_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    # with holes, so that a window also counts pixels whose row or column lacks the centre
    cls = {(int(r), int(c)): int(rng.choice([0, 10, 50])) for r in range(-5, 25) for c in range(17) if rng.random() > 0.2}
    df = spark.createDataFrame([(r, c, k) for (r, c), k in cls.items()], "row int, col int, cls int")
    got = {(x["row"], x["col"]): x["fraction"] for x in raster.local_fraction(df, (50,), 7, block=8).collect()}
    assert got == pytest.approx(_fractions(cls, {50}, 7))


def test_a_tall_raster_of_one_block_width(spark):
    tall = spark.range(10_000 * 4).select((F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"))
    tall = tall.withColumns({"z": (F.col("row") % 97 + F.col("col") * 2).cast("double"), "cls": F.when(F.col("row") % 3 == 0, 50).otherwise(10)})
    part = raster.local_fraction(tall, (50,), 5, block=64)
    assert part.where("row = 5000").first()["fraction"] == pytest.approx(sum(y % 3 == 0 for y in range(4998, 5003)) / 5)
    assert part.count() == 40_000
    z = np.add.outer(np.arange(10_000) % 97, np.arange(4) * 2).astype(float)
    p = np.pad(z, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]) / 240.0
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]) / 240.0
    want = np.degrees(np.arctan(np.hypot(gx, gy)))
    got = np.empty_like(want)
    for x in raster.horn_slope(tall, 30.0, 30.0, block=64).collect():
        got[x["row"], x["col"]] = x["slope_deg"]
    assert np.allclose(got, want)
    dy, dx = np.gradient(z, 30.0)
    got = np.empty_like(want)
    for x in raster.central_slope(tall, block=64).collect():
        got[x["row"], x["col"]] = x["slope_deg"]
    assert np.allclose(got, np.degrees(np.arctan(np.hypot(dx, dy))))


def test_raster_windows_stay_inside_blocks(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 50)], "row int, col int, z double, cls int")
    for out in (raster.horn_slope(df, 30.0, 30.0), raster.central_slope(df), raster.local_fraction(df)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert all("_br" in line for line in plan.splitlines() if "Window [" in line)


def test_bands_meet_in_blocks(spark):
    rng = np.random.default_rng(9)
    to, frm, grid = raster.Affine(10.0, 20.0, 0.3, 0.37), raster.Affine(9.7, 20.3, 0.25, 0.31), raster.Affine(10.1, 19.9, 0.4, 0.22)
    band = lambda: {(int(r), int(c)): float(rng.uniform(0, 9)) for r, c in rng.integers(-2, 30, (500, 2))}
    elev, slope, cover = band(), band(), band()
    cells = sorted({(int(r), int(c)) for r, c in rng.integers(-2, 25, (300, 2))})
    frame = lambda d, n: spark.createDataFrame([(*k, v) for k, v in d.items()] + [(None, 3, 1.0)], f"row int, col int, {n} double")
    target = spark.createDataFrame([*cells, (None, 1)], "row int, col int")

    def smooth(values, r, c):
        fx = (to.left + (c + 0.5) * to.dx - frm.left) / frm.dx - 0.5
        fy = (frm.top - (to.top - (r + 0.5) * to.dy)) / frm.dy - 0.5
        near = [(values.get((y, x)), (1 - abs(fy - y)) * (1 - abs(fx - x))) for y in (int(fy // 1), int(fy // 1) + 1) for x in (int(fx // 1), int(fx // 1) + 1)]
        near = [(v, w) for v, w in near if v is not None and w > 0]
        return sum(v * w for v, w in near) / sum(w for _, w in near) if near else None

    for block in (4, 512):
        out = raster.stack_bands(target, to, frame(elev, "elevation_m"), frame(slope, "slope_deg"), frm, frame(cover, "cls"), grid, block)
        assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # no pixel is sent for each of its neighbours
        got = {(x["row"], x["col"]): x for x in out.collect()}
        assert sorted(got) == cells
        for (r, c), x in got.items():
            for want, have in ((smooth(elev, r, c), x["elevation_m"]), (smooth(slope, r, c), x["slope_deg"])):
                assert have is None if want is None else have == pytest.approx(want)
            at = int((grid.top - (to.top - (r + 0.5) * to.dy)) / grid.dy // 1), int((to.left + (c + 0.5) * to.dx - grid.left) / grid.dx // 1)
            assert x["cls"] == cover.get(at)
    twice = spark.createDataFrame([(0, 0), (0, 0)], "row int, col int")  # rows of one key meet one another
    assert raster.resample_bilinear(twice, to, frame(elev, "z"), frm, "z").count() == 2
    assert raster.resample_nearest(target, to, frame(cover, "z"), grid, "z").count() == len(cells) + 1


def test_a_line_is_listed_in_the_tiles_it_runs_through(spark):
    rng = np.random.default_rng(4)
    lines = [(0.0, 0.0, 100.0, 100.0), (100.0, 100.0, 0.0, 0.0), (3.0, 4.0, 3.0, 4.0), (-2.5, 7.0, 91.0, 7.0), (10.0, 20.0, 10.0, -60.0)]
    lines += [tuple(map(float, rng.uniform(-50, 50, 4))) for _ in range(60)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "i int, x1 double, y1 double, x2 double, y2 double")
    tiles = F.explode(segment_tiles(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), 10.0))
    found = {}
    for r in df.select("i", tiles.alias("t")).select("i", "t.*").collect():
        found.setdefault(r["i"], []).append((r["tx"], r["ty"], r["t0"], r["t1"]))
    for i, (x1, y1, x2, y2) in enumerate(lines):
        n = max(abs(int(x2 // 10) - int(x1 // 10)), abs(int(y2 // 10) - int(y1 // 10))) + 1
        assert len(found[i]) <= 2 * n + 1
        assert found[i][0][2] == 0.0 and found[i][-1][3] == 1.0
        assert all(a[3] == b[2] for a, b in zip(found[i], found[i][1:]))
        for t in rng.uniform(0, 1, 50):
            at = [k for k in found[i] if k[2] <= t <= k[3]][0]
            x, y = x1 + t * (x2 - x1), y1 + t * (y2 - y1)
            assert (at[0], at[1]) == (x // 10, y // 10)


def test_line_lengths_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    seg = [tuple(map(float, rng.uniform(0, 100, 4))) for _ in range(80)] + [(10.0, 0.0, 10.0, 50.0), (0.0, 0.0, 90.0, 90.0)]
    box = [("a", 10.0, 10.0, 40.0, 35.0), ("b", 0.0, 0.0, 100.0, 100.0), ("c", 35.0, 5.0, 36.0, 95.0), ("d", 200.0, 0.0, 210.0, 10.0)]
    segments = spark.createDataFrame(seg, "x1 double, y1 double, x2 double, y2 double")
    rects = spark.createDataFrame(box, "zone string, lo_x double, lo_y double, hi_x double, hi_y double")
    got = {r["zone"]: r["length_m"] for r in spatial.line_length_in_zones(segments, rects, 7.0).collect()}
    for zone, lx, ly, hx, hy in box:
        want = 0.0
        for x1, y1, x2, y2 in seg:
            t = np.array([0.0, 1.0])
            for a, b, lo, hi in ((x1, x2, lx, hx), (y1, y2, ly, hy)):
                if a == b:
                    t = t if lo <= a <= hi else np.array([1.0, 0.0])
                else:
                    u = sorted([(lo - a) / (b - a), (hi - a) / (b - a)])
                    t = np.array([max(t[0], u[0]), min(t[1], u[1])])
            want += max(0.0, t[1] - t[0]) * np.hypot(x2 - x1, y2 - y1)
        assert got[zone] == pytest.approx(want, abs=1e-9)


def test_targets_are_read_once(spark):
    rng = np.random.default_rng(9)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    t = _clustered(rng, 5000)
    targets = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(t)], "t int, x double, y double")
    targets = targets.mapInArrow(counted, targets.schema)
    queries = spark.createDataFrame([(1, 700.0, 700.0), (2, -50.0, 3.0), (3, None, 1.0)], "q int, x double, y double")
    near = spatial.nearest_point(queries, "q", targets, tie=("t",))
    assert near.count() == 3 and reads.value == 5000


def test_zones_of_one_rectangle_are_clipped_once(spark):
    """Work follows the different rectangles; a zone that is listed twice adds both its rows up, as before."""
    segments = spark.createDataFrame([(0.5, 0.5, 3.5, 0.5), (1.0, 1.0, 1.0, 3.0)], "x1 double, y1 double, x2 double, y2 double")
    boxes = [(f"Z{i}", 0.0, 0.0, 2.0, 2.0) for i in range(50)] + [("far", 8.0, 8.0, 9.0, 9.0), ("two", 0.0, 0.0, 2.0, 2.0), ("two", 0.0, 0.0, 4.0, 4.0)]
    rects = spark.createDataFrame(boxes, "zone string, lo_x double, lo_y double, hi_x double, hi_y double")
    out = spatial.line_length_in_zones(segments, rects, 1.5)
    assert out.count() == len(boxes)
    got = {r["zone"]: r["length_m"] for r in out.collect()}
    assert got == {**{f"Z{i}": 2.5 for i in range(50)}, "far": 0.0, "two": 7.5}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [lo_x#") == 2  # one rectangle of a kind is dealt to tiles, lengths are added up by rectangle
