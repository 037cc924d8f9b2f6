"""Point-in-zone, nearest and clip-length joins as tile equi-joins.

No pair of large sides is ever crossed: every condition is turned into an equi-join on
tile keys, and the exact test runs on the matches. Hot tiles are split by AQE because the
other side of such a join is small per tile.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from pluvia.functions.geo import clipped_length, segment_distance, segment_tiles, tile_cover, tile_index
from pluvia.session import stored

_FAN = 4  # tiles per side when a tile is split
_SHIFT = 2  # binary digits of _FAN: a tile's parent is found by shifting its numbers
_LEAF = 8  # aimed number of targets in a tile, where they are evenly spread
_FULL = 64  # a tile with more targets is split; twice as many at each further level
_DEEPEST = 24  # at this level a tile is as narrow as a double's rounding
_SMALL = 3  # levels whose tile table has at most 16^3 rows and is broadcast


def zone_rectangles(zones: DataFrame, half: float, box: dict[str, float] | None = None) -> DataFrame:
    """Zone rectangle centre +- half, cut to the study box."""
    lo_x, hi_x = F.col("lon") - half, F.col("lon") + half
    lo_y, hi_y = F.col("lat") - half, F.col("lat") + half
    if box:
        lo_x, hi_x = F.greatest(lo_x, F.lit(box["min_lon"])), F.least(hi_x, F.lit(box["max_lon"]))
        lo_y, hi_y = F.greatest(lo_y, F.lit(box["min_lat"])), F.least(hi_y, F.lit(box["max_lat"]))
    return zones.select(
        "zone", lo_x.alias("lo_x"), lo_y.alias("lo_y"), hi_x.alias("hi_x"), hi_y.alias("hi_y")
    ).filter("lo_x < hi_x AND lo_y < hi_y")


def point_in_zone(points: DataFrame, rects: DataFrame, tile: float, x="lon", y="lat") -> DataFrame:
    """First zone (by id) whose rectangle strictly contains the point, NULL if none.

    Each tile lists the zones that touch it (a handful when the tile is about as large as a
    zone), so every point meets exactly one tile row: one join, no regrouping of points, and
    a crowded tile can be split by AQE.
    """
    cover = F.explode(tile_cover(F.col("lo_x"), F.col("lo_y"), F.col("hi_x"), F.col("hi_y"), tile))
    box = F.struct("zone", "lo_x", "lo_y", "hi_x", "hi_y")
    tiles = rects.withColumn("t", cover).groupBy("t.tx", "t.ty").agg(F.sort_array(F.collect_list(box)).alias("_zones"))
    px, py = F.col(x), F.col(y)
    inside = lambda z: (px > z["lo_x"]) & (px < z["hi_x"]) & (py > z["lo_y"]) & (py < z["hi_y"])
    located = points.drop("zone").withColumns({"tx": tile_index(px, tile), "ty": tile_index(py, tile)})
    joined = located.join(tiles, ["tx", "ty"], "left")
    return joined.withColumn("zone", F.get(F.filter("_zones", inside), F.lit(0))["zone"]).drop("tx", "ty", "_zones")


def count_in_zones(points: DataFrame, rects: DataFrame, tile: float) -> DataFrame:
    """Points per zone, zero included."""
    hit = point_in_zone(points, rects, tile).filter(F.col("zone").isNotNull())
    counts = hit.groupBy("zone").agg(F.count(F.lit(1)).alias("n"))
    return rects.select("zone").join(counts, "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def _tree(items: DataFrame, cover, rep) -> tuple[dict[int, DataFrame], dict[int, DataFrame], tuple]:
    """Tiles and their pieces of items, by level, and (x0, y0, extent); no items give no levels.

    The items are read once and stored in the tiles of a first level that suits evenly spread ones. Only
    pieces in crowded tiles are dealt again to smaller ones, level by level, so the depth follows the
    targets and a long line is cut finely only where it is crowded. `cover(size, x0, y0)` lists a piece's
    tiles; `rep()` is a point of the piece. Runs a job or two per level that is needed.
    """
    span = Observation()  # counted while the items are written
    edges = {"lx": F.min("_lx"), "ly": F.min("_ly"), "hx": F.max("_hx"), "hy": F.max("_hy"), "n": F.count(F.lit(1))}
    edges["sides"] = F.sum(F.col("_hx") - F.col("_lx") + F.col("_hy") - F.col("_ly"))
    whole = items.withColumns({"_t0": F.lit(0.0), "_t1": F.lit(1.0)})
    held = stored(whole.observe(span, *[c.alias(n) for n, c in edges.items()]), "nearest-items")
    lx, ly, hx, hy, n, sides = (span.get[c] for c in edges)
    if n == 0:
        return {}, {}, ()
    extent = max(hx - lx, hy - ly, 1e-9) * (1.0 + 1e-9)
    even = math.log(n / _LEAF + 1, _FAN * _FAN)
    # at most about three tiles a line, where lines are evenly long
    long = math.log(max(2.0 * n * (extent / sides), _FAN), _FAN) if sides > extent * 1e-9 else _DEEPEST
    level = first = max(1, min(_DEEPEST, math.ceil(even), math.ceil(long)))
    cells, pieces = {}, {}
    parts = held
    while True:
        size = extent / _FAN**level
        tile = F.explode(cover(size, lx, ly)).alias("_t")
        named = ["_t.tx", "_t.ty", "_t.t0", "_t.t1"]
        own = [c for c in items.columns if c not in ("_lx", "_ly", "_hx", "_hy")]
        if level == first:
            parts = parts.select(*own, "_t0", "_t1", tile).select(*own, *[F.col(c).alias("_" + c[3:]) for c in named])
        else:
            # rounding must not move a part out of the tile that is split
            inside = lambda t, up: F.greatest(F.col(up) * _FAN, F.least(F.col(up) * _FAN + _FAN - 1, F.col(t)))
            parts = parts.select(*own, "_t0", "_t1", F.col("_tx").alias("_ux"), F.col("_ty").alias("_uy"), tile).select(
                *own, inside("_t.tx", "_ux").alias("_tx"), inside("_t.ty", "_uy").alias("_ty"), F.col("_t.t0").alias("_t0"), F.col("_t.t1").alias("_t1")
            )
        # pieces of the first level are the stored items; later ones are stored themselves
        pieces[level] = parts = parts if level == first else stored(parts, f"nearest-pieces-{level}")
        grouped = parts.groupBy("_tx", "_ty").agg(F.min(rep()).alias("_rep"), F.count(F.lit(1)).alias("_n"))
        crowded, load = (F.col("_n") > _FULL * 2 ** (level - first)) & F.lit(level < _DEEPEST), Observation()
        leaves = grouped.observe(load, F.count_if(crowded).alias("crowded"))
        cells[level] = stored(leaves.select("_tx", "_ty", "_rep", (~crowded).alias("_leaf")), f"nearest-cells-{level}")
        if not load.get["crowded"]:
            return cells, pieces, (lx, ly, extent)
        split = cells[level].where("not _leaf").select("_tx", "_ty")
        parts = parts.join(split, ["_tx", "_ty"], "left_semi")
        level += 1


def _nearest(queries: DataFrame, key: str, items: DataFrame, cover, rep, distance, qx: str, qy: str, tie: list[str]) -> DataFrame:
    """Exact nearest item per query by descending a tree of tiles.

    Each tile keeps one point of an item in it, so the distance to it bounds the nearest distance
    from above; a tile whose own nearest corner is farther than the best bound is dropped. Per level:
    one equi-join with the tile table (at most 16 children per tile) and one window per query over
    its few tiles. Levels above the first stored one are its tile numbers shifted.
    """
    cells, pieces, span = _tree(items, cover, rep)
    if not cells:
        kinds = {f.name: f.dataType for f in items.schema.fields}
        return queries.select(key, F.lit(None).cast("double").alias("_d"), *[F.lit(None).cast(kinds[t]).alias(t) for t in tie])
    x0, y0, extent = span
    first, last = min(cells), max(cells)
    frontier = queries.select(key, F.col(qx).alias("_qx"), F.col(qy).alias("_qy")).where("_qx is not null and _qy is not null")
    kept = [key, "_qx", "_qy", "_level", "_tx", "_ty", "_lo", "_up"]
    arrived = None
    for level in range(1, last + 1):
        if level < first:
            up = _SHIFT * (first - level)
            shifted = [F.shiftright(F.col(c), up).alias(c) for c in ("_tx", "_ty")]
            tiles = cells[first].groupBy(*shifted).agg(F.min("_rep").alias("_rep")).withColumn("_leaf", F.lit(False))
        else:
            tiles = cells[level]
        tiles = tiles.select(F.col("_tx").alias("_cx"), F.col("_ty").alias("_cy"), "_rep._rx", "_rep._ry", "_leaf")
        side = extent / _FAN**level

        def bounds(tile):
            """Squared distance to the tile, and to its known item."""
            left, low = tile("_cx") * side + x0, tile("_cy") * side + y0
            dx = F.greatest(left - F.col("_qx"), F.lit(0.0), F.col("_qx") - left - side)
            dy = F.greatest(low - F.col("_qy"), F.lit(0.0), F.col("_qy") - low - side)
            ux, uy = tile("_rx") - F.col("_qx"), tile("_ry") - F.col("_qy")
            return {"_lo": dx * dx + dy * dy, "_up": ux * ux + uy * uy, "_level": F.when(tile("_leaf"), level)}

        # a hair of slack keeps rounding from dropping the true tile
        within = lambda lo, least: lo <= least * (1.0 + 1e-9) + 1e-12
        if level == 1:
            # all tiles are children of the root, sixteen at most: handed over as literals and judged inside the row
            names = tiles.columns
            below = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in tiles.collect()])
            judged = F.transform(below, lambda t: F.struct(t["_cx"].alias("_tx"), t["_cy"].alias("_ty"), *[c.alias(n) for n, c in bounds(lambda k: t[k]).items()]))
            children = frontier.withColumn("_all", judged).withColumn("_least", F.array_min(F.transform("_all", lambda t: t["_up"])))
            children = children.select(key, "_qx", "_qy", F.inline(F.filter("_all", lambda t: within(t["_lo"], F.col("_least")))))
            frontier = children.select(*kept)
            if first == level < last:
                arrived, frontier = frontier.where("_level is not null"), frontier.where("_level is null")
            continue
        tiles = tiles.withColumns({"_tx": F.shiftright("_cx", _SHIFT), "_ty": F.shiftright("_cy", _SHIFT)})
        tiles = F.broadcast(tiles) if level <= _SMALL else tiles
        children = frontier.select(key, "_qx", "_qy", "_tx", "_ty").join(tiles, ["_tx", "_ty"]).withColumns(bounds(F.col))
        children = children.select(key, "_qx", "_qy", "_level", F.col("_cx").alias("_tx"), F.col("_cy").alias("_ty"), "_lo", "_up")
        every = children if arrived is None else children.unionByName(arrived)
        near = within(F.col("_lo"), F.min("_up").over(Window.partitionBy(key)))
        every = every.withColumn("_near", near).filter("_near").select(*kept)
        if first <= level < last:
            every = stored(every, f"nearest-frontier-{level}")
            arrived = every.where("_level is not null")
            frontier = every.where("_level is null")
        else:
            frontier = every
    own = pieces[first].withColumn("_level", F.lit(first))
    for level in range(first + 1, last + 1):
        own = own.unionByName(pieces[level].withColumn("_level", F.lit(level)))
    pairs = frontier.drop("_lo", "_up").join(own, ["_level", "_tx", "_ty"]).withColumn("_d", distance(F.col("_qx"), F.col("_qy")))
    payload = F.struct("_d", *tie)
    best = pairs.groupBy(key).agg(F.min(payload).alias("_b")).select(key, "_b.*")
    return queries.select(key).distinct().join(best, key, "left")  # a query without a place keeps its row


def nearest_point(queries: DataFrame, key: str, targets: DataFrame, qx="x", qy="y", tx="x", ty="y", tie=()) -> DataFrame:
    """Nearest target of every query by squared distance; ties by the `tie` columns. Runs jobs."""
    x, y = F.col(tx), F.col(ty)
    items = targets.select(
        *[F.col(c) for c in tie], x.alias("_rx"), y.alias("_ry"), x.alias("_lx"), y.alias("_ly"), x.alias("_hx"), y.alias("_hy"),
    ).where("_rx is not null and _ry is not null").distinct()

    def cover(size, x0, y0):
        at = [tile_index(F.col("_rx") - x0, size).alias("tx"), tile_index(F.col("_ry") - y0, size).alias("ty")]
        return F.array(F.struct(*at, F.col("_t0").alias("t0"), F.col("_t1").alias("t1")))

    def rep():
        return F.struct("_rx", "_ry")

    def distance(px, py):
        ex, ey = F.col("_rx") - px, F.col("_ry") - py
        return ex * ex + ey * ey

    return _nearest(queries, key, items, cover, rep, distance, qx, qy, list(tie)).withColumnRenamed("_d", "d2")


def nearest_line_distance(points: DataFrame, key: str, segments: DataFrame, qx="x", qy="y") -> DataFrame:
    """Smallest distance from each point to any segment. Runs jobs."""
    lx, hx = F.least("x1", "x2"), F.greatest("x1", "x2")
    ly, hy = F.least("y1", "y2"), F.greatest("y1", "y2")
    ends = ["x1", "y1", "x2", "y2"]
    items = segments.select(*ends, lx.alias("_lx"), ly.alias("_ly"), hx.alias("_hx"), hy.alias("_hy")).dropna(subset=ends).distinct()

    def place(a: str, b: str, t: Column) -> Column:
        return F.col(a) + t * (F.col(b) - F.col(a))

    def cover(size, x0, y0):
        t0, t1 = F.col("_t0"), F.col("_t1")
        walk = segment_tiles(place("x1", "x2", t0) - x0, place("y1", "y2", t0) - y0, place("x1", "x2", t1) - x0, place("y1", "y2", t1) - y0, size)
        return F.transform(walk, lambda w: F.struct(w["tx"].alias("tx"), w["ty"].alias("ty"), *[(t0 + w[t] * (t1 - t0)).alias(t) for t in ("t0", "t1")]))

    def rep():
        middle = (F.col("_t0") + F.col("_t1")) / 2.0
        return F.struct(place("x1", "x2", middle).alias("_rx"), place("y1", "y2", middle).alias("_ry"))

    def distance(px, py):
        return segment_distance(px, py, F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))

    near = _nearest(points, key, items, cover, rep, distance, qx, qy, [])
    return near.select(key, F.col("_d").alias("distance_m"))


def line_length_in_zones(segments: DataFrame, rects: DataFrame, tile: float) -> DataFrame:
    """Length of the lines inside each zone and per km2; zones without lines get 0, an empty layer
    gives NULL.

    A segment goes to the tiles it runs through, cut at their borders; the part in a tile is clipped to the
    zones that touch the tile, so lengths add up over tiles and no pair has to be deduplicated. Zones may share
    a rectangle: lines are clipped once to each different one, and its length goes to all its zones.
    """
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    at = lambda t: [F.col("x1") + F.col(t) * dx, F.col("y1") + F.col(t) * dy]
    walk = F.explode(segment_tiles(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), tile))
    seg = segments.withColumn("t", walk).select("x1", "y1", "x2", "y2", "t.tx", "t.ty", "t.t0", "t.t1")
    box = ["lo_x", "lo_y", "hi_x", "hi_y"]
    cover = F.explode(tile_cover(F.col("lo_x"), F.col("lo_y"), F.col("hi_x"), F.col("hi_y"), tile))
    rect = rects.select(*box).distinct().withColumn("t", cover).select(*box, "t.tx", "t.ty")
    length = clipped_length(*at("t0"), *at("t1"), F.col("lo_x"), F.col("lo_y"), F.col("hi_x"), F.col("hi_y"))
    inside = seg.join(rect, ["tx", "ty"]).groupBy(*box).agg(F.sum(length).alias("length_m"))
    sums = rects.select("zone", *box).join(inside, box).groupBy("zone").agg(F.sum("length_m").alias("length_m"))
    some = segments.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    area = (F.col("hi_x") - F.col("lo_x")) * (F.col("hi_y") - F.col("lo_y")) / 1e6
    out = rects.join(sums, "zone", "left")
    out = out.withColumn("length_m", F.when(some, F.coalesce("length_m", F.lit(0.0))))
    return out.select("zone", "length_m", (F.col("length_m") / area).alias("m_per_km2"))


def layer_statistics(segments: DataFrame, tag: str, study: tuple[float, float, float, float]) -> DataFrame:
    """Segment and line counts and extent per tag, and whether the extent covers the study box."""
    lx, hx = F.least("x1", "x2"), F.greatest("x1", "x2")
    ly, hy = F.least("y1", "y2"), F.greatest("y1", "y2")
    agg = segments.groupBy(tag).agg(
        F.count(F.lit(1)).alias("segments"), F.count_distinct("line_id").alias("lines"),
        F.min(lx).alias("min_x"), F.min(ly).alias("min_y"), F.max(hx).alias("max_x"), F.max(hy).alias("max_y"),
    )
    covers = (F.col("min_x") <= study[0]) & (F.col("min_y") <= study[1]) & (F.col("max_x") >= study[2]) & (F.col("max_y") >= study[3])
    return agg.withColumn("covers", covers)


def require_box_inside(df: DataFrame, box: dict[str, float], lon: str = "lon", lat: str = "lat") -> None:
    """Fails unless the study box lies inside the extent of the data. Runs a job (four numbers)."""
    e = df.agg(F.min(lon), F.max(lon), F.min(lat), F.max(lat)).first()
    if e[0] is None or box["min_lon"] < e[0] or box["max_lon"] > e[1] or box["min_lat"] < e[2] or box["max_lat"] > e[3]:
        raise ValueError(f"study box {box} is not inside the data extent {tuple(e)}")


def stable_cell_ids(cells: DataFrame, prefix: str, width: int = 3) -> DataFrame:
    """Ids by (lat, lon) order, zero-padded to at least `width` digits. Runs a job."""
    from pluvia.operators.rank import global_position

    placed = global_position(cells.select("lat", "lon").distinct(), ["lat", "lon"], "_p")
    digits = (F.col("_p") + 1).cast("string")
    padded = F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0"))
    return placed.select("lat", "lon", F.concat(F.lit(prefix), padded).alias("cell_id"))


def land_cells(cube: DataFrame, value: str = "rain_mm") -> DataFrame:
    """Cells of the cube that ever hold a value, i.e. whose mean is known."""
    return cube.groupBy("lat", "lon").agg(F.count(value).alias("_n")).filter("_n > 0").select("lat", "lon")


def site_series(sites: DataFrame, cube: DataFrame, value: str = "rain_mm") -> DataFrame:
    """Each site takes the daily series of its nearest land cell (lowest lat, lon on ties)."""
    cells = land_cells(cube, value).select(F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon"))
    near = nearest_point(sites, "site", cells, "lon", "lat", "grid_lon", "grid_lat", ("grid_lat", "grid_lon")).drop("d2")
    daily = cube.select("date", F.col("lat").alias("grid_lat"), F.col("lon").alias("grid_lon"), value)
    return daily.join(near, ["grid_lat", "grid_lon"])
