"""Raster bands as pixel tables (row, col, value).

(row, col) is unique. Neighbourhoods are computed in square blocks: every pixel goes to its own
block and to those whose halo it lies in, so a task holds a block of fixed size whatever the shape
of the raster, and no window runs over a whole row or column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import fixed_values as fv
from pluvia.functions.geo import tile_cover, tile_index
from pluvia.functions.numeric import round_to

#: Pixels on a side of a block.
BLOCK = 256


@dataclass(frozen=True)
class Affine:
    """North-up grid: left and top edge, pixel width and height."""

    left: float
    top: float
    dx: float
    dy: float

    def center(self) -> dict[str, Column]:
        return {
            "lon": F.lit(self.left) + (F.col("col") + 0.5) * self.dx,
            "lat": F.lit(self.top) - (F.col("row") + 0.5) * self.dy,
        }

    def index(self, lon: Column, lat: Column) -> dict[str, Column]:
        return {
            "row": F.floor((F.lit(self.top) - lat) / self.dy).cast("int"),
            "col": F.floor((lon - self.left) / self.dx).cast("int"),
        }


def _in_rectangles(pixels: DataFrame, grid: Affine, rects: DataFrame, tile: float) -> DataFrame:
    cover = rects.withColumn(
        "t", F.explode(tile_cover(F.col("lo_x"), F.col("lo_y"), F.col("hi_x"), F.col("hi_y"), tile))
    ).select("zone", "lo_x", "lo_y", "hi_x", "hi_y", "t.tx", "t.ty")
    at = pixels.withColumns(grid.center())
    at = at.withColumns({"tx": tile_index(F.col("lon"), tile), "ty": tile_index(F.col("lat"), tile)})
    inside = (
        (F.col("lon") >= F.col("lo_x")) & (F.col("lon") < F.col("hi_x"))
        & (F.col("lat") >= F.col("lo_y")) & (F.col("lat") < F.col("hi_y"))
    )
    return at.join(cover, ["tx", "ty"]).filter(inside)


def zonal_stats(pixels: DataFrame, grid: Affine, rects: DataFrame, tile: float, value="z") -> DataFrame:
    """Mean, min, max and count of valid pixels whose centre lies in the zone."""
    hits = _in_rectangles(pixels.filter(F.col(value).isNotNull()).select("row", "col", value), grid, rects, tile)
    agg = hits.groupBy("zone").agg(
        F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("valid_px")
    )
    return rects.select("zone").join(agg, "zone", "left").withColumn("valid_px", F.coalesce("valid_px", F.lit(0)))


def class_shares(pixels: DataFrame, grid: Affine, rects: DataFrame, tile: float, cls="cls") -> DataFrame:
    """Percent of valid pixels per class family; NULL for a zone without valid pixels."""
    valid = pixels.filter(F.col(cls) != fv.LC_NODATA).select("row", "col", cls)
    hits = _in_rectangles(valid, grid, rects, tile)
    n = F.count(F.lit(1))
    pct = lambda codes: round_to(F.count_if(F.col(cls).isin(*codes)) * 100.0 / n, 4)
    agg = hits.groupBy("zone").agg(
        pct(fv.LC_BUILT_UP).alias("built_up_pct"),
        pct(fv.LC_VEGETATION).alias("vegetation_pct"),
        pct(fv.LC_WATER).alias("water_cover_pct"),
        pct(fv.LC_CROPLAND).alias("cropland_pct"),
        n.alias("lc_valid_px"),
    )
    return rects.select("zone").join(agg, "zone", "left").withColumn("lc_valid_px", F.coalesce("lc_valid_px", F.lit(0)))


def class_counts(pixels: DataFrame, grid: Affine, rects: DataFrame, tile: float, cls="cls") -> DataFrame:
    """Pixels per zone and class."""
    valid = pixels.filter(F.col(cls) != fv.LC_NODATA).select("row", "col", cls)
    return _in_rectangles(valid, grid, rects, tile).groupBy("zone", cls).agg(F.count(F.lit(1)).alias("n"))


def in_blocks(pixels: DataFrame, halo: int, block: int = BLOCK) -> DataFrame:
    """Pixels once per block (_br, _bc) that holds them or has them in its halo; `_own` marks the block that holds them."""
    first = lambda axis: F.floor((F.col(axis) - halo) / block).cast("int")
    last = lambda axis: F.floor((F.col(axis) + halo) / block).cast("int")
    spread = pixels.withColumn("_br", F.explode(F.sequence(first("row"), last("row"))))
    spread = spread.withColumn("_bc", F.explode(F.sequence(first("col"), last("col"))))
    own = (F.floor(F.col("row") / block) == F.col("_br")) & (F.floor(F.col("col") / block) == F.col("_bc"))
    return spread.withColumn("_own", own)


def window_sums(flags: np.ndarray, size: int) -> np.ndarray:
    """Sums of all size x size windows inside an integer array, from its summed-area table."""
    area = np.zeros((flags.shape[0] + 1, flags.shape[1] + 1), dtype=np.int64)
    area[1:, 1:] = flags.cumsum(axis=0).cumsum(axis=1)
    return area[size:, size:] - area[:-size, size:] - area[size:, :-size] + area[:-size, :-size]


def local_fraction(pixels: DataFrame, codes: Sequence[int] = fv.LC_BUILT_UP, size: int = 69, cls="cls", block: int = BLOCK) -> DataFrame:
    """Share of the codes among valid pixels of the size x size window; outside counts as 0.

    `size` is odd. Each block adds up its flags and those of its halo once, in a summed-area table of
    integers; a window of any size is then four lookups. NULL where the window holds no valid pixel.
    """
    r = size // 2

    def fractions(part: pa.Table) -> pa.Table:
        top, left = part["_br"][0].as_py() * block - r, part["_bc"][0].as_py() * block - r
        row, col = (part[c].to_numpy() for c in ("row", "col"))
        sums = []
        for flag in ("_b", "_v"):
            dense = np.zeros((block + 2 * r, block + 2 * r), dtype=np.int64)
            np.add.at(dense, (row - top, col - left), part[flag].to_numpy())
            sums.append(window_sums(dense, size))
        own = part["_own"].to_numpy(zero_copy_only=False)
        row, col = row[own], col[own]
        hit, valid = (x[row - top - r, col - left - r] for x in sums)
        share = np.divide(hit, valid, out=np.zeros(len(hit)), where=valid > 0)
        return pa.table({"row": pa.array(row, pa.int32()), "col": pa.array(col, pa.int32()), "fraction": pa.array(share, mask=valid == 0)})

    # a pixel with a NULL class is neither valid nor of the codes
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    flags = pixels.select(
        F.col("row").cast("int"), F.col("col").cast("int"), flag(F.col(cls).isin(*codes)).alias("_b"), flag(F.col(cls) != fv.LC_NODATA).alias("_v")
    )
    return in_blocks(flags, r, block).groupBy("_br", "_bc").applyInArrow(fractions, "row int, col int, fraction double")


def _extent(pixels: DataFrame):
    """First and last row, first and last column. Runs a job (four numbers)."""
    return pixels.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()


def _block_windows(pixels: DataFrame, value: str, block: int) -> tuple[DataFrame, Window, Window]:
    """Pixels in blocks with a halo of one, dealt once by block, and the windows along a block's rows and columns."""
    dealt = in_blocks(pixels.select("row", "col", value), 1, block).repartition("_br", "_bc")
    along = Window.partitionBy("_br", "_bc", "row").orderBy("col")
    down = Window.partitionBy("_br", "_bc", "col").orderBy("row")
    return dealt, along, down


def _neighbours(pixels: DataFrame, value: str, block: int) -> DataFrame:
    """Columns n_<dr><dc> of the 3x3 block; a missing pixel is NULL, edges repeat the border pixel. Runs a job."""
    b = _extent(pixels)
    row, col, z = F.col("row"), F.col("col"), F.col(value)
    dealt, wr, wc = _block_windows(pixels, value, block)
    side = lambda fn, step, edge: F.when(col == edge, z).when(fn("col").over(wr) == col + step, fn(value).over(wr))
    three = dealt.select(
        "_br", "_bc", "_own", "row", "col", side(F.lag, -1, b[2]).alias("_w"), z.alias("_c"), side(F.lead, 1, b[3]).alias("_e")
    ).withColumn("_t", F.struct("_w", "_c", "_e"))
    vert = lambda fn, step, edge: F.when(row == edge, F.col("_t")).when(fn("row").over(wc) == row + step, fn("_t").over(wc))
    return three.select(
        "_own", "row", "col", "_t", vert(F.lag, -1, b[0]).alias("_n"), vert(F.lead, 1, b[1]).alias("_s")
    ).filter("_own").drop("_own")


def horn_slope(pixels: DataFrame, dx_m: float, dy_m: float, value="z", block: int = BLOCK) -> DataFrame:
    """Horn 3x3 slope in degrees; NULL when any of the nine pixels is missing. Runs a job."""
    n = _neighbours(pixels, value, block)
    a, b, c = (F.col(f"_n._{k}") for k in "wce")
    d, e, f = (F.col(f"_t._{k}") for k in "wce")
    g, h, i = (F.col(f"_s._{k}") for k in "wce")
    gx = ((c + 2.0 * f + i) - (a + 2.0 * d + g)) / (8.0 * dx_m)
    gy = ((g + 2.0 * h + i) - (a + 2.0 * b + c)) / (8.0 * dy_m)
    slope = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy)))
    return n.select("row", "col", F.when(e.isNotNull(), slope).alias("slope_deg"))


def central_slope(pixels: DataFrame, spacing_m: float = 30.0, value="z", block: int = BLOCK) -> DataFrame:
    """Slope from central differences, one-sided at the edges; NULL where a used pixel is missing. Runs a job."""
    b = _extent(pixels)
    z = F.col(value)
    dealt, along, down = _block_windows(pixels, value, block)

    def gradient(axis: str, w: Window, lo: int, hi: int) -> Column:
        before = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(value).over(w))
        after = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(value).over(w))
        return (
            F.when(F.col(axis) == lo, (after - z) / spacing_m)
            .when(F.col(axis) == hi, (z - before) / spacing_m)
            .otherwise((after - before) / (2.0 * spacing_m))
        )

    graded = dealt.withColumn("_gx", gradient("col", along, b[2], b[3])).withColumn("_gy", gradient("row", down, b[0], b[1]))
    slope = F.degrees(F.atan(F.sqrt(F.col("_gx") ** 2 + F.col("_gy") ** 2)))
    return graded.filter("_own").select("row", "col", F.when(z.isNotNull(), slope).alias("slope_deg"))


def sample_points(points: DataFrame, pixels: DataFrame, grid: Affine, cols: Sequence[str], lon="lon", lat="lat") -> DataFrame:
    """Band values under each point; outside or nodata gives NULL."""
    keyed = points.withColumns(grid.index(F.col(lon), F.col(lat)))
    return keyed.join(pixels.select("row", "col", *cols), ["row", "col"], "left")


def _asked_pixels(source: DataFrame, frm: Affine, to: Affine, reach: tuple[float, float], block: int) -> DataFrame:
    """The source pixels some target pixel may ask for, once for each target block that may.

    A pixel is asked for by the target centres between its place + reach[0] and + reach[1], in source pixels.
    """
    # rows run down from the top edge: counted like columns on a turned axis
    axes = {"y": ("row", -frm.top, frm.dy, -to.top, to.dy), "x": ("col", frm.left, frm.dx, to.left, to.dx)}
    out, ends = source, {}
    for axis, (name, edge, step, to_edge, to_step) in axes.items():
        # a little wide: the exact neighbour is looked up in the block
        shift = (edge - to_edge) / to_step - 0.5
        lo = F.ceil(F.col(name) * (step / to_step) + (reach[0] * step / to_step + shift - 1e-3))
        hi = F.floor(F.col(name) * (step / to_step) + (reach[1] * step / to_step + shift + 1e-3))
        out = out.filter((lo <= hi) & F.col(name).isNotNull())
        ends |= {f"_{axis}": F.floor(lo / block), f"_{axis}n": F.floor(hi / block) - F.floor(lo / block) + 1}
    out = out.withColumns(ends)
    # never empty, and the outer form leaves out the filters Spark would derive by repeating the sums above
    out = out.withColumn("_i", F.explode_outer(F.sequence(F.lit(0).cast("bigint"), F.col("_yn") * F.col("_xn") - 1)))
    return out.withColumns({"_y": F.col("_y") + F.floor(F.col("_i") / F.col("_xn")), "_x": F.col("_x") + F.col("_i") % F.col("_xn")}).drop("_yn", "_xn", "_i")


class _Pixels:
    """Distinct source pixels of a block by (row, col): `order` sorts the rows, `first` and `n` are a pixel's place in it."""

    def __init__(self, row: np.ndarray, col: np.ndarray):
        self.top, self.left, self.bottom, self.right = (int(x) for x in (row.min(), col.min(), row.max(), col.max())) if len(row) else (0, 0, -1, -1)
        key = self._key(row, col)
        self.order = np.argsort(key, kind="stable")
        self.key, self.first, self.n = np.unique(key[self.order], return_index=True, return_counts=True)

    def _key(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        return (row.astype(np.int64) - self.top) * (self.right - self.left + 1) + col - self.left

    def find(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the (row, col) that have a pixel, and that pixel's index."""
        there = np.flatnonzero((row >= self.top) & (row <= self.bottom) & (col >= self.left) & (col <= self.right))
        key = self._key(row[there], col[there])
        at = np.searchsorted(self.key, key)
        hit = np.append(self.key, -1)[at] == key
        return there[hit], at[hit]


def _bilinear(lon: np.ndarray, lat: np.ndarray, row: np.ndarray, col: np.ndarray, value: np.ndarray, frm: Affine) -> tuple[np.ndarray, np.ndarray]:
    """Weighted mean of the known ones of the four neighbours, and whether there is any."""
    fx, fy = (lon - frm.left) / frm.dx - 0.5, (frm.top - lat) / frm.dy - 0.5
    x0, y0 = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    ax, ay = fx - x0, fy - y0
    pixels = _Pixels(row, col)
    # a repeated pixel counts as often as it is there
    total = np.add.reduceat(value[pixels.order], pixels.first) if len(value) else value
    top, weight = np.zeros(len(lon)), np.zeros(len(lon))
    for dy, dx, w in ((0, 0, (1 - ax) * (1 - ay)), (0, 1, ax * (1 - ay)), (1, 0, (1 - ax) * ay), (1, 1, ax * ay)):
        there, at = pixels.find(y0 + dy, x0 + dx)
        pull = w[there] > 0
        there, at = there[pull], at[pull]
        top[there] += w[there] * total[at]
        weight[there] += w[there] * pixels.n[at]
    known = weight > 0
    return np.divide(top, weight, out=np.zeros(len(lon)), where=known), known


def _nearest(lon: np.ndarray, lat: np.ndarray, row: np.ndarray, col: np.ndarray, frm: Affine) -> tuple[np.ndarray, np.ndarray]:
    """(target, source) index pairs of the pixel that holds each centre, source -1 where there is none."""
    r, c = np.floor((frm.top - lat) / frm.dy).astype(np.int64), np.floor((lon - frm.left) / frm.dx).astype(np.int64)
    pixels = _Pixels(row, col)
    there, pixel = pixels.find(r, c)
    n, first = np.ones(len(lon), np.int64), np.full(len(lon), len(row))
    n[there], first[there] = pixels.n[pixel], pixels.first[pixel]
    target = np.repeat(np.arange(len(lon)), n)
    within = np.arange(len(target)) - np.repeat(np.cumsum(n) - n, n)
    return target, np.append(pixels.order, -1)[first[target] + within]


def _resample(target: DataFrame, to: Affine, bands: Sequence[tuple[DataFrame, Affine, str]], cover: tuple[DataFrame, Affine, str] | None, block: int) -> DataFrame:
    """Distinct target pixels with the bilinear values of `bands` and the nearest one of `cover`, and `_n`, their copies in `target`.

    Target pixels are dealt in blocks and every source pixel goes to the blocks that ask for it, so
    all bands take one exchange in which a pixel travels about once, not once for each of its neighbours.
    """
    smooth, sharp = [band[1:] for band in bands], cover and cover[1:]
    kind = cover[0].schema[cover[2]].dataType if cover else T.StringType()
    sent = []
    for k, (source, frm, name) in enumerate(bands):
        known = source.filter(F.col(name).isNotNull()).select("row", "col", F.col(name).cast("double").alias("_v"), F.lit(None).cast(kind).alias("_c"))
        sent.append(_asked_pixels(known, frm, to, (-0.5, 1.5), block).withColumn("_k", F.lit(k)))
    if cover:
        source, frm, name = cover
        held = source.select("row", "col", F.lit(None).cast("double").alias("_v"), F.col(name).alias("_c"))
        sent.append(_asked_pixels(held, frm, to, (0.0, 1.0), block).withColumn("_k", F.lit(len(bands))))
    side = lambda n: F.floor(F.col(n) / block)
    wanted = target.filter("row IS NOT NULL AND col IS NOT NULL").select("row", "col", side("row").alias("_y"), side("col").alias("_x"))

    def run(asking: pa.Table, held: pa.Table) -> pa.Table:
        row, col = (asking.column(n).to_numpy().astype(np.int64) for n in ("row", "col"))
        # each distinct pixel once, with its copies
        order = np.lexsort((col, row))
        row, col = row[order], col[order]
        first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (col[1:] != col[:-1])))) if len(row) else np.empty(0, np.int64)
        n = np.diff(np.append(first, len(row)))
        row, col = row[first], col[first]
        lon, lat = to.left + (col + 0.5) * to.dx, to.top - (row + 0.5) * to.dy
        which = held.column("_k").to_numpy()
        out = {"row": pa.array(row), "col": pa.array(col), "_n": pa.array(n)}
        for k, (frm, name) in enumerate(smooth):
            part = held.filter(pa.array(which == k))
            value, known = _bilinear(lon, lat, *(part.column(c).to_numpy() for c in ("row", "col", "_v")), frm)
            out[name] = pa.array(value, mask=~known)
        if sharp:
            part = held.filter(pa.array(which == len(smooth)))
            at, of = _nearest(lon, lat, *(part.column(c).to_numpy() for c in ("row", "col")), sharp[0])
            out = {c: a.take(pa.array(at)) for c, a in out.items()}
            out[sharp[1]] = part.column("_c").take(pa.array(of, mask=of < 0))
        return pa.table(out)

    schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("row", "col", "_n")]
        + [T.StructField(name, T.DoubleType()) for _, name in smooth]
        + ([T.StructField(sharp[1], kind)] if sharp else [])
    )
    pixels = reduce(DataFrame.unionByName, sent)
    out = wanted.groupBy("_y", "_x").cogroup(pixels.groupBy("_y", "_x")).applyInArrow(run, schema)
    return out.withColumns({n: F.col(n).cast(wanted.schema[n].dataType) for n in ("row", "col")})


def _copies(df: DataFrame, power: int) -> DataFrame:
    """Each row `_n` to the `power` times: rows of a repeated key meet one another in a join."""
    times = reduce(lambda a, b: a * b, [F.col("_n")] * power)
    return df.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), times))).drop("_n")


def resample_bilinear(target: DataFrame, to: Affine, source: DataFrame, frm: Affine, value: str, block: int = 2 * BLOCK) -> DataFrame:
    """Bilinear value of `source` at each target pixel centre.

    The weights of missing neighbours are left out and the rest rescaled.
    """
    out = _copies(_resample(target, to, [(source, frm, value)], None, block), 1)
    return out.unionByName(target.filter("row IS NULL OR col IS NULL").select("row", "col"), allowMissingColumns=True)


def resample_nearest(target: DataFrame, to: Affine, source: DataFrame, frm: Affine, value: str, block: int = 2 * BLOCK) -> DataFrame:
    """Value of the source pixel that holds the target pixel centre."""
    out = _copies(_resample(target, to, [], (source, frm, value), block), 1)
    return out.unionByName(target.filter("row IS NULL OR col IS NULL").select("row", "col"), allowMissingColumns=True)


def stack_bands(
    target: DataFrame, to: Affine, elevation: DataFrame, slope: DataFrame, frm: Affine, cover: DataFrame, cover_grid: Affine, block: int = 2 * BLOCK
) -> DataFrame:
    """Elevation and slope (bilinear) and land cover (nearest) on one grid, the bands joined by (row, col)."""
    bands = [(elevation, frm, "elevation_m"), (slope, frm, "slope_deg")]
    return _copies(_resample(target, to, bands, (cover, cover_grid, "cls"), block), 3)


def mosaic(tiles: DataFrame, value="z", order="tile") -> DataFrame:
    """The lowest tile number with a value wins on overlaps."""
    known = F.when(F.col(value).isNotNull(), F.col(order))
    return tiles.groupBy("row", "col").agg(F.min_by(value, known).alias(value))


def stride_sample(pixels: DataFrame, stride: int = 8, value="z") -> DataFrame:
    """Every stride-th row and column that holds a value."""
    return pixels.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0) & F.col(value).isNotNull())


def every_kth(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Rows 0, k, 2k, ... of the total order. Runs a job."""
    from pluvia.operators.rank import global_position

    return global_position(df, list(order), "_p").filter(F.col("_p") % k == 0).drop("_p")


def land_cover_attributes(df: DataFrame, cls="cls") -> DataFrame:
    """Class name and built-up percent of a code; unmapped codes read as suburban, NULL stays NULL."""
    name, built = F.lit(fv.LAND_COVER_UNMAPPED[0]), F.lit(fv.LAND_COVER_UNMAPPED[1])
    code = F.col(cls)
    name_expr = F.when(code.isNull(), F.lit(None).cast("string"))
    built_expr = F.when(code.isNull(), F.lit(None).cast("double"))
    for c, label, pct in fv.LAND_COVER:
        name_expr, built_expr = name_expr.when(code == c, F.lit(label)), built_expr.when(code == c, F.lit(pct))
    return df.withColumns({"land_cover": name_expr.otherwise(name), "built_up_percentage": built_expr.otherwise(built)})


def with_zone_fallback(sampled: DataFrame, fallback: DataFrame, cols: Sequence[str], key: str = "zone") -> DataFrame:
    """Any missing sample replaces the whole row's values by the zone's stored ones."""
    fb = fallback.select(key, *[F.col(c).alias(f"_f_{c}") for c in cols])
    complete = F.lit(True)
    for c in cols:
        complete = complete & F.col(c).isNotNull()
    joined = sampled.join(fb, key, "left").withColumn("_ok", complete)
    picked = {c: F.when(F.col("_ok"), F.col(c)).otherwise(F.col(f"_f_{c}")) for c in cols}
    return joined.withColumns(picked).drop("_ok", *[f"_f_{c}" for c in cols])


def proxy_label(samples: DataFrame, minimum: int = fv.MIN_PROXY_SAMPLES) -> DataFrame:
    """P20: near a drain and below the 35 % elevation quantile. Refuses small tables. Runs jobs."""
    from pluvia.operators.rank import exact_quantiles

    q = exact_quantiles(samples, ["elevation_m"], [fv.LABEL_ELEVATION_QUANTILE])
    n, cut = q.select("n", "value").first() or (0, None)  # two numbers
    if n < minimum:
        raise ValueError(f"only {n} valid samples, {minimum} needed")
    hit = (F.col("dist_to_drainage_m") <= fv.LABEL_DISTANCE_M) & (F.col("elevation_m") < F.lit(cut))
    return samples.withColumn("hydrologic_vulnerability_proxy", F.coalesce(hit.cast("int"), F.lit(0)))
