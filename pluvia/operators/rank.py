"""Ranks, percentiles and running totals over a whole table without a one-task window.

The building block is `running_totals`: range-partition and sort the rows, store that
order as files, add up each partition, and shift every partition by
the total of those before it. The only global window runs over one row per partition.
Ties and hot values are collapsed by a `groupBy(value)` first, so a value that fills a
third of the table is a single row here.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.functions.numeric import round_to
from pluvia.session import stored

_ROW_MASK = (1 << 33) - 1


def _fixed_order(df: DataFrame, order: Sequence) -> DataFrame:
    """Sorted rows with (_part, _row), materialised so both survive a lost executor. Runs jobs.

    Both steps are columnar files: places are stored with the rows, so no reader depends on how files are split.
    """
    # a range sort samples its input first: stored, so that what is above runs once
    marked = stored(df, "order-rows").orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = stored(marked, "order-sorted")
    return kept.withColumns(
        {"_part": F.shiftright("_id", 33).cast("int"), "_row": F.col("_id").bitwiseAND(_ROW_MASK)}
    ).drop("_id")


def _offsets(parts: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exclusive prefix over the partitions; as many rows as partitions, hence broadcast."""
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("_part", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_off_{c}") for c in cols])


def global_position(df: DataFrame, order: Sequence, name: str = "position") -> DataFrame:
    """0-based position of each row in the total order `order`, which must be unique. Runs a job."""
    rows = _fixed_order(df, order)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    shifted = rows.join(F.broadcast(_offsets(parts, ["n"])), "_part")
    return shifted.withColumn(name, F.col("_row") + F.col("_off_n")).drop("_part", "_row", "_off_n")


def running_totals(df: DataFrame, order: Sequence, sums: dict[str, str]) -> DataFrame:
    """Inclusive running sums {output: column} in the order `order`. Runs a job."""
    rows = _fixed_order(df, order)
    names = list(sums.values())
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(c) for c in names])
    local = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    shifted = rows.join(F.broadcast(_offsets(parts, names)), "_part")
    out = {name: F.sum(c).over(local) + F.col(f"_off_{c}") for name, c in sums.items()}
    return shifted.withColumns(out).drop("_part", "_row", *[f"_off_{c}" for c in names])


def percentile_rank(df: DataFrame, score: str, keys: Sequence[str], nulls_last: bool = True) -> DataFrame:
    """position/(n-1)*100 rounded to 2 digits, and its integer part; ties follow `keys`. Runs jobs."""
    first = F.col(score).asc_nulls_last() if nulls_last else F.col(score).asc()
    placed = global_position(df, [first, *keys], "_pos")
    n = placed.agg(F.count(F.lit(1))).scalar()
    pct = round_to(F.try_divide(F.lit(100.0) * F.col("_pos"), n - 1), 2)
    out = placed.withColumn("percentile_0_100", pct)
    return out.withColumn("percentile_int", F.col("percentile_0_100").cast("int")).drop("_pos")


def baseline_rank(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Percentile in ascending order and rank in descending order, NULLs last in both, ties by `keys`. Runs jobs.

    One stored order gives both: rows of one value stand together in it, so a row's place among them is the
    same in either direction, and what stands above it follows from the value's count and first position.
    """
    placed = global_position(df, [F.col(value).asc_nulls_last(), *keys], "_pos")
    per = placed.groupBy(F.col(value).alias("_v")).agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_c"))
    sizes = per.agg(F.struct(F.sum("_c").alias("n"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_c"))).alias("known"))).scalar()
    joined = placed.join(per, placed[value].eqNullSafe(per["_v"]), "left").withColumn("_all", sizes)
    pct = round_to(F.try_divide(F.lit(100.0) * F.col("_pos"), F.col("_all.n") - 1), 2)
    above = F.col("_all.known") - F.col("_first") - F.col("_c")
    down = F.when(F.col(value).isNull(), F.col("_pos")).otherwise(above + F.col("_pos") - F.col("_first")) + 1
    return joined.withColumns({"baseline_percentile": pct, "baseline_rank": down}).drop("_pos", "_v", "_first", "_c", "_all")


def value_ranks(df: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Average rank of every distinct non-null value of a column. Runs a job."""
    return _ranks_of_counts(df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_c")), col, descending)


def _ranks_of_counts(counts: DataFrame, col: str, descending: bool = False) -> DataFrame:
    """Average ranks from rows (value, _c)."""
    order = F.col(col).desc() if descending else F.col(col).asc()
    run = running_totals(counts, [order], {"_upto": "_c"})
    return run.select(F.col(col), (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(f"rank_{col}"))


def average_rank(df: DataFrame, score: str, name: str = "rank_global") -> DataFrame:
    """Descending average rank over the whole table, cut to an integer. Runs a job.

    The join goes back on the value; AQE splits a value that is hot on the big side.
    """
    ranks = value_ranks(df, score, descending=True)
    return (
        df.join(ranks, score, "left")
        .withColumn(name, F.floor(F.col(f"rank_{score}")).cast("bigint"))
        .drop(f"rank_{score}")
    )


def average_rank_in_zone(df: DataFrame, score: str, zone="zone", name: str = "rank_in_zone") -> DataFrame:
    """E12 per zone: a zone's series is bounded by the calendar."""
    w = Window.partitionBy(zone).orderBy(F.col(score).desc_nulls_last())
    ties = F.count(F.lit(1)).over(Window.partitionBy(zone, score))
    return df.withColumn(name, F.floor(F.rank().over(w) + (ties - 1) / 2.0).cast("bigint"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, spearman) over the rows where both values exist. Runs jobs."""
    both = df.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    # equal pairs are collapsed first, and stored: the input is evaluated once, ranks follow from the counts
    pairs = stored(both.groupBy(a, b).agg(F.count(F.lit(1)).alias("_w")), "spearman-pairs")
    ra, rb = (_ranks_of_counts(pairs.groupBy(c).agg(F.sum("_w").alias("_c")), c) for c in (a, b))
    ranked = pairs.withColumn("_w", F.col("_w").cast("double")).join(ra, a).join(rb, b)
    x, y, w = F.col(f"rank_{a}"), F.col(f"rank_{b}"), F.col("_w")
    m = ranked.agg(
        F.sum(w).alias("n"),
        F.sum(w * x).alias("sx"),
        F.sum(w * y).alias("sy"),
        F.sum(w * x * x).alias("sxx"),
        F.sum(w * y * y).alias("syy"),
        F.sum(w * x * y).alias("sxy"),
    )
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    var = F.sqrt(F.col("n") * F.col("sxx") - F.col("sx") ** 2) * F.sqrt(F.col("n") * F.col("syy") - F.col("sy") ** 2)
    return m.select(F.col("n").cast("bigint").alias("n"), F.try_divide(cov, var).alias("spearman"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Rows (column, prob, n, value): exact, linear interpolation, NULLs ignored. Runs jobs.

    All columns go through one pass in long form, as counts per distinct value.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in cols]))
    long = df.select(pair.alias("p")).select("p.column", "p.v").filter(F.col("v").isNotNull())
    return quantiles_of_counts(long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("_c")), probs)


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles from rows (column, v, _c). Runs jobs."""
    run = running_totals(counts, ["column", "v"], {"_upto": "_c"})
    totals = run.groupBy("column").agg(F.sum("_c").alias("n"), F.min(F.col("_upto") - F.col("_c")).alias("_start"))
    want = F.explode(F.array(*[F.lit(float(p)) for p in probs]))
    targets = totals.select("column", "n", "_start", want.alias("prob")).withColumn(
        "_h", (F.col("n") - 1) * F.col("prob")
    )
    placed = run.join(F.broadcast(targets), "column")  # columns x probs rows
    hi, lo = F.col("_upto") - F.col("_start"), F.col("_upto") - F.col("_start") - F.col("_c")
    picked = placed.groupBy("column", "prob", "n", "_h").agg(
        F.max(F.when((lo <= F.floor("_h")) & (F.floor("_h") < hi), F.col("v"))).alias("_a"),
        F.max(F.when((lo <= F.ceil("_h")) & (F.ceil("_h") < hi), F.col("v"))).alias("_b"),
    )
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))
    return picked.select("column", "prob", "n", value.alias("value"))


def _expanding_counts(v: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Per value, how many earlier ones are below it and how many are not above it.

    A block of values is looked up in the sorted earlier blocks; inside the block one small
    comparison matrix decides.
    """
    below, upto = np.zeros(len(v), dtype="int64"), np.zeros(len(v), dtype="int64")
    seen = v[:0]
    for start in range(0, len(v), block):
        part = v[start : start + block]
        earlier = np.tri(len(part), k=-1, dtype=bool)
        end = start + len(part)
        below[start:end] = np.searchsorted(seen, part, "left") + ((part[None, :] < part[:, None]) & earlier).sum(axis=1)
        upto[start:end] = np.searchsorted(seen, part, "right") + ((part[None, :] <= part[:, None]) & earlier).sum(axis=1)
        seen = np.sort(np.concatenate([seen, part]), kind="stable")
    return below, upto


def expanding_percentile(df: DataFrame, value: str, zone="zone", date="date", out="temporal_intensity") -> DataFrame:
    """Average-rank percentile of the value among the zone's values up to that day; NULL counts as 0.

    Spark has no frame-aware rank. One zone is one Arrow group, bounded by the calendar; the
    other columns pass through untouched, so nothing is joined back, and rows that are
    already partitioned by zone are not shuffled again.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def per_zone(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(date, "ascending")]))
        below, upto = _expanding_counts(pc.fill_null(table[value], 0.0).to_numpy())
        pct = (below + upto + 2) / 2.0 / np.arange(1, len(below) + 1) * 100.0
        return table.append_column(out, pa.array(pct, pa.float64()))

    return df.groupBy(zone).applyInArrow(per_zone, schema).withColumn(out, round_to(F.col(out), 2))


def gini(df: DataFrame, value="rain_mm", zone="zone") -> DataFrame:
    """Gini of the positive values per zone from value counts; 0 when nothing is positive.

    A tied value of multiplicity c at ranks r+1..r+c adds c*r + c(c+1)/2 to the rank sum.
    """
    counts = df.groupBy(zone, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_p", F.when(F.col(value) > 0, F.col("_c")).otherwise(0))
    w = Window.partitionBy(zone).orderBy(F.col(value).asc_nulls_first())
    before = F.coalesce(F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("_r", before)
    rank_sum = F.col("_p") * F.col("_r") + F.col("_p") * (F.col("_p") + 1) / 2.0
    agg = ranked.groupBy(zone).agg(
        F.sum(F.when(F.col("_p") > 0, rank_sum * F.col(value))).alias("_ix"),
        F.sum(F.when(F.col("_p") > 0, F.col("_p") * F.col(value))).alias("_x"),
        F.sum("_p").alias("_n"),
    )
    g = 2.0 * F.col("_ix") / (F.col("_n") * F.col("_x")) - (F.col("_n") + 1) / F.col("_n")
    return agg.select(zone, F.when(F.coalesce(F.col("_x"), F.lit(0.0)) > 0, g).otherwise(0.0).alias("gini"))
