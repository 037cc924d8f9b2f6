"""Label gate and classification quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.operators.rank import running_totals


def label_gate(labels: DataFrame, gate=fv.LABEL_GATE) -> DataFrame:
    """One row with counts, passed and the reasons against it. Labels: (date, zone, label).

    Counts per (zone, year) come first, so a hot zone is combined before the shuffle.
    """
    cells = labels.filter(F.col("label") == 1).groupBy("zone", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"))
    zones = cells.groupBy("zone").agg(F.sum("n").alias("n"))
    z = zones.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("positives"), F.count(F.lit(1)).alias("zones"), F.max("n").alias("_top")
    )
    years = cells.agg(F.count_distinct("year")).scalar()
    row = z.withColumns({"years": years, "top_share": F.try_divide("_top", "positives")}).drop("_top")
    g = gate
    few = F.when(F.col("positives") < g["min_positives"], F.format_string(f"only %d positive rows (needs >= {g['min_positives']})", "positives"))
    narrow = F.when(F.col("zones") < g["min_zones"], F.format_string(f"positives in only %d zones (needs >= {g['min_zones']})", "zones"))
    short = F.when(F.col("years") < g["min_years"], F.format_string(f"positives in only %d years (needs >= {g['min_years']})", "years"))
    lone = F.when(
        F.col("top_share") > g["max_zone_share"],
        F.concat(F.lit("one zone holds "), F.rint(F.col("top_share") * 100).cast("int").cast("string"), F.lit(f"% of positives (allowed <= {int(g['max_zone_share'] * 100)}%)")),
    )
    row = row.withColumn("reasons", F.array_compact(F.array(few, narrow, short, lone)))
    return row.withColumn("passed", F.size("reasons") == 0)


def classification_metrics(df: DataFrame, label: str, flag: str) -> DataFrame:
    """One pass; a ratio with a zero denominator is 0."""
    y, p = F.col(label) == 1, F.col(flag) == 1
    counts = df.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    recall, specificity = ratio(tp, tp + fn), ratio(tn, tn + fp)
    return counts.select(
        "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        recall.alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        specificity.alias("specificity"),
        ((recall + specificity) / 2.0).alias("balanced_accuracy"),
    )


def ranking_metrics(df: DataFrame, label: str, prob: str) -> DataFrame:
    """ROC-AUC by rank sum (ties count half) and average precision over distinct scores. Runs a job."""
    per = df.groupBy(prob).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    run = running_totals(per, [F.desc(prob)], {"_tp": "pos", "_fp": "neg"})
    beaten = F.col("_fp") - F.col("neg") + F.col("neg") / 2.0  # negatives above, half of the ties
    agg = run.agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
        F.sum(F.col("pos") * beaten).alias("lost"),
        F.sum(F.col("pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("ap"),
    )
    return agg.select(
        (1.0 - F.try_divide("lost", F.col("p") * F.col("n"))).alias("roc_auc"),
        F.try_divide("ap", "p").alias("average_precision"),
    )


def zone_share_rank(df: DataFrame, zone: str = "zone", k: int = 3) -> DataFrame:
    """The k factors with the largest mean |attribution| per zone (a handful of factors each)."""
    w = Window.partitionBy(zone).orderBy(F.desc("mean_abs"), "factor")
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
