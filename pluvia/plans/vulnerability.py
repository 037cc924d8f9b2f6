"""Transparent zone index (P13, P14, F07), heat exposure (P15) and model zone scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia import fixed_values as fv
from pluvia.functions.classify import band, total
from pluvia.functions.numeric import decimal_round, fixed_text, round_to


def _with_ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Attach min and max of each column over all zones as one scalar subquery."""
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    return df.withColumn("_range", df.agg(F.struct(*aggs)).scalar())


def _minmax(c: str) -> Column:
    lo, hi = F.col(f"_range.lo_{c}"), F.col(f"_range.hi_{c}")
    scaled = (F.col(c) - lo) / (hi - lo) * 100.0
    fail = F.raise_error(F.lit(f"factor {c} is constant across zones"))
    return F.when(hi == lo, fail.cast("double")).otherwise(scaled)


def normalized_factors(features: DataFrame, factors=fv.VULNERABILITY_FACTORS, key: str = "zone") -> DataFrame:
    """norm_<factor> in 0..100, turned so that higher is always worse, 2 digits."""
    ranged = _with_ranges(features, [f[1] for f in factors])
    norms = []
    for name, source, higher_is_worse, _, _ in factors:
        v = _minmax(source)
        norms.append(round_to(v if higher_is_worse else F.lit(100.0) - v, 2).alias(f"norm_{name}"))
    return ranged.select(key, *norms)


def vulnerability_index(features: DataFrame, factors=fv.VULNERABILITY_FACTORS, key: str = "zone") -> DataFrame:
    """Weighted score, level, contributions and the ordered explanation per zone."""
    if abs(sum(f[3] for f in factors) - 1.0) > 1e-9:
        raise ValueError("weights must sum to 1")
    norms = normalized_factors(features, factors, key)
    score = round_to(total([F.col(f"norm_{f[0]}") * f[3] for f in factors]), 2)
    out = norms.withColumn("vulnerability_score", score).withColumns(
        {f"contrib_{f[0]}": round_to(F.col(f"norm_{f[0]}") * f[3], 2) for f in factors}
    )
    out = out.withColumn("vulnerability_level", band(F.col("vulnerability_score"), fv.VULNERABILITY_BANDS))
    return out.withColumns(contributors(factors))


def contributors(factors=fv.VULNERABILITY_FACTORS) -> dict[str, Column]:
    """Phrases by contribution, highest first (file order on ties); small ones carry '(minor)'."""
    items = F.array(
        *[
            F.struct((-F.col(f"contrib_{f[0]}")).alias("s"), F.lit(i).alias("i"), F.lit(f[4]).alias("noun"))
            for i, f in enumerate(factors)
        ]
    )

    def phrase(x):
        base = F.concat(x["noun"], F.lit(" (+"), fixed_text(-x["s"], 1), F.lit(" pts)"))
        return F.when(-x["s"] < fv.MINOR_POINTS, F.concat(F.lit("(minor) "), base)).otherwise(base)

    phrases = F.transform(F.array_sort(items), phrase)
    major = F.filter(phrases, lambda p: ~p.startswith("(minor)"))
    return {"explanation": phrases, "top_contributors": F.array_join(F.slice(major, 1, 4), "; ")}


def contributions_long(index: DataFrame, factors=fv.VULNERABILITY_FACTORS, key: str = "zone") -> DataFrame:
    """One row per zone and factor."""
    return index.unpivot(key, [f"contrib_{f[0]}" for f in factors], "factor", "points").withColumn(
        "factor", F.regexp_replace("factor", "^contrib_", "")
    )


def heat_table(features: DataFrame, key: str = "zone") -> DataFrame:
    """Built-up raises, vegetation lowers the exposure."""
    ranged = _with_ranges(features.select(key, "built_up_pct", "vegetation_pct"), ["built_up_pct", "vegetation_pct"])
    w = fv.HEAT_WEIGHTS
    score = w["built_up"] * _minmax("built_up_pct") + w["vegetation"] * (F.lit(100.0) - _minmax("vegetation_pct"))
    inputs = F.to_json(
        F.struct(
            decimal_round(F.col("built_up_pct"), 2).alias("built_up_pct"),
            decimal_round(F.col("vegetation_pct"), 2).alias("vegetation_pct"),
        )
    )
    out = ranged.select(key, round_to(score, 2).alias("heat_score"), inputs.alias("heat_inputs"))
    return out.withColumn("heat_level", band(F.col("heat_score"), fv.HEAT_BANDS))


def model_zone_scores(samples: DataFrame, label: str, prob: str = "p", key: str = "zone") -> DataFrame:
    """Flagged share, mean probability, true share per zone; flagged share min-max scaled over zones."""
    agg = samples.groupBy(key).agg(
        round_to(F.avg((F.col(prob) >= 0.5).cast("double")) * 100.0, 3).alias("flagged_area_share_pct"),
        F.avg(prob).alias("mean_proba"),
        F.count(F.lit(1)).alias("n_samples"),
        round_to(F.avg(F.col(label).cast("double")) * 100.0, 3).alias("true_positive_share_pct"),
    )
    ranged = _with_ranges(agg, ["flagged_area_share_pct"])
    score = round_to(_minmax("flagged_area_share_pct"), 2)
    out = ranged.withColumn("vulnerability_score", score)
    out = out.withColumn("vulnerability_level", band(F.col("vulnerability_score"), fv.MODEL_ZONE_BANDS))
    return out.drop("_range")
