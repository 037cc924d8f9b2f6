"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Every document becomes a vector of transformed statistics. Per language and source the mean and
covariance of the h-subset with the least determinant are estimated by concentration steps from
two deterministic starts (scaled medians; spatial signs), reweighted once, and a document is
rejected when its squared Mahalanobis distance passes the cutoff. All of it is DataFrame code.

Statistics are fixed-point integers, so sums of them are exact in any order and an estimate does
not depend on how the rows are dealt. Orders inside a group go through counts of binned values:
a group of any size takes part with partial sums and is never gathered in one task.

Defined results: a NULL text has no words; NULL languages or sources count as ''. Groups with
fewer than `min_rows` usable rows share one pooled estimate; if the pool has none either, only
the base rules decide. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import SPACE_CHARS, boxed, let, stored, unboxed, words

#: Names and tolerances (added to the standard deviation) of the transformed statistics.
FEATURES = {"log_words": 0.5, "log_word_length": 0.12, "symbol_share": 0.06, "dup_line_share": 0.2, "repeat_share": 0.2}
P = len(FEATURES)
SCALE = 1000
#: Quantiles of chi-squared with 5 degrees of freedom at 0.5, 0.975 and 1 - 1e-6.
CHI2_MEDIAN, CHI2_975, CHI2_FAR = 4.3515, 12.8325, 35.9
#: The cutoff, near the quantile at 1 - 1e-3: chosen on labelled documents of sf0.1, where it parts good from bad (README).
CUTOFF = 20.5
#: Copies of each group's estimate, so that a group with most of the rows joins in as many tasks.
SALTS = 32
SYMBOLS = "#*$%&|<>"


def _repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice in the text."""

    def covered(grams: Column) -> Column:
        order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            hit = F.transform(s, lambda e, i: F.when((e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"]), e["i"]))
            return F.sort_array(F.filter(hit, lambda x: x.isNotNull()))

        total = F.aggregate(
            let(order, twice),
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
            lambda acc, x: F.struct(x.alias("last"), (acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n")),
        )["n"]
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("bigint")).otherwise(total)

    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) >= 4, let(grams, covered)).otherwise(F.lit(0).cast("bigint"))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda s: F.length(F.translate(s, SPACE_CHARS, "")) > 0)
    return let(lines, lambda a: F.struct((F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("dup"), F.size(a).alias("all")))


def statistics(df: DataFrame, text: Column) -> DataFrame:
    """Adds a struct `stat` with the base counts, the base verdict and the feature vector."""
    text = F.coalesce(text, F.lit(""))
    counts = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.translate(text, SPACE_CHARS, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            _repeat_words(w).alias("n_repeat_words"),
            _dup_lines(text).alias("lines"),
        ),
    )
    df = df.withColumn("c", counts)
    c = F.col("c")
    n, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    values = [
        F.log1p(c["n_words"].cast("double")),
        F.log(chars / n),
        F.sqrt(c["n_symbols"] / chars),
        F.sqrt(c["lines"]["dup"] / F.greatest(c["lines"]["all"], F.lit(1))),
        F.sqrt(c["n_repeat_words"] / n),
    ]
    failed = (c["n_words"] < 50) | (c["n_repeat_words"] * 100 > c["n_words"] * 50)
    return df.withColumn(
        "stat",
        F.struct(
            *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols")],
            c["lines"]["dup"].alias("n_dup_lines"),
            c["n_repeat_words"].alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.array(*[F.round(v * SCALE).cast("bigint") for v in values]).alias("x"),
        ),
    ).drop("c")


def _distance(x: Column, e: Column) -> Column:
    """Squared Mahalanobis distance of x by the centre m and the lower factor l of an estimate."""
    z: list[Column] = []
    for i in range(P):
        rest = x[i] / SCALE - e["m"][i]
        for j in range(i):
            rest = rest - e["l"][i * (i + 1) // 2 + j] * z[j]
        z.append(rest / e["l"][i * (i + 1) // 2 + i])
    total = z[0] * z[0]
    for v in z[1:]:
        total = total + v * v
    return total


def _bin(d2: Column) -> Column:
    """Distances in steps of a twentieth of a percent, so that their counts are few."""
    return F.floor(F.log1p(F.least(d2, F.lit(1e12))) * 200)


def _unbin(b: Column) -> Column:
    return F.exp((b + 1) / F.lit(200.0)) - 1


def _moment_sums(x: Column, use: Column, tag: str) -> list[Column]:
    one = [F.sum(F.when(use, 1).otherwise(0)).alias(f"{tag}n")]
    first = [F.sum(F.when(use, x[i])).alias(f"{tag}s{i}") for i in range(P)]
    second = [F.sum(F.when(use, x[i] * x[j])).alias(f"{tag}q{i}_{j}") for i in range(P) for j in range(i + 1)]
    return one + first + second


def _factor(df: DataFrame, **made: tuple[str, float]) -> DataFrame:
    """Estimate structs (centre m, Cholesky factor l, log determinant) from moment sums: name = (tag of the sums, scale).

    One step per column of the factors, all of them together: few steps keep the plan's analysis short.
    """
    tolerance = list(FEATURES.values())
    mean = lambda tag, i: f"(coalesce({tag}s{i}, 0) / greatest({tag}n, 1) / {SCALE})"

    def rest(tag: str, scale: float, i: int, j: int) -> str:
        cov = f"(coalesce({tag}q{i}_{j}, 0) / greatest({tag}n, 1) / {SCALE} / {SCALE} - {mean(tag, i)} * {mean(tag, j)}) * {scale!r}D"
        cov += f" + {tolerance[i] ** 2!r}D" if i == j else ""
        return cov + "".join(f" - _{tag}{i}_{k} * _{tag}{j}_{k}" for k in range(j))

    for j in range(P):
        df = df.withColumns({f"_{tag}{j}_{j}": F.expr(f"sqrt(greatest({rest(tag, scale, j, j)}, 1e-9D))") for tag, scale in made.values()})
        if j + 1 < P:
            below = [(tag, scale, i) for tag, scale in made.values() for i in range(j + 1, P)]
            df = df.withColumns({f"_{tag}{i}_{j}": F.expr(f"({rest(tag, scale, i, j)}) / _{tag}{j}_{j}") for tag, scale, i in below})
    out = []
    for name, (tag, _) in made.items():
        centre = ", ".join(mean(tag, i) for i in range(P))
        factor = ", ".join(f"_{tag}{i}_{j}" for i in range(P) for j in range(i + 1))
        det = " + ".join(f"ln(_{tag}{i}_{i})" for i in range(P))
        out.append(F.expr(f"named_struct('m', array({centre}), 'l', array({factor}), 'det', {det})").alias(name))
    return df.select("grp", *out)


def _groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """(lang, source) -> grp; small groups share the group ''."""
    n = rows.groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.concat(F.lit("g"), F.hex("lang"), F.lit("/"), F.hex("source"))
    return n.select("lang", "source", F.when(F.col("n") >= min_rows, own).otherwise("").alias("grp"))


def _with(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with the estimate of their group. Salted: the rows of a hot group go to many tasks."""
    return rows.join(estimates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["grp", "salt"])


def fit(stats: DataFrame, h_share: float = 0.75, steps: int = 3, min_rows: int = 100) -> DataFrame:
    """Estimates (lang, source, est) from rows (lang, source, salt, stat). One row per language and source."""
    usable = stats.where(~F.col("stat")["base_failed"]).select("lang", "source", "salt", F.col("stat")["x"].alias("x"))
    groups = stored(_groups(usable, min_rows), "quality-groups")
    rows = usable.join(groups, ["lang", "source"]).select("grp", "salt", "x")

    # start 1: medians and scaled absolute deviations; start 2: covariance of spatial signs
    med = rows.groupBy("grp").agg(F.array(*[F.expr(f"percentile(x[{i}], 0.5)") for i in range(P)]).alias("med"))
    off = _with(rows, med).withColumn("off", F.array(*[F.abs(F.col("x")[i] - F.col("med")[i]) for i in range(P)]))
    mad = off.groupBy("grp").agg(F.first("med").alias("med"), F.array(*[F.expr(f"percentile(off[{i}], 0.5)") for i in range(P)]).alias("mad"))
    mad = stored(mad, "quality-deviations")
    sd = [F.sqrt((F.col("mad")[i] * 1.4826 / SCALE) ** 2 + t**2) for i, t in enumerate(FEATURES.values())]
    zero = F.lit(0.0)
    diagonal = F.array(*[sd[i] if i == j else zero for i in range(P) for j in range(i + 1)])
    centre = F.array(*[F.col("med")[i] / SCALE for i in range(P)])
    plain = mad.select("grp", "mad", "med", F.struct(centre.alias("m"), diagonal.alias("l"), zero.alias("det")).alias("a"))
    signed = _with(rows, mad)
    z = [(F.col("x")[i] - F.col("med")[i]) / SCALE / sd[i] for i in range(P)]
    norm = F.sqrt(sum((v * v for v in z[1:]), z[0] * z[0]))
    unit = F.array(*[F.coalesce(F.round(F.try_divide(v, norm) * SCALE), F.lit(0)).cast("bigint") for v in z])
    signs = signed.select("grp", unit.alias("x")).groupBy("grp").agg(*_moment_sums(F.col("x"), F.lit(True), "b"))
    signs = _factor(signs, s=("b", float(P)))
    scaled = F.array(*[F.col("s")["l"][i * (i + 1) // 2 + j] * sd[i] for i in range(P) for j in range(i + 1)])
    est = plain.join(signs, "grp").select("grp", "a", F.struct(F.col("a")["m"].alias("m"), scaled.alias("l"), zero.alias("det")).alias("b"))
    est = stored(est, "quality-starts")

    for _ in range(steps):
        near = _with(rows, est).select("grp", "salt", "x", *[_bin(_distance(F.col("x"), F.col(s))).alias(f"d{s}") for s in "ab"])
        at = near.groupBy("grp").agg(*[F.ceil(F.expr(f"percentile(d{s}, {h_share})")).alias(f"t{s}") for s in "ab"])
        sums = _with(near, stored(at, "quality-halves")).groupBy("grp").agg(*[c for s in "ab" for c in _moment_sums(F.col("x"), F.col(f"d{s}") <= F.col(f"t{s}"), s)])
        est = stored(_factor(sums, a=("a", 1.0), b=("b", 1.0)), "quality-steps")

    # the start with the lesser determinant, made consistent by the median distance, reweighted once
    best = est.select("grp", F.when(F.col("a")["det"] <= F.col("b")["det"], F.col("a")).otherwise(F.col("b")).alias("a"))
    near = _with(rows, best).select("grp", "salt", "x", _bin(_distance(F.col("x"), F.col("a"))).alias("d"))
    at = near.groupBy("grp").agg((_unbin(F.expr("percentile(d, 0.5)")) * (CHI2_975 / CHI2_MEDIAN)).alias("t"))
    sums = _with(near, stored(at, "quality-reach")).groupBy("grp").agg(*_moment_sums(F.col("x"), _unbin(F.col("d")) <= F.col("t"), "r"))
    last = _factor(sums, est=("r", 1.0))
    # as a file its size is known, so that the join with texts broadcasts it only where it is small
    return stored(groups.join(last, "grp", "left").select("lang", "source", "est"), "quality-estimates")


def judged(stats: DataFrame, estimates: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Adds `d2` and `kept` to rows (lang, source, stat, ...)."""
    df = stats.join(estimates, ["lang", "source"], "left").withColumn("d2", _distance(F.col("stat")["x"], F.col("est")))
    # one comparison: a conjunction would be split and the base rules evaluated again below the join
    reach = F.coalesce(F.when(F.col("stat")["base_failed"], F.lit(float("inf"))).otherwise(F.col("d2")), F.lit(0.0))
    return df.withColumn("kept", reach <= cutoff).drop("est")


def _keys(row: Column) -> list[Column]:
    salt = F.pmod(F.xxhash64(row["doc_id"], row["text"]), F.lit(SALTS)).cast("int").alias("salt")
    return [*[F.coalesce(row[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], salt]


def quality_report(docs: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """One row per document: base counts, base verdict, distance and final verdict."""
    rows = boxed(docs)
    narrow = statistics(rows, F.col("row")["text"]).select(F.col("row")["doc_id"].alias("doc_id"), *_keys(F.col("row")), "stat")
    narrow = stored(narrow, "quality-statistics")
    out = judged(narrow, fit(narrow, **options), cutoff)
    stat = F.col("stat")
    return out.select(
        "doc_id",
        *[stat[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        "kept",
        "d2",
    )


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, **options) -> DataFrame:
    """The documents that are kept, with their own columns. Statistics are counted once and stored beside
    the rows; the fit reads them alone, and texts are judged where they are read, not shuffled."""
    rows = boxed(docs)
    counted = stored(statistics(rows, F.col("row")["text"]).select("row", *_keys(F.col("row")), "stat"), "quality-rows")
    estimates = fit(counted.select("lang", "source", "salt", "stat"), **options)
    return unboxed(judged(counted, estimates, cutoff).where("kept"), docs.columns)


def tail(d2: float) -> float:
    """Upper tail of chi-squared with 5 degrees of freedom, to check the quantiles above."""
    x = math.sqrt(d2)
    return math.erfc(x / math.sqrt(2)) + math.sqrt(2 / math.pi) * math.exp(-d2 / 2) * (x + x**3 / 3)
