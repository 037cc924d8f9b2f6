"""Boosted-tree classifier as MLlib grows it: fit, prediction, exact tree attribution."""

from __future__ import annotations

import functools
import itertools
import math
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import TaskContext, inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.session import scratch_path, stored

#: Cells of an ensemble whose attributions a task keeps.
_MOST_CELLS = 1 << 18
#: Bins of a feature at most (MLlib's number), cells times classes that a fit counts at most, rows that are counted together.
_BINS, _MOST_BINNED, _TALLIED = 32, 1 << 16, 1 << 17


@dataclass
class CellTrees:
    """Boosted trees that were fitted on counts of cells; a cell is a bin in every feature, bins lie between `thresholds`."""

    thresholds: list[np.ndarray]
    #: A tree is {node: (feature or -1, threshold, prediction, sampled rows)}; node i has the children 2 * i and 2 * i + 1.
    trees: list[dict[int, tuple[int, float, float, int]]]
    weights: list[float]

    @property
    def sizes(self) -> list[int]:
        return [len(t) + 1 for t in self.thresholds]

    def cells(self, x: Sequence[np.ndarray]) -> np.ndarray:
        """The numbers of the rows' cells. A value that is unknown fails the job, as it does when vectors are assembled."""
        number = np.zeros(len(x[0]) if len(x) else 0, dtype="int64")
        for values, cuts in zip(x, self.thresholds):
            if np.isnan(values).any():
                raise ValueError("a feature has unknown values")
            number = number * (len(cuts) + 1) + np.searchsorted(cuts, values, side="left")
        return number

    def inner(self) -> np.ndarray:
        """A value of every cell and feature, in the order of their numbers."""
        values = [np.append(t, math.inf) for t in self.thresholds]  # a threshold is the last value of its bin
        return np.stack([g.reshape(-1) for g in np.meshgrid(*values, indexing="ij")], axis=1)

    def margins(self) -> np.ndarray:
        """The weighed sum of the trees in every cell."""
        x, total = self.inner(), 0.0
        for tree, weight in zip(self.trees, self.weights):
            total = total + weight * _descend(tree, x)
        return total


def fit_boosted_trees(
    df: DataFrame, cols: Sequence[str], label: str, rounds: int = 200, depth: int = 4, rate: float = 0.1,
    row_share: float = 0.9, col_share: float = 0.9, seed: int = 42,
) -> CellTrees | GBTClassificationModel:
    """Positives weigh negatives/positives. Runs jobs.

    Trees tell rows apart by the bins of their features only, 32 of a feature at most. So rows are counted by
    cell and class in one pass, together with the draws of every round, and the rounds go over the cells on the
    driver: the trees are those that MLlib grows from the same bins and draws, whose rounds read all rows for each
    level of each tree. Where the cells are too many or nodes choose among drawn features, MLlib fits.
    """
    x = [F.col(c).cast("double") for c in cols]
    numbers = all(isinstance(df.schema[c].dataType, T.NumericType) for c in cols)
    unknown = functools.reduce(Column.__or__, [v.isNull() | F.isnan(v) for v in x]) if numbers else F.lit(True)
    n = df.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"),
        F.count(F.lit(1)).alias("all"), F.count_if(unknown).alias("unknown"),
    ).first()
    weight = n["neg"] / max(n["pos"], 1)
    weights = F.when(F.col(label) == 1, weight).otherwise(1.0)
    whole = math.ceil(col_share * len(cols)) >= len(cols) and n["pos"] + n["neg"] == n["all"] > 0 and not n["unknown"]
    thresholds = whole and _thresholds(df.select(*[v.alias(f"x{i}") for i, v in enumerate(x)], weights.alias("w")), n["all"], n["neg"] + n["pos"] * weight, seed)
    if thresholds and 2 * math.prod(len(t) + 1 for t in thresholds) <= _MOST_BINNED:
        model = CellTrees(thresholds, [], [1.0, *[rate] * (rounds - 1)][:rounds])
        _boost(model, *_counted(df, model, cols, label, rounds, row_share, seed), weight, depth)
        return model
    rows = _assembled(df, cols).select("features", F.col(label).cast("double").alias("label"), weights.alias("w"))
    gbt = GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=row_share,
        featureSubsetStrategy=str(col_share), weightCol="w", seed=seed, cacheNodeIds=False,
    )
    return gbt.fit(rows)


def _thresholds(rows: DataFrame, n: int, weight: float, seed: int) -> list[np.ndarray]:
    """Where MLlib cuts the features x0, x1, ...: at weighed quantiles of some 10,000 rows, halfway between two values."""
    spark = rows.sparkSession
    share = max(_BINS**2, 10_000) / n
    total = weight * min(share, 1.0)
    if share < 1:
        draw = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        rows = DataFrame(spark._jsparkSession.createDataFrame(rows._jdf.toJavaRDD().sample(False, share, draw), rows._jdf.schema()), spark)
    sample = rows.toPandas()
    out = []
    for c in sample.columns[:-1]:
        found = sample[sample[c] != 0.0].groupby(c)["w"].sum()
        if not len(found):
            out.append(np.empty(0))
            continue
        zeros = total - found.sum()
        if zeros > np.finfo(float).eps * min(n, max(_BINS**2, 10_000)) * 100:
            found = pd.concat([found, pd.Series({0.0: zeros})]).sort_index()
        values, counts = found.index.to_numpy(dtype="float64"), found.to_numpy()
        cuts, most = (values[:-1] + values[1:]) / 2.0, min(_BINS, n) - 1
        if len(cuts) > most:
            stride, taken, target, current = total / (most + 1), [], total / (most + 1), counts[0]
            for i in range(1, len(values)):
                before, current = current, current + counts[i]
                if abs(before - target) < abs(current - target):
                    taken.append(i - 1)
                    target += stride
            cuts = cuts[taken]
        out.append(cuts)
    return out


class _Draws:
    """Which rows of a partition the rounds leave out: the numbers of Spark's XORShiftRandom, which MLlib draws with.

    Round m starts from seed + m + 1 + partition and takes two steps a row. A step is linear over bits, so a block
    of rows is cut into lanes whose starts follow from the one before by a power of the step, and lanes go side by side.
    """

    def __init__(self, rounds: int, share: float, seed: int, partition: int):
        self.state = np.array([self.start(seed + m + 1 + partition) for m in range(rounds)], dtype="uint64")
        self.limit = np.uint64(min(math.ceil(share * 2.0**53), 2**53))

    @staticmethod
    def start(seed: int) -> int:
        """XORShiftRandom.hashSeed: two rounds of MurmurHash3 over the bytes of the seed."""

        def murmur(h: int) -> int:
            turn = lambda v, n: (v << n | v >> 32 - n) & 0xFFFFFFFF
            for k in struct.unpack("<2I", struct.pack(">q", seed)):
                k = turn(k * 0xCC9E2D51 & 0xFFFFFFFF, 15) * 0x1B873593 & 0xFFFFFFFF
                h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & 0xFFFFFFFF
            h ^= 8
            h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
            h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
            return h ^ h >> 16

        low = murmur(0x3C074A61)
        return murmur(low) << 32 | low

    @staticmethod
    def step(state: np.ndarray, room: np.ndarray) -> None:
        for shift, by in ((np.left_shift, 21), (np.right_shift, 35), (np.left_shift, 4)):
            shift(state, np.uint64(by), out=room)
            state ^= room

    def ahead(self, state: np.ndarray, steps: int) -> np.ndarray:
        """States so many steps later, by squaring the step's matrix of bits."""

        def applied(columns: np.ndarray, v: np.ndarray) -> np.ndarray:
            out = np.zeros_like(v)
            for k in range(64):
                out ^= columns[k] * (v >> np.uint64(k) & np.uint64(1))
            return out

        power = np.uint64(1) << np.arange(64, dtype="uint64")
        self.step(power, np.empty_like(power))
        while steps:
            if steps & 1:
                state = applied(power, state)
            power, steps = applied(power, power), steps >> 1
        return state

    def left_out(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For the next n rows: their order, and per round whether it leaves out the rows in that order."""
        lanes = min(64, n)
        length = -(-n // lanes)
        starts = [self.state]
        while len(starts) < lanes:  # doubled: all lanes so far, as many lanes further
            far = self.ahead(np.concatenate(starts), 2 * length * len(starts))
            starts += np.split(far, len(starts))
        state = np.stack(starts[:lanes], axis=1)
        room, value = np.empty_like(state), np.empty_like(state)
        out = np.empty((len(self.state), length, lanes), dtype=bool)
        for i in range(length):
            self.step(state, room)
            np.bitwise_and(state, np.uint64((1 << 26) - 1), out=value)
            value <<= np.uint64(27)
            self.step(state, room)
            np.bitwise_and(state, np.uint64((1 << 27) - 1), out=room)
            value += room
            np.greater_equal(value, self.limit, out=out[:, i])
        self.state = state[:, -1].copy()  # past the rows if the last lane is not full: then these were the last ones
        order = np.arange(length * lanes).reshape(lanes, length).T.reshape(-1)
        inside = order < n
        return order[inside], out.reshape(len(out), -1) if inside.all() else out.reshape(len(out), -1)[:, inside]


def _counted(df: DataFrame, model: CellTrees, cols: Sequence[str], label: str, rounds: int, share: float, seed: int):
    """Per cell and class: number of the cell, class, rows that each round drew."""
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col(label).cast("int").alias("y"))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.BinaryType())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}
        counts = np.zeros((0, rounds), dtype="int64")
        draws = _Draws(rounds, share, seed, TaskContext.get().partitionId())
        for part in _in_blocks(batches):
            x = [part.column(f"x{i}").to_numpy() for i in range(len(cols))]
            cells, of_row, n = np.unique(shared.value.cells(x) * 2 + part.column("y").to_numpy(), return_inverse=True, return_counts=True)
            order, left = draws.left_out(len(of_row))
            of_row = of_row[order]
            new = [c for c in cells.tolist() if c not in known]
            known.update({c: len(known) + i for i, c in enumerate(new)})
            counts = np.concatenate([counts, np.zeros((len(new), rounds), dtype="int64")])
            out = np.stack([np.bincount(of_row[np.flatnonzero(left[m])], minlength=len(cells)) for m in range(rounds)], axis=1)
            counts[[known[c] for c in cells.tolist()]] += n[:, None] - out
        yield from _packed(list(known), counts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, n in zip(batch.column("cell").to_pylist(), batch.column("n").to_pylist()):
                part = np.frombuffer(n, dtype="int64")
                known[cell] = known[cell] + part if cell in known else part
        yield from _packed(list(known), np.array(list(known.values()), dtype="int64").reshape(-1, rounds))

    found = rows.mapInArrow(tally, schema).repartition("cell").mapInArrow(merge, schema).toPandas().sort_values("cell")
    cell = found["cell"].to_numpy()
    drawn = np.frombuffer(b"".join(found["n"]), dtype="int64").reshape(len(found), rounds)
    return cell // 2, cell % 2, drawn


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, so many together; fewer only at the end."""
    waiting = None
    for batch in batches:
        part = pa.Table.from_batches([batch])
        waiting = part if waiting is None else pa.concat_tables([waiting, part])
        while waiting.num_rows >= _TALLIED:
            yield waiting.slice(0, _TALLIED)
            waiting = waiting.slice(_TALLIED)
    if waiting is not None and waiting.num_rows:
        yield waiting


def _packed(cells: list[int], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(cells), 4096):
        part = [row.tobytes() for row in counts[at : at + 4096]]
        yield pa.RecordBatch.from_arrays([pa.array(cells[at : at + 4096], pa.int32()), pa.array(part, pa.binary())], names=["cell", "n"])


def _boost(model: CellTrees, cell: np.ndarray, positive: np.ndarray, drawn: np.ndarray, weight: float, depth: int) -> None:
    """Grows the trees of the rounds, each on what the trees before it leave of the log loss."""
    bins = np.stack(np.unravel_index(cell, model.sizes), axis=1)
    x = model.inner()[cell]
    y, w = 2.0 * positive - 1.0, np.where(positive == 1, weight, 1.0)
    margin, target = np.zeros(len(cell)), y
    for m, rate in enumerate(model.weights):
        tree = _grown(model, bins, target, w, drawn[:, m], depth)
        margin = margin + rate * _descend(tree, x)
        with np.errstate(over="ignore"):
            target = 4.0 * y / (1.0 + np.exp(2.0 * y * margin))
        model.trees.append(tree)


def _variance(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def _grown(model: CellTrees, bins: np.ndarray, y: np.ndarray, w: np.ndarray, drawn: np.ndarray, depth: int) -> dict:
    """One regression tree by the gain in variance; of equal gains the first feature and threshold are taken."""
    weight = drawn * w
    stats = np.stack([weight, weight * y, weight * y * y, drawn])
    tree, node = {}, np.ones(len(y), dtype="int64")
    tree[1] = (-1, 0.0, _mean(stats.sum(axis=1)), int(drawn.sum()))
    grows = [1]
    for level in range(depth):
        at = {n: i for i, n in enumerate(grows)}
        place = np.full(2 << depth, -1)
        place[grows] = np.arange(len(grows))
        live = place[node]
        rows = np.flatnonzero((live >= 0) & (drawn > 0))
        best = [(-math.inf, None)] * len(grows)
        for f, size in enumerate(model.sizes):
            if size == 1:
                continue
            at_bin = live[rows] * size + bins[rows, f]
            sums = np.stack([np.bincount(at_bin, weights=v[rows], minlength=len(grows) * size).reshape(len(grows), size) for v in stats]).cumsum(axis=2)
            left, all_ = sums[:, :, :-1], sums[:, :, -1:]
            right = all_ - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = _variance(*all_[:3]) - left[0] / all_[0] * _variance(*left[:3]) - right[0] / all_[0] * _variance(*right[:3])
            gain[(left[3] < 1) | (right[3] < 1) | ~(gain >= 0)] = -math.inf
            first = gain.argmax(axis=1)
            for i, k in enumerate(first):
                if gain[i, k] > best[i][0]:
                    best[i] = (gain[i, k], (f, k, left[:, i, k], right[:, i, k]))
        grows = []
        for n, i in at.items():
            gain, split = best[i]
            if split is None or gain <= 0:
                continue
            f, k, left, right = split
            tree[n] = (f, float(model.thresholds[f][k]), *tree[n][2:])
            own = node == n
            node[own] = 2 * n + (bins[own, f] > k)
            for child, part in ((2 * n, left), (2 * n + 1, right)):
                tree[child] = (-1, 0.0, _mean(part), int(round(part[3])))
                if abs(_variance(*part[:3])) >= np.finfo(float).eps:
                    grows.append(child)
    for n in sorted(tree, reverse=True):  # two leaves that predict the same are one
        if tree[n][0] >= 0 and tree[2 * n][0] < 0 and tree[2 * n + 1][0] < 0 and tree[2 * n][2] == tree[2 * n + 1][2]:
            tree[n] = (-1, 0.0, tree.pop(2 * n)[2], tree[n][3])
            tree.pop(2 * n + 1)
    return tree


def _mean(stats: np.ndarray) -> float:
    return float(stats[1] / stats[0]) if stats[0] else 0.0


def _descend(tree: dict, x: np.ndarray) -> np.ndarray:
    """The prediction of a tree for each row."""
    out, stack = np.empty(len(x)), [(1, np.arange(len(x)))]
    while stack:
        node, rows = stack.pop()
        f, cut, value, _ = tree[node]
        if f < 0:
            out[rows] = value
        else:
            right = x[rows, f] > cut
            stack += [(2 * node, rows[~right]), (2 * node + 1, rows[right])]
    return out


def _assembled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol="features").transform(df)


def predict(
    model: CellTrees | GBTClassificationModel, df: DataFrame, cols: Sequence[str], prob: str = "p", cut: float = 0.5, margin: str | None = None
) -> DataFrame:
    """Probability and the flag p >= cut; with `margin`, also the sum of the trees."""
    if isinstance(model, CellTrees):
        return _looked_up(model, df, cols, prob, cut, margin)
    scored = model.transform(_assembled(df, cols))
    scored = scored.withColumn(prob, vector_to_array("probability")[1])
    if margin:
        scored = scored.withColumn(margin, vector_to_array("rawPrediction")[1])
    return scored.withColumn("flagged", (F.col(prob) >= cut).cast("int")).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def _looked_up(model: CellTrees, df: DataFrame, cols: Sequence[str], prob: str, cut: float, margin: str | None) -> DataFrame:
    """Rows of a cell share their margin, so a row is looked up in a table of all cells."""
    shared = df.sparkSession.sparkContext.broadcast((model, model.margins()))

    @F.pandas_udf("double")
    def total(x: pd.DataFrame) -> pd.Series:
        trees, margins = shared.value
        return pd.Series(margins[trees.cells([x[c].to_numpy(dtype="float64") for c in x.columns])])

    found = total(F.struct(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)]))
    scored = df.withColumn("_margin", found)
    scored = scored.withColumn(prob, F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * F.col("_margin"))))
    if margin:
        scored = scored.withColumn(margin, F.col("_margin"))
    return scored.withColumn("flagged", (F.col(prob) >= cut).cast("int")).drop("_margin")


def out_of_fold(df: DataFrame, cols: Sequence[str], label: str, folds: dict[str, list[tuple[Column, Column]]], **options) -> DataFrame:
    """Rows (split, ..., p, flagged), each predicted by a model that was fitted without it.

    A split is a list of (rows to fit on, rows to predict). The fits know nothing of each other and run side
    by side; `df` is stored once for all of them.
    """
    rows = stored(df, "out-of-fold")
    names = [(name, fit, test) for name, pairs in folds.items() for fit, test in pairs]

    def one(task: tuple[str, Column, Column]) -> DataFrame:
        name, fit, test = task
        model = fit_boosted_trees(rows.filter(fit), cols, label, **options)
        return predict(model, rows.filter(test), cols).withColumn("split", F.lit(name))

    with ThreadPool(min(4, len(names))) as pool:
        return functools.reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(df.sparkSession)(one), names))


def holdout_quality(predicted: DataFrame, label: str) -> DataFrame:
    """One row per split with the counts and ratios of D29, over rows the models did not see."""
    y, p = F.col(label) == 1, F.col("flagged") == 1
    counts = predicted.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y).alias("positives"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
    )
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({
        "accuracy": ratio(F.col("n") - fp - fn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn),
    })


def leaf_paths(model: CellTrees | GBTClassificationModel, spark) -> list[list[tuple]]:
    """Per leaf: (value x tree weight, [(feature, low, high, share of rows that follow)]).

    The saved model holds its nodes as a table; at most rounds x 31 of them at depth 4.
    """
    if isinstance(model, CellTrees):
        return [leaf for tree, weight in zip(model.trees, model.weights) for leaf in _leaves(tree, weight)]
    path = scratch_path(spark, "gbt")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.rawCount", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
    ).toPandas()
    leaves = []
    for tree, part in nodes.groupby("treeID"):
        table = part.set_index("id").to_dict("index")
        stack = [(0, [])]
        while stack:
            node, conds = stack.pop()
            row = table[node]
            if row["leftChild"] < 0:
                leaves.append((row["prediction"] * model.treeWeights[tree], _merge(conds)))
                continue
            f, cut = int(row["featureIndex"]), float(row["leftCategoriesOrThreshold"][0])
            total = float(row["rawCount"])
            for child, lo, hi in ((row["leftChild"], -math.inf, cut), (row["rightChild"], cut, math.inf)):
                share = float(table[child]["rawCount"]) / total if total > 0 else 0.0
                stack.append((child, [*conds, (f, lo, hi, share)]))
    return leaves


def _leaves(tree: dict, weight: float) -> Iterator[tuple]:
    stack = [(1, [])]
    while stack:
        node, conds = stack.pop()
        f, cut, value, total = tree[node]
        if f < 0:
            yield value * weight, _merge(conds)
            continue
        for child, lo, hi in ((2 * node, -math.inf, cut), (2 * node + 1, cut, math.inf)):
            stack.append((child, [*conds, (f, lo, hi, tree[child][3] / total if total > 0 else 0.0)]))


def _merge(conds):
    out: dict[int, list[float]] = {}
    for f, lo, hi, share in conds:
        cur = out.setdefault(f, [-math.inf, math.inf, 1.0])
        cur[0], cur[1], cur[2] = max(cur[0], lo), min(cur[1], hi), cur[2] * share
    return [(f, *v) for f, v in sorted(out.items())]


def attributions(model: CellTrees | GBTClassificationModel, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact Shapley value of each feature on the margin of a fitted model, columns shap_<feature>."""
    return attribute(leaf_paths(model, df.sparkSession), df, cols)


def base_value(paths: Sequence[tuple]) -> float:
    """The margin of the empty coalition: every leaf weighed by the share of rows that reach it."""
    return math.fsum(value * math.prod(share for _, _, _, share in path) for value, path in paths)


def attribute(paths: Sequence[tuple], df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact Shapley values of an ensemble given as leaves (value, [(feature, low, high, share)]).

    A leaf counts when every feature on its path is inside its interval (low, high]; a feature outside
    the coalition is replaced by the share of training rows that follow the path. With at most four
    features on a path the sum over coalitions is exact and short. `paths` is as large as the ensemble.

    Rows between the same bounds in every feature share their values, and a fit has few bounds a feature:
    the ensemble is walked once for each new such cell of a task, not for each row.
    """
    shared = df.sparkSession.sparkContext.broadcast(list(paths))
    cols = list(cols)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"shap_{c}", T.DoubleType()) for c in cols]])

    def walk(x: np.ndarray) -> np.ndarray:
        phi = np.zeros((len(x), len(cols)))
        for value, path in shared.value:
            k = len(path)
            inside = [((x[:, f] > lo) & (x[:, f] <= hi)).astype("float64") for f, lo, hi, _ in path]
            for i, (f, _, _, share) in enumerate(path):
                others = [j for j in range(k) if j != i]
                weight = np.zeros(len(x))
                for size in range(k):
                    scale = math.factorial(size) * math.factorial(k - size - 1) / math.factorial(k)
                    for team in itertools.combinations(others, size):
                        term = np.full(len(x), scale)
                        for j in others:
                            term *= inside[j] if j in team else path[j][3]
                        weight += term
                phi[:, f] += value * weight * (inside[i] - share)
        return phi

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds = [sorted({b for _, path in shared.value for f, lo, hi, _ in path if f == i for b in (lo, hi) if math.isfinite(b)}) for i in range(len(cols))]
        known: dict[bytes, int] = {}
        table = np.zeros((0, len(cols)))
        for pdf in batches:
            x = pdf[cols].to_numpy(dtype="float64")
            # the number of bounds below a value; infinite and unknown values lie on no side of some bounds
            cell = np.stack([np.searchsorted(b, x[:, i], side="left") for i, b in enumerate(bounds)], axis=1).astype("int32")
            cell = np.where(np.isfinite(x), cell, np.where(np.isnan(x), -1, np.where(x > 0, -2, -3)))
            cells, first, of_row = np.unique(cell, axis=0, return_index=True, return_inverse=True)
            keys = [c.tobytes() for c in np.ascontiguousarray(cells)]
            if len(known) > _MOST_CELLS:
                known, table = {}, table[:0]
            new = [i for i, key in enumerate(keys) if key not in known]
            if new:
                known.update({keys[i]: len(table) + n for n, i in enumerate(new)})
                table = np.concatenate([table, walk(x[first[new]])])
            phi = table[np.array([known[key] for key in keys], dtype="int64")][of_row.reshape(-1)]
            yield pdf.assign(**{f"shap_{c}": phi[:, i] for i, c in enumerate(cols)})

    return df.mapInPandas(run, schema)


def mean_attribution(attributed: DataFrame, cols: Sequence[str], zone: str = "zone") -> DataFrame:
    """Mean |attribution| and sample count per (zone, factor); zone NULL is the global row."""
    long = attributed.unpivot(zone, [f"shap_{c}" for c in cols], "factor", "v").withColumn(
        "factor", F.regexp_replace("factor", "^shap_", "")
    )
    sums = long.groupBy(zone, "factor").agg(F.sum(F.abs("v")).alias("s"), F.count("v").alias("n"))
    whole = sums.groupBy("factor").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn(zone, F.lit(None).cast("string"))
    both = sums.unionByName(whole)
    return both.select(zone, "factor", (F.col("s") / F.col("n")).alias("mean_abs"), F.col("n").alias("n_samples"))


def training_decision(gate: DataFrame, enabled: bool, override: bool = False, reason: str = "") -> DataFrame:
    """Adds `refusal_reasons` of the flag and of the label gate, and `may_train`, true only without any."""
    flag = [] if (enabled or override) else [F.lit(f"training disabled ({reason})")]
    reasons = F.concat(F.array(*flag).cast("array<string>"), F.col("reasons"))
    return gate.withColumn("refusal_reasons", reasons).withColumn("may_train", F.size("refusal_reasons") == 0)
