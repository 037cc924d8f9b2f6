"""Isolation forest (M02, M03) on Spark: hashed samples, one small task per tree, broadcast scoring.

Spark ships no isolation forest. The full table is only scanned and hashed; a tree sees its
256 rows and nothing else. The node table has at most trees x 511 rows, which bounds both
its collection and the broadcast. A seed and the row keys decide everything, so neither
row order nor partitioning changes the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia.operators.rank import exact_quantiles

_NODES = "tree int, node int, feature int, threshold double, size int"
_EULER = 0.5772156649015329
#: Rows are numbered modulo this prime (2^31 - 1), so that a step times a number stays below 2^63.
PRIME = 2_147_483_647
_BITS = np.uint64(31)
#: Path lengths are added up in steps of this size, as integers: their sum has one value in any order.
STEPS = 2**32
#: Cells of a tree's table at most: 256 rows cut three features into 86^3 cells at most, a byte each.
_CELLS = 2**20
#: Rows that go through the trees together.
_BLOCK = 65_536


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + _EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _digits(text: str, n: int = 15) -> int:
    """The first hex digits of an MD5: a hash that every SQL engine has."""
    return int(hashlib.md5(text.encode()).hexdigest()[:n], 16)


def row_hash(keys: Sequence[str], seed: int) -> Column:
    """A number below PRIME from the row key; the same row always gets the same number."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint") % PRIME


def tree_samples(df: DataFrame, keys: Sequence[str], trees: int, size: int, seed: int, rows: int) -> DataFrame:
    """Candidate rows per tree (about twice the sample size), by hash of row and tree.

    One hash per row, then one linear step modulo a prime per tree. Every tree draws from all rows at any
    size; a row leaves the scan only with the trees that drew it. The steps run over Arrow batches: the
    remainder modulo 2^31 - 1 is one shifted sum.
    """
    below, prime = np.uint64(min(1.0, 2.0 * size / max(rows, 1)) * PRIME), np.uint64(PRIME)
    factor = [np.uint64(1 + _digits(f"{seed}|{t}|a") % (PRIME - 1)) for t in range(trees)]
    step = [np.uint64(_digits(f"{seed}|{t}|b") % PRIME) for t in range(trees)]
    schema = T.StructType([*df.schema.fields, T.StructField("tree", T.IntegerType()), T.StructField("_u", T.LongType())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("_h").to_numpy().astype("uint64")
            u, v = np.empty_like(h), np.empty_like(h)
            own, found, waiting = batch.drop_columns(["_h"]), [], 0
            for t in range(trees):
                np.multiply(h, factor[t], out=u)
                u += step[t]
                np.right_shift(u, _BITS, out=v)
                u &= prime
                u += v  # below 2 * PRIME, as h and the factor are below PRIME
                np.subtract(u, prime, out=v)  # wraps to a large number where u is the remainder already
                np.minimum(u, v, out=u)
                at = np.flatnonzero(u < below)
                if len(at):
                    found.append((at, np.full(len(at), t, dtype="int32"), u[at].astype("int64")))
                    waiting += len(at)
                if found and (waiting >= _BLOCK or t == trees - 1):
                    at, tree, u = (np.concatenate(c) for c in zip(*found))
                    taken = own.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tree), pa.array(u)], [*taken.schema.names, "tree", "_u"])
                    found, waiting = [], 0

    return df.withColumn("_h", row_hash(keys, seed)).mapInArrow(draw, schema)


def _grow(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes (node, feature, threshold, size); which feature splits a node and where follows from a hash of the node."""
    nodes, open_nodes = [], [(1, np.arange(len(x)), 0)]
    while open_nodes:
        node, idx, depth = open_nodes.pop()
        part = x[idx]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(idx) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, len(idx)))
            continue
        chance = [_digits(f"{seed}|{tree}|{node}|{c}", 13) / 2.0**52 for c in "fc"]
        f = int(usable[int(chance[0] * len(usable))])
        cut = float(lo[f] + chance[1] * (hi[f] - lo[f]))
        cut = float(lo[f]) if cut >= hi[f] else cut
        left = part[:, f] <= cut
        nodes.append((node, f, cut, len(idx)))
        open_nodes.append((2 * node + 1, idx[~left], depth + 1))
        open_nodes.append((2 * node, idx[left], depth + 1))
    return nodes


class _Trees:
    """The node table as the tasks use it; a worker builds its tables once and keeps them with the broadcast.

    A tree cuts each feature at a few values, so it is constant in the cells between them. Its table holds the
    path length of every cell; a row finds its cell from the ranks of its values among the cuts of all trees,
    without a walk. A tree with too many cells (many features) is walked level by level.
    """

    def __init__(self, nodes: pd.DataFrame, features: int, limit: int):
        tree = nodes["tree"].to_numpy()
        order = np.argsort(tree, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(tree[order])) + 1)
        node, feature = nodes["node"].to_numpy(dtype="int64"), nodes["feature"].to_numpy(dtype="int64")
        cut = nodes["threshold"].to_numpy(dtype="float64")
        path = np.rint((np.floor(np.log2(node)) + average_path(nodes["size"])) * STEPS).astype("int64")
        self.trees = [(node[p], feature[p], cut[p], path[p]) for p in parts]
        self.cuts = [np.unique(cut[feature == f]) for f in range(features)]
        self.limit = limit

    @cached_property
    def tables(self) -> list[tuple]:
        """Per tree (offsets per feature and rank, code per cell, path length per code), or None and the flat tree."""
        return [self._table(*t) for t in self.trees]

    def _table(self, node, feature, cut, path) -> tuple:
        own = [np.unique(cut[feature == f]) for f in range(len(self.cuts))]
        shape = [len(c) + 1 for c in own]
        if math.prod(shape) > _CELLS:
            return None, self._flat(node, feature, cut, path), None
        leaf = feature < 0
        lengths, code = np.unique(path[leaf], return_inverse=True)
        cells = np.zeros(shape, dtype=np.min_scalar_type(len(lengths)))
        codes, at = dict(zip(node[leaf].tolist(), code.tolist())), {n: i for i, n in enumerate(node.tolist())}
        waiting = [(1, [0] * len(shape), shape)]
        while waiting:
            n, lo, hi = waiting.pop()
            if n in codes:
                cells[tuple(slice(a, b) for a, b in zip(lo, hi))] = codes[n]
                continue
            f = int(feature[at[n]])
            k = int(np.searchsorted(own[f], cut[at[n]])) + 1
            waiting.append((2 * n, lo, [*hi[:f], min(k, hi[f]), *hi[f + 1 :]]))
            waiting.append((2 * n + 1, [*lo[:f], max(k, lo[f]), *lo[f + 1 :]], hi))
        strides = [math.prod(shape[f + 1 :]) for f in range(len(shape))]
        offsets = [np.append(0, np.cumsum(np.isin(every, c)) * s).astype("int32") for every, c, s in zip(self.cuts, own, strides)]
        return offsets, cells.ravel(), lengths

    def _flat(self, node, feature, cut, path) -> tuple:
        """A tree by heap position; a leaf points to itself."""
        width, leaf = 2 ** (self.limit + 1), feature < 0
        split, child, length = np.zeros(width, "int64"), np.zeros(2 * width, "int64"), np.zeros(width, "int64")
        cuts = np.full(width, np.inf)
        split[node], cuts[node], length[node] = np.where(leaf, 0, feature), np.where(leaf, np.inf, cut), path
        child[2 * node], child[2 * node + 1] = np.where(leaf, node, 2 * node), np.where(leaf, node, 2 * node + 1)
        return split, cuts, child, length

    def totals(self, x: np.ndarray) -> np.ndarray:
        """Path lengths of the rows, added up over the trees. An unknown value goes left."""
        known = np.where(np.isnan(x), -np.inf, x)
        ranks = [np.searchsorted(c, known[:, f], "left") for f, c in enumerate(self.cuts)]
        rows = len(x)
        total, length = np.zeros(rows, dtype="int64"), np.empty(rows, dtype="int64")
        cell, more, held = np.empty(rows, dtype="int32"), np.empty(rows, dtype="int32"), {}
        for offsets, table, lengths in self.tables:
            if offsets is None:
                total += self._walk(x, *table)
                continue
            cell.fill(0)
            for o, r in zip(offsets, ranks):
                cell += np.take(o, r, out=more, mode="clip")  # ranks and cells are in range; clipping writes straight to `out`
            code = held.setdefault(table.dtype, np.empty(rows, table.dtype))
            np.take(table, cell, out=code, mode="clip")
            total += np.take(lengths, code, out=length, mode="clip")
        return total

    def _walk(self, x: np.ndarray, split, cuts, child, length) -> np.ndarray:
        start, flat, at = np.arange(len(x)) * x.shape[1], x.ravel(), np.ones(len(x), dtype="int64")
        for _ in range(self.limit):
            at = child.take(2 * at + (flat.take(start + split.take(at)) > cuts.take(at)))
        return length.take(at)


@dataclass
class IsolationForest:
    cols: list[str]
    keys: list[str]
    nodes: DataFrame
    sample: int
    limit: int
    trees: int
    offset: float | None = None

    def score(self, df: DataFrame, name: str = "isolation") -> DataFrame:
        """2^(-E[h]/c(sample)), higher is more anomalous; minus the stored offset when set."""
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast(_Trees(self.nodes.toPandas(), len(self.cols), self.limit))
        cols, trees, norm, offset = self.cols, self.trees, float(average_path(self.sample)), self.offset or 0.0
        schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

        def scored(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = lambda b, c: b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.concatenate([np.column_stack([number(b, c) for c in cols]) for b in block])
            out = np.exp2(-(shared.value.totals(x) / STEPS / trees) / norm) - offset
            start = 0
            for b in block:
                part = pa.array(out[start : start + b.num_rows])
                yield pa.RecordBatch.from_arrays([*b.columns, part], [*b.schema.names, name])
                start += b.num_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, rows = [], 0
            for batch in batches:
                block.append(batch)
                rows += batch.num_rows
                if rows >= _BLOCK:
                    yield from scored(block)
                    block, rows = [], 0
            if rows:
                yield from scored(block)

        return df.mapInArrow(run, schema)


def fit(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], trees: int = 300, sample: int = 256,
    contamination: float = 0.01, seed: int = 42,
) -> IsolationForest:
    """Fit rows only, no NULLs. Runs jobs: a count, the trees, and the score quantile of the fit rows."""
    cols = list(cols)
    rows = df.count()
    if rows < 2:
        raise ValueError("isolation forest needs at least two rows")
    used = min(sample, rows)
    limit = max(1, math.ceil(math.log2(used)))
    picked = tree_samples(df.select(*keys, *cols), keys, trees, used, seed, rows)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        chosen = pdf.sort_values(["_u", *keys]).head(used)
        nodes = _grow(chosen[cols].to_numpy(dtype="float64"), seed, tree, limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "size"])
        out.insert(0, "tree", tree)
        return out

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = picked.repartition(tasks, "tree").groupBy("tree").applyInPandas(grow, _NODES)
    # kept as a local relation: trees x 511 rows at most
    nodes = df.sparkSession.createDataFrame(nodes.toPandas(), _NODES)
    model = IsolationForest(cols, list(keys), nodes, used, limit, trees)
    q = exact_quantiles(model.score(df.select(*cols)), ["isolation"], [1.0 - contamination])
    model.offset = q.first()["value"]
    return model


def anomaly_scores(model: IsolationForest, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M03 with E11: raw score, 0-100 percentile over all rows, and its integer part. Runs jobs."""
    from pluvia.operators.rank import percentile_rank

    raw = model.score(df, "anomaly_score_raw")
    ranked = percentile_rank(raw, "anomaly_score_raw", keys)
    return ranked.withColumnRenamed("percentile_0_100", "anomaly_score").withColumnRenamed(
        "percentile_int", "anomaly_percentile"
    )
