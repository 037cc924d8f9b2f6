"""LM scoring by context-tree weighting.

A text is its lower-case words, one blank between them and a line end behind them, as bytes. Each
byte is eight binary decisions; each decision node has a context tree over the preceding bytes,
closest first, up to `DEPTH`. A tree node holds Krichevsky-Trofimov counts, and its weighted
probability is half its own estimate and half the product of its children's. A decision mixes the
estimates of all depths along its path with the weights this recursion gives them. A context that
training never saw takes the estimate its parent's path ends with. Trees are fitted on training
documents alone, over all of them, and then fixed; the score of a text is the log10 probability
of all its bytes, and its code length follows.

The work: blocks of documents count their 6-grams and words; grams are added up by key and dealt
to model buckets by their closest three bytes, so that no bucket's subtree of one context has more
than 256^3 grams; buckets fold depths 5 to 3, the three depths above are grouped sums over at most
65,793 contexts; weights come down the same way; scores return to the blocks that asked. A gram
that only held-out documents have takes part with count zero, which changes no weight.

Defined results: a NULL or empty text is the line end alone. Without training documents every bit
costs one bit and the base score takes N = V = 0. A NULL doc_id counts as training. Repeated rows
are scored and counted each.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.blocks import buckets, deal, merged, open_block, squeeze, text_bytes, unsqueeze, write_blocks
from pluvia.llm.common import stored
from pluvia.llm.simhash_dedup import word_bytes

DEPTH = 5
#: Depth whose contexts deal grams to model buckets.
SPLIT = 3
PAD = b"\n" * DEPTH
END_WORD = xxhash.xxh64_intdigest(b"")
LN_HALF, LN_PI = math.log(0.5), math.log(math.pi)
#: Coefficients of Stirling's series for the logarithm of the gamma function.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
RESULT = "held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"


def ln_gamma(x, log):
    """Works on arrays and on columns: shifted by eight, then the series."""
    y, shift = x + 8.0, log(x)
    for k in range(1, 8):
        shift = shift + log(x + float(k))
    inverse = 1.0 / y
    square, series, power = inverse * inverse, 0.0, inverse
    for c in STIRLING:
        series, power = series + c * power, power * square
    return (y - 0.5) * log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def ln_kt(a, b, log=np.log):
    """Log probability the Krichevsky-Trofimov estimator gives to any sequence of a zeros and b ones."""
    return ln_gamma(a + 0.5, log) + ln_gamma(b + 0.5, log) - ln_gamma(a + b + 1.0, log) - LN_PI


#: Counts below this take their logarithms of the gamma function from a table of its values at half steps.
SMALL = 4_096
_TABLE = ln_gamma(np.arange(1, 2 * SMALL + 1) / 2, np.log)


def _ln_kt_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    small = a + b < SMALL
    x, y = a[small], b[small]
    out[small] = _TABLE[2 * x] + _TABLE[2 * y] - _TABLE[2 * (x + y) + 1] - LN_PI
    out[~small] = ln_kt(a[~small].astype(float), b[~small].astype(float))
    return out


def _codes(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """6-gram codes of all bytes of the texts, closest context byte highest, coded byte lowest; first code of each text."""
    bodies = [b" ".join(w) + b"\n" for w in texts]
    buf = np.frombuffer(PAD + PAD.join(bodies), np.uint8).astype(np.uint64)
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    code = buf[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        code |= buf[DEPTH - back : len(buf) - back] << np.uint64(8 * (DEPTH + 1 - back))
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    real = np.ones(len(code), dtype=bool)
    for gap in range(1, DEPTH + 1):  # padding before every text but the first is not coded
        real[starts[1:] - gap] = False
    return code[real], np.cumsum(sizes) - sizes


def _word_key(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def _asks(n: int):
    """Blocks -> (kind, bucket, block, blob): grams (kind 0) and words (kind 1) with their training counts."""

    def run(batches):
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams: tuple[list, list] = ([], [])
                words: Counter = Counter()
                known: Counter = Counter()
                for part in open_block(payload.as_py()):
                    held = part.column("held_out").to_numpy(zero_copy_only=False)
                    split = [word_bytes(t.as_py()) for t in part.column("text")]
                    for flag in (False, True):
                        own = [w for w, h in zip(split, held) if h == flag]
                        if own:
                            u, c = np.unique(_codes(own)[0], return_counts=True)
                            grams[0].append(u)
                            grams[1].append(np.zeros_like(c) if flag else c)
                            into = words if flag else known
                            for w in own:
                                into.update(w)
                    known[b""] += int((~held).sum())
                    if len(grams[0]) > 32:
                        u, c = merged(*grams)
                        grams = ([u], [c])
                rows = {"kind": [], "bucket": [], "block": [], "blob": []}
                for w in words:
                    known[w] += 0
                hashes = np.fromiter(map(_word_key, known), np.uint64, len(known))
                counts = np.fromiter(known.values(), np.int64, len(known))
                for kind, (u, c) in enumerate([merged(*grams), merged([hashes], [counts])]):
                    for b, k, v in deal(u, n, c):
                        rows["kind"].append(kind)
                        rows["bucket"].append(b)
                        rows["block"].append(block)
                        rows["blob"].append(squeeze(k, v.astype("<u4")))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows["kind"], pa.int32()), pa.array(rows["bucket"], pa.int64()), pa.array(rows["block"], pa.int64()), pa.array(rows["blob"], pa.binary())],
                    names=list(rows),
                )

    return run


def _added(pdf: pd.DataFrame, kind: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all blobs; those of a block fit 32 bits, those of the corpus need 64."""
    u, c = np.empty(0, np.uint64), np.empty(0, np.int64)
    for at in range(0, len(pdf), 64):  # few blocks at a time, so that memory follows the distinct keys
        parts = [unsqueeze(b, "<u8", kind) for b in pdf["blob"][at : at + 64]]
        u, c = merged([u, *[p[0] for p in parts]], [c, *[p[1].astype(np.int64) for p in parts]])
    return u, c


class Fold:
    """Nodes of depths DEPTH..SPLIT over sorted grams, their counts and weighted probabilities."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.codes, byte = codes, (codes & np.uint64(255)).astype(np.int64)
        self.bits = [(byte >> (7 - k)) & 1 for k in range(8)]
        self.of: dict[tuple[int, int], np.ndarray] = {}
        self.rep, self.a, self.b, self.lk, self.lw = {}, {}, {}, {}, {}
        for d in range(DEPTH, SPLIT - 1, -1):
            ctx = codes >> np.uint64(8 * (DEPTH + 1 - d))
            order = np.argsort(ctx << np.uint64(8) | codes & np.uint64(255)) if d < DEPTH else np.arange(len(codes))
            c, x, m = ctx[order], byte[order], n[order]
            for k in range(8):
                node = (x >> (8 - k)) + (1 << k)
                new = np.concatenate(([True], (c[1:] != c[:-1]) | (node[1:] != node[:-1])))
                first = np.flatnonzero(new)
                one = self.bits[k][order]
                a, b = np.add.reduceat(m * (1 - one), first), np.add.reduceat(m * one, first)
                of = np.empty(len(codes), dtype=np.int64)
                of[order] = np.cumsum(new) - 1
                lk = _ln_kt_counts(a, b)
                key = d, k
                self.of[key], self.rep[key], self.a[key], self.b[key], self.lk[key] = of, order[first], a, b, lk
                if d == DEPTH:
                    self.lw[key] = lk
                else:
                    below = np.bincount(of[self.rep[d + 1, k]], weights=self.lw[d + 1, k], minlength=len(first))
                    self.lw[key] = np.logaddexp(LN_HALF + lk, LN_HALF + below)

    def names(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Context and decision node of the nodes at depth SPLIT."""
        g = self.codes[self.rep[SPLIT, k]]
        return (g >> np.uint64(8 * (DEPTH + 1 - SPLIT))).astype(np.int64), ((g & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64) + (1 << k)


def _subtrees(pdf: pd.DataFrame) -> pd.DataFrame:
    fold = Fold(*_added(pdf, "<u8"))
    parts = []
    for k in range(8):
        ctx, node = fold.names(k)
        key = SPLIT, k
        parts.append(pd.DataFrame({"ctx": ctx, "node": node, "a": fold.a[key], "b": fold.b[key], "lw": fold.lw[key]}))
    return pd.concat(parts)


def _answers(n: int):
    """Grams and the weights from above -> log10 probability of every gram, dealt to the buckets that ask."""

    def run(left: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"bucket": [], "blob": []})
        fold = Fold(*_added(left, "<u8"))
        keys = (top["ctx"].to_numpy() << 8) + top["node"].to_numpy()
        order = np.argsort(keys)
        logp = np.zeros(len(fold.codes))
        for k in range(8):
            ctx, node = fold.names(k)
            at = order[np.searchsorted(keys, (ctx << 8) + node, sorter=order)]
            mixed, rest, known = (top[c].to_numpy()[at] for c in ("mixed", "rest", "known"))
            for d in range(SPLIT, DEPTH + 1):
                key = d, k
                if d > SPLIT:
                    up = fold.of[d - 1, k][fold.rep[key]]
                    mixed, rest, known = mixed[up], rest[up], known[up]
                a, b = fold.a[key], fold.b[key]
                kt = (b + 0.5) / (a + b + 1.0)
                weight = np.exp(LN_HALF + fold.lk[key] - fold.lw[key]) if d < DEPTH else np.ones(len(a))
                known = np.where(a + b > 0, mixed + rest * kt, known)
                mixed, rest = mixed + rest * weight * kt, rest * (1 - weight)
            p = np.clip(known[fold.of[DEPTH, k]], 1e-12, 1 - 1e-12)
            logp += np.log10(np.where(fold.bits[k] == 1, p, 1 - p))
        rows = [(b, squeeze(k, v.astype("<f4"))) for b, k, v in deal(fold.codes, n, logp)]
        return pd.DataFrame(rows, columns=["bucket", "blob"])

    return run


def _to_blocks(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    parts = [unsqueeze(b, "<u8", "<f4") for b in found["blob"]]
    keys = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.uint64)
    values = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, "<f4")
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    blobs = []
    for b in asked["blob"]:
        u = unsqueeze(b, "<u8")[0]
        blobs.append(squeeze(u, values[np.searchsorted(keys, u)]))
    return pd.DataFrame({"kind": 0, "bucket": asked["bucket"], "block": asked["block"], "blob": blobs, "types": 0, "tokens": 0})


def _word_counts(asked: pd.DataFrame) -> pd.DataFrame:
    """Training counts back to the blocks; the bucket's types and tokens on one row."""
    u, c = _added(asked)
    blobs = []
    for b in asked["blob"]:
        own = unsqueeze(b, "<u8")[0]
        blobs.append(squeeze(own, c[np.searchsorted(u, own)].astype("<u8")))
    types, tokens = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
    types[0], tokens[0] = (c > 0).sum(), c.sum()
    return pd.DataFrame({"kind": 1, "bucket": asked["bucket"], "block": asked["block"], "blob": blobs, "types": types, "tokens": tokens})


def _scores(types: int, tokens: int):
    def answers(got: pd.DataFrame, form: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of a block and what the buckets say of them."""
        parts = [unsqueeze(b, "<u8", form) for b in got["blob"]]
        keys = np.concatenate([np.empty(0, np.uint64), *[p[0] for p in parts]])
        order = np.argsort(keys)
        return keys[order], np.concatenate([np.empty(0, form), *[p[1] for p in parts]])[order]

    def run(blocks: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        out = []
        for payload in blocks["payload"]:
            u, logp = answers(got[got["kind"] == 0], "<f4")
            hashes, count = answers(got[got["kind"] == 1], "<u8")
            base = np.log10((count + 0.1) / (tokens + 0.1 * (types + 1)))
            slot: dict[bytes, int] = {}
            for part in open_block(payload):
                held = part.column("held_out").to_pylist()
                split = [word_bytes(t.as_py()) for t in part.column("text")]
                new = [x for x in {b""}.union(*split) if x not in slot]
                slot.update(zip(new, np.searchsorted(hashes, np.fromiter(map(_word_key, new), np.uint64, len(new))).tolist()))
                codes, starts = _codes(split)
                distinct, back = np.unique(codes, return_inverse=True)
                total = np.add.reduceat(logp[np.searchsorted(u, distinct)][back], starts)
                size = np.diff(np.append(starts, len(codes)))
                for r, w in enumerate(split):
                    w.append(b"")
                    at = np.fromiter(map(slot.__getitem__, w), np.int64, len(w))
                    out.append((part.column("doc_id")[r].as_py(), held[r], len(at), int((count[at] > 0).sum()), tokens, float(base[at].sum()),
                                float(total[r]), int(size[r]), float(-total[r] / math.log10(2) / size[r])))
        return pd.DataFrame(out, columns=["doc_id", *[f.split()[0] for f in RESULT.split(", ")]])

    return run


def _tops(level: DataFrame) -> DataFrame:
    """Weights the depths above SPLIT give: (ctx, node, mixed, rest, known) for every node at depth SPLIT."""
    log = F.log
    levels = {SPLIT: level}
    for d in range(SPLIT - 1, -1, -1):
        up = levels[d + 1].groupBy(F.shiftright("ctx", 8).alias("ctx"), "node").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below"))
        lk = ln_kt(F.col("a").cast("double"), F.col("b").cast("double"), log)
        up = up.withColumn("lk", lk)
        high = F.greatest("lk", "below")
        lw = LN_HALF + high + log(F.exp(F.col("lk") - high) + F.exp(F.col("below") - high))
        levels[d] = stored(up.withColumn("lw", lw), f"depth-{d}")
    path = None
    for d in range(SPLIT):
        kt = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
        weight = F.exp(LN_HALF + F.col("lk") - F.col("lw"))
        here = levels[d].select("ctx", "node", (F.col("a") + F.col("b")).alias("n"), kt.alias("kt"), weight.alias("w"))
        if path is None:
            here = here.withColumns({"mixed": F.lit(0.0), "rest": F.lit(1.0), "known": F.lit(0.5)})
        else:
            above = path.withColumnRenamed("ctx", "up")
            here = here.withColumn("up", F.shiftright("ctx", 8)).join(above, ["up", "node"]).drop("up")
        known = F.when(F.col("n") > 0, F.col("mixed") + F.col("rest") * F.col("kt")).otherwise(F.col("known"))
        mixed: Column = F.col("mixed") + F.col("rest") * F.col("w") * F.col("kt")
        path = here.select("ctx", "node", mixed.alias("mixed"), (F.col("rest") * (1 - F.col("w"))).alias("rest"), known.alias("known"))
    split = level.select("ctx", "node", F.shiftright("ctx", 8).alias("up"))
    return split.join(path.withColumnRenamed("ctx", "up"), ["up", "node"]).drop("up")


def ctw_scores(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    """Scores of all documents by trees fitted on those that are not held out."""
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0 if held_out is None else held_out
    docs = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = buckets(text_bytes(docs))
    blocks = write_blocks(docs)
    asks = stored(blocks.mapInArrow(_asks(n), "kind int, bucket bigint, block bigint, blob binary"), "asks")
    grams, words = asks.where("kind = 0").drop("kind"), asks.where("kind = 1").drop("kind")

    def by_model(pdf: pd.DataFrame) -> pd.DataFrame:
        u, c = _added(pdf)
        ctx = u >> np.uint64(8 * (DEPTH + 1 - SPLIT))
        rows = [(b, squeeze(k, v.astype("<u8"))) for b, k, v in deal(u, n, c, by=ctx)]
        return pd.DataFrame(rows, columns=["model", "blob"])

    model = stored(grams.groupBy("bucket").applyInPandas(by_model, "model bigint, blob binary"), "grams")
    level = stored(
        model.groupBy("model").applyInPandas(lambda k, pdf: _subtrees(pdf).assign(model=k[0]), "ctx bigint, node bigint, a bigint, b bigint, lw double, model bigint"), "depth-3"
    )
    tops = _tops(level.drop("model")).join(level.select("model", "ctx").distinct(), "ctx")
    found = model.groupBy("model").cogroup(tops.groupBy("model")).applyInPandas(_answers(n), "bucket bigint, blob binary")
    back = "kind int, bucket bigint, block bigint, blob binary, types bigint, tokens bigint"
    counted = stored(words.groupBy("bucket").applyInPandas(_word_counts, back), "word-counts")
    types, tokens = counted.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    answered = grams.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInPandas(_to_blocks, back)
    got = answered.union(counted).select("block", "kind", "bucket", "blob")
    return blocks.groupBy("block").cogroup(got.groupBy("block")).applyInPandas(_scores(types, tokens), f"doc_id {kind}, {RESULT}")
