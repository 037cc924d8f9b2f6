"""SimHash near-dedup with vantage-point trees.

A document's fingerprint has a bit set where over half of its shingle hashes have it. A
vantage-point tree, fitted on a bounded sample, deals the distinct fingerprints to shards by
Hamming distance: d <= mu goes inside, d > mu outside. A fingerprint is owned by one shard and
also visits every shard that the triangle bounds d <= mu + r and d > mu - r cannot rule out, so
each pair within the radius meets in the owner's shard of either side. Of two fingerprints within
radius r, one 32-bit half differs in r // 2 bits at most, so there is one tree for each half, with
that bound; distances over all 64 bits decide. Shards that one half's value crowds are cut into
blocks of bounded size in which their pairs still meet. Shards search with local
trees under the same bounds and return star edges (fingerprint, least linked fingerprint): links
are exact, and their number is linear in the rows. Components follow in `links`.

Defined results: a text without words, or NULL, has fingerprint zero and links like any other.
Equal fingerprints are one node however many documents share them. Rows that repeat a doc_id are
one document if their texts are equal.

`keep_leaders` is the form for near copies by word shingles: fingerprints propose (radius 20,
documents of comparable length, bottom-k sketches that agree in half their values) and an exact
comparison of shingle sets decides. Random 64-bit fingerprints lie 32 +- 4 bits apart, so bounds
prune at radius 3 and not at radius 20; there the work grows with the square of the documents
of one length band.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import boxed, stored, unboxed
from pluvia.llm.links import components
from pluvia.session import cut_lineage

#: The tree is fitted on so many distinct fingerprints at most (those with the least hash).
SAMPLE = 100_000
#: Distinct fingerprints a shard should own, and those a local leaf compares without bounds.
SHARD, LOCAL = 65_536, 64
#: The same for a tree over a half, and the rows above which its shards are cut into blocks.
HALF_SHARD, CROWD = 8_192, 1_048_576
#: Bits a fingerprint has, as a whole and in halves.
WHOLE, HALVES = np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000))
#: Values of a bottom-k sketch.
SKETCH = 32
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_bytes(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case; bytes.split() knows ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `size` words; of the whole sequence where it is shorter."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :].tolist())), dtype=np.uint64, count=len(starts))


def simhash(hashes: np.ndarray) -> int:
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, size: int, distinct: bool = False) -> DataFrame:
    """(doc_id, mark, fp, n, sketch) per row: `mark` hashes the words, `n` counts shingles, `sketch` has their least hashes.

    With `distinct`, `fp` and `n` are those of the shingle set; else repeats count.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {"mark": [], "fp": [], "n": [], "sketch": []}
                for text in part.column(1):
                    words = word_bytes(text.as_py())
                    h = shingle_hashes(words, size)
                    h = np.unique(h) if distinct else h
                    low = np.unique(np.partition(h, 4 * SKETCH)[: 4 * SKETCH] if len(h) > 4 * SKETCH else h)[:SKETCH]
                    out["mark"].append(xxhash.xxh64_intdigest(b" ".join(words), 42) - (1 << 63))
                    out["fp"].append(simhash(h))
                    out["n"].append(len(h))
                    out["sketch"].append((low >> np.uint64(32)).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(out["mark"], pa.int64()), pa.array(out["fp"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["sketch"], pa.binary())],
                    names=["doc_id", "mark", "fp", "n", "sketch"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, mark bigint, fp bigint, n bigint, sketch binary")


def _apart(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Tree:
    """Complete vantage-point tree in heap order: `points` and `radii` of the inner nodes."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.depth = depth
        inner = (1 << depth) - 1
        self.points, self.radii = np.zeros(inner, dtype=np.uint64), np.zeros(inner, dtype=np.int16)
        rng = np.random.default_rng(seed)
        parts = {0: sample}
        for node in range(inner):
            rows = parts.pop(node)
            if len(rows):
                tries = rng.choice(rows, min(8, len(rows)), replace=False)
                apart = [_apart(rows, v) for v in tries]
                best = int(np.argmax([d.std() for d in apart]))
                self.points[node], self.radii[node] = tries[best], int(np.median(apart[best]))
                inside = apart[best] <= self.radii[node]
            else:
                inside = np.zeros(0, dtype=bool)
            parts[2 * node + 1], parts[2 * node + 2] = rows[inside], rows[~inside]

    def visits(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shards and whether the row is owned there."""
        row, node, own = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64), np.ones(len(fps), dtype=bool)
        for _ in range(self.depth):
            d, mu = _apart(fps[row], self.points[node]), self.radii[node]
            inside, outside = d <= mu + radius, d > mu - radius
            row, node, own = (
                np.concatenate([row[inside], row[outside]]),
                np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2]),
                np.concatenate([own[inside] & (d <= mu)[inside], own[outside] & (d > mu)[outside]]),
            )
        return row, node, own


def near_pairs(q: np.ndarray, x: np.ndarray, radius: int, mask: np.uint64 = WHOLE, reach: int | None = None):
    """Index pairs (into q, into x) at most `radius` bits apart, by local trees.

    With a mask, every such pair that is at most `reach` apart in the masked bits, and maybe others.
    """
    work = [(np.arange(len(q)), np.arange(len(x)), mask, radius if reach is None else reach)]
    while work:
        a, b, bits, bound = work.pop()
        if not len(a) or not len(b):
            continue
        if len(b) > LOCAL:
            v = x[b[len(b) // 2]] & bits
            dx, dq = _apart(x[b] & bits, v), _apart(q[a] & bits, v)
            mu = int(np.median(dx))
            inside, goes_in, goes_out = dx <= mu, dq <= mu + bound, dq > mu - bound
            if not inside.all() and goes_in.sum() + goes_out.sum() < 1.8 * len(a):
                work += [(a[goes_in], b[inside], bits, bound), (a[goes_out], b[~inside], bits, bound)]
                continue
            if bits != WHOLE:  # one value of the masked bits crowds this leaf: the others tell its rows apart
                work.append((a[dq <= dx.max() + bound], b, WHOLE, radius))
                continue
        for at in range(0, len(a), 256):
            for to in range(0, len(b), 8192):
                i, j = np.nonzero(_apart(q[a[at : at + 256], None], x[b[None, to : to + 8192]]) <= radius)
                if len(i):
                    yield a[at + i], b[to + j]


class Union:
    """Disjoint sets over 0..n-1; pairs come as arrays and mostly fall away before the loop."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def flatten(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.flatten()
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return
        up = self.up = root.copy()
        for p, r in np.unique(np.stack([a[differ], b[differ]], 1), axis=0).tolist():
            while up[p] != p:
                p = up[p]
            while up[r] != r:
                r = up[r]
            up[max(p, r)] = min(p, r)


def _agree(s: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Pairs whose bottom-k sketches (sorted rows, padded with the row's last value) share enough values."""
    keep = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 20_000):
        a, b = s[i[at : at + 20_000]], s[j[at : at + 20_000]]
        both = np.sort(np.concatenate([a, b], 1), axis=1)
        new = np.concatenate([np.ones((len(a), 1), bool), both[:, 1:] != both[:, :-1]], 1)
        first = new & (np.cumsum(new, 1) <= s.shape[1])  # the k least of the union
        width = first.sum(1)
        shared = np.zeros(len(a), dtype=np.int64)
        for k in range(s.shape[1]):
            fresh = np.ones(len(a), bool) if k == 0 else a[:, k] != a[:, k - 1]
            shared += fresh & (b == a[:, k : k + 1]).any(1)
        keep[at : at + 20_000] = shared >= least * np.minimum(width, s.shape[1])
    return keep


def _shard_edges(radius: int, least: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        fps = pdf["fp"].to_numpy().view(np.uint64)
        own = np.flatnonzero(pdf["own"].to_numpy())
        node = pdf["node"].to_numpy()
        sketch = np.zeros((len(pdf), SKETCH), dtype=np.uint32)
        for r, raw in enumerate(pdf["sketch"]):
            v = np.frombuffer(raw, dtype="<u4")
            sketch[r] = np.pad(v, (0, SKETCH - len(v)), mode="edge") if len(v) else 0
        sets = Union(len(pdf))
        for i, j in near_pairs(fps[own], fps, radius):
            i, root = own[i], sets.flatten()
            open_ = root[i] != root[j]
            i, j = i[open_], j[open_]
            good = _agree(sketch, i, j, least)
            sets.add(i[good], j[good])
        root = sets.flatten()
        linked = np.flatnonzero(node[root] != node)
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]]})

    return run


def _fitted(nodes: DataFrame, shard: int) -> tuple[np.ndarray, int]:
    """The sample of a tree, and its depth at which a shard owns about `shard` rows."""
    depth = max(0, math.ceil(math.log2(max(1, nodes.count()) / shard)))
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy().view(np.uint64)
    return sample, min(depth, int(math.log2(max(2, len(sample)))) - 3) if depth else 0


def _half_edges(nodes: DataFrame, radius: int, shard: int, crowd: int) -> DataFrame:
    """Star edges (a, b) among nodes (node, fp) within the radius, by one tree for each half."""
    sample, depth = _fitted(nodes, shard)
    trees = nodes.sparkSession.sparkContext.broadcast([Tree(np.unique(sample & half), max(depth, 0)) for half in HALVES])

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, half in enumerate(HALVES):
                row, leaf, own = trees.value[k].visits(fps & half, radius // 2)
                for at in range(0, len(row), 50_000):
                    part = slice(at, at + 50_000)
                    rows = batch.take(pa.array(row[part]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf[part]), pa.array(np.full(len(rows), k, dtype=np.int64)), pa.array(own[part]), rows.column("node"), rows.column("fp")],
                        names=["leaf", "band", "own", "node", "fp"],
                    )

    dealt = stored(nodes.select("node", "fp").mapInArrow(deal, "leaf bigint, band bigint, own boolean, node bigint, fp bigint"), "shards")
    blocks = _blocks(dealt.withColumn("sketch", F.lit(None).cast("binary")), crowd)
    return blocks.drop("sketch").groupBy("leaf", "band", "block").applyInPandas(_half_search(radius), "a bigint, b bigint")


def _half_search(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        fps, node = pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy()
        own = np.flatnonzero(pdf["own"].to_numpy())
        sets = Union(len(pdf))
        for i, j in near_pairs(fps[own], fps, radius, HALVES[pdf["band"].iat[0]], radius // 2):
            sets.add(own[i], j)
        root = sets.flatten()
        linked = np.flatnonzero(node[root] != node)
        return pd.DataFrame({"a": node[linked], "b": node[root[linked]]})

    return run


def link_edges(nodes: DataFrame, radius: int, least: float | None = None, shard: int = SHARD) -> DataFrame:
    """Star edges (a, b) among nodes (node, fp, band, sketch) whose fingerprints are within the radius.

    With `least`, only nodes of the same or the next band whose sketches share that part are linked.
    """
    if least is None:
        return _half_edges(nodes, radius, min(shard, HALF_SHARD), CROWD * shard // SHARD)
    sample, depth = _fitted(nodes, shard * 8)  # bands share out the rows of a shard
    tree = nodes.sparkSession.sparkContext.broadcast(Tree(sample, depth))

    def deal(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            row, leaf, own = tree.value.visits(fps, radius)
            band = batch.column("band").to_numpy(zero_copy_only=False)[row]
            # a document also visits the next longer band
            row, leaf, own, band = np.tile(row, 2), np.tile(leaf, 2), np.concatenate([own, np.zeros_like(own)]), np.concatenate([band, band + 1])
            for at in range(0, len(row), 50_000):
                part = slice(at, at + 50_000)
                rows = batch.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[part]), pa.array(band[part].astype(np.int64)), pa.array(own[part]), rows.column("node"), rows.column("fp"), rows.column("sketch")],
                    names=["leaf", "band", "own", "node", "fp", "sketch"],
                )

    dealt = nodes.select("node", "fp", "band", "sketch").mapInArrow(deal, "leaf bigint, band bigint, own boolean, node bigint, fp bigint, sketch binary")
    blocks = _blocks(stored(dealt, "shards"), shard)
    return blocks.groupBy("leaf", "band", "block").applyInPandas(_shard_edges(radius, least), "a bigint, b bigint")


def _blocks(dealt: DataFrame, shard: int) -> DataFrame:
    """Shards with more than twice `shard` rows in blocks of about that many, however crowded the shard is.

    Owned rows fall into parts that ask, all rows into parts that are asked, and a block is one part
    of either kind, so every pair of the shard still meets in one block.
    """
    crowd = dealt.groupBy("leaf", "band").agg(F.count("*").alias("all"), F.count_if("own").alias("own")).where(F.col("all") > 2 * shard)
    parts = [F.greatest(F.ceil(F.col(c) / shard), F.lit(1)).cast("int").alias(f"{c}_parts") for c in ("own", "all")]
    crowd = stored(crowd.select("leaf", "band", *parts), "crowded-shards")  # a file of known size: broadcast only where small
    marked = dealt.join(crowd, ["leaf", "band"], "left").fillna(1, ["own_parts", "all_parts"])
    asks = F.pmod(F.xxhash64("node"), F.col("own_parts")).cast("int")
    asked = F.pmod(F.xxhash64("node", F.lit(1)), F.col("all_parts")).cast("int")

    def block(ask, ask_to):
        return F.struct(ask.alias("ask"), ask_to.alias("asked"))

    as_target = F.transform(F.sequence(F.lit(0), F.col("own_parts") - 1), lambda i: block(i, asked))
    as_query = F.transform(F.sequence(F.lit(0), F.col("all_parts") - 1), lambda j: block(asks, j))
    where = F.when(F.col("own"), F.array_union(as_query, as_target)).otherwise(as_target)
    return marked.select("*", F.explode(where).alias("block")).select(
        "leaf", "band", "block", (F.col("own") & (F.col("block.ask") == asks)).alias("own"), "node", "fp", "sketch"
    )


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: the least doc_id reachable over fingerprint links."""
    seen = stored(fingerprints(docs, size).select("doc_id", "fp"), "fingerprints")
    nodes = cut_lineage(seen.groupBy("fp").agg(F.min("doc_id").alias("least")))
    plain = nodes.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("band"), F.lit(None).cast("binary").alias("sketch"))
    labels = components(link_edges(plain, radius))
    linked = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    heads = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = linked.join(heads, "label").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return seen.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def _leaders(size: int, similarity: float):
    """Rows of a bounded part that stay: in order of (doc_id, body), those not similar to one that stays."""

    def run(part: pa.Table) -> pa.Table:
        order = pc.sort_indices(part, sort_keys=[("doc_id", "ascending"), ("body", "ascending")], null_placement="at_start")
        part = part.take(order)
        heads: list[np.ndarray] = []
        lead = []
        for text in part.column("text"):
            own = np.unique(shingle_hashes(word_bytes(text.as_py()), size))
            lead.append(not any(_alike(own, head, similarity) for head in heads))
            if lead[-1]:
                heads.append(own)
        return part.filter(np.array(lead)).select(["label", "doc_id", "body", "text"])

    return run


def _strangers(size: int, similarity: float):
    """Rows of a bounded part that are similar to none of the leaders dealt to it (`lead`), by an index of the leaders' shingles."""

    def run(part: pa.Table) -> pa.Table:
        sets = [np.unique(shingle_hashes(word_bytes(t.as_py()), size)) for t in part.filter(pc.field("lead")).column("text")]
        rows = part.filter(~pc.field("lead"))
        length = np.array([len(s) for s in sets], dtype=np.int64)
        shingle = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], np.repeat(np.arange(len(sets)), length)[order]
        new = []
        for text in rows.column("text"):
            own = np.unique(shingle_hashes(word_bytes(text.as_py()), size))
            low = np.searchsorted(shingle, own)
            hits = np.searchsorted(shingle, own, "right") - low
            at = np.repeat(low - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
            common = np.bincount(owner[at], minlength=len(sets))
            new.append(not (common >= similarity * (length + len(own) - common)).any())
        return rows.filter(np.array(new, dtype=bool)).select(["label", "doc_id", "body", "text"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if similarity * max(len(a), len(b)) > min(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def _prefixes(keys: DataFrame, part: int) -> DataFrame:
    """(label, parts, end) of the groups above `part` among (label, doc_id, body): about `part` rows are not after `end`.

    The end is a low quantile of one hash part of the group, so no task sorts a whole group.
    """
    wide = keys.groupBy("label").agg(F.ceil(F.count("*") / part).cast("int").alias("parts")).where("parts > 1")
    wide = stored(wide, "group-sizes")  # a file of known size: broadcast only where small
    dealt = keys.join(wide, "label").groupBy("label", "parts", _dealt().alias("at")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "body"))).alias("all"))
    nth = F.least(F.ceil(F.lit(part) / F.col("parts")).cast("int"), F.size("all"))
    ends = dealt.select("label", "parts", "at", F.get("all", nth - 1).alias("end"))
    return stored(ends.groupBy("label", "parts").agg(F.min_by("end", "at").alias("end")), "group-ends")


def _dealt() -> Column:
    return F.pmod(F.xxhash64("doc_id", "body"), F.col("parts")).cast("int")


def _thinned(members: DataFrame, keys: DataFrame, kind: str, size: int, similarity: float, part: int) -> DataFrame:
    """(doc_id, body) of the leaders among members (label, doc_id, body, text) of the groups; `keys` are the members without text.

    One rule at every size: a row goes if it is similar to a smaller one that stays. A group of up to
    `part` rows is settled in one task. Of a larger one the first `part` rows or so, which depend on no
    later row, are settled in a task; what is similar to their leaders goes, in parts of some `part`
    rows, and the rest is a group of the next round.
    """
    columns = f"label bigint, doc_id {kind}, body bigint, text string"
    settled, left = [], members
    while True:
        ends = _prefixes(keys, part)
        wide = ends.count() > 0
        if wide:
            left = stored(left.join(ends, "label", "left"), "group-rows")
            first = F.col("end").isNull() | (F.struct("doc_id", "body") <= F.col("end"))
        heads = left.where(first) if wide else left
        heads = stored(heads.groupBy("label").applyInArrow(_leaders(size, similarity), columns), "leaders")
        settled.append(heads.select("doc_id", "body"))
        if not wide:
            break
        asked = left.where(~first).select("label", _dealt().alias("at"), "doc_id", "body", "text", F.lit(False).alias("lead"))
        told = heads.join(ends, "label").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = asked.union(told.select("label", "at", "doc_id", "body", "text", F.lit(True).alias("lead")))
        left = stored(met.groupBy("label", "at").applyInArrow(_strangers(size, similarity), columns), "followers")
        keys = left.select("label", "doc_id", "body")
        if left.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def keep_leaders(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 20, part: int = 512) -> DataFrame:
    """The documents with their own columns, one of each group of near copies.

    Groups are candidate components. Inside one, whatever its size, a document goes when its shingle
    set has the similarity with a document of smaller doc_id that stays, and only then; so the least
    doc_id of a group stays, and no two that stay have the similarity. Documents with equal words are one; the least doc_id stays. Rows with
    the same doc_id and different texts are judged apart; a NULL doc_id comes before all others.
    """
    rows = boxed(docs).withColumn("key", F.struct(F.col("row")["doc_id"].alias("doc_id"), F.xxhash64(F.col("row")["text"]).alias("body")))
    texts = rows.select(F.col("key").alias("doc_id"), F.col("row")["text"].alias("text"))
    seen = stored(fingerprints(texts, size, distinct=True).withColumnRenamed("doc_id", "key"), "fingerprints")
    # one document per word sequence, one node per look
    look = F.xxhash64("fp", "n", "sketch")
    bodies = seen.groupBy("mark", "fp", "n", "sketch").agg(F.min("key").alias("key"))
    bodies = cut_lineage(bodies.withColumn("node", look))
    band = F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / -math.log(similarity)).cast("bigint")
    nodes = bodies.groupBy("node").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("band", band)
    labels = components(link_edges(nodes, radius, least=0.5))
    grouped = bodies.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    big = grouped.groupBy("label").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(grouped.join(big, "label").select("key", "label"))

    full = texts.withColumnRenamed("doc_id", "key").join(members, "key").dropDuplicates(["key"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    stay = _thinned(full.select("label", "key.*", "text"), members.select("label", "key.*"), kind, size, similarity, part)
    stay = stay.select(F.struct("doc_id", "body").alias("key")).union(grouped.join(big, "label", "left_anti").select("key"))
    return unboxed(rows.join(stay, "key", "left_semi"), docs.columns)
