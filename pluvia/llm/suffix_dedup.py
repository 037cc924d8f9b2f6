"""Suffix-array dedup by depth-limited radix sort.

A byte goes when a string of `SPAN` bytes that covers it also starts in a document with a smaller
doc_id. Suffixes are ordered through SPAN bytes only, by most-significant-digit passes of up to
eight bytes; after each pass only suffixes that still share their group stay, and the groups after the
last pass are exactly the repeated windows.

Suffixes are dealt to buckets by content first. The least hash of the 24-byte strings in a window
depends on nothing but the window, so equal windows have the same one; consecutive windows with
the same least hash travel as one string. A first exchange finds the hashes that more than one
document has; only their windows are sorted. Windows under a hash that more than `HOT` documents
share (a common passage with a different neighbourhood in each) are keyed one by one with 128 bits
and reduced to their least doc_id inside every block before they are dealt, so no task gathers the
documents of a passage.

Defined results: a NULL text is empty. A NULL doc_id counts as smaller than any other. Rows that
repeat a doc_id do not remove each other's bytes. Windows are judged on the input texts.

Memory: a worker holds one block, or one bucket of strings. A block's strings are cut from its text bucket by
bucket, and a bucket is sorted part by part. Text of a short period gives long runs of one hash; they are cut
into strings of `LONG` windows, most of them equal, so that they are sorted once as well.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.blocks import buckets, deal, merged, mix, open_block, squeeze, text_bytes, unsqueeze, write_blocks
from pluvia.llm.common import stored

SPAN, GRAM, HOT = 50, 24, 10_000
#: Bytes of a text looked at together; pieces of longer texts overlap by SPAN - 1.
PIECE = 1 << 20
#: Bytes of texts hashed together: their arrays of eight bytes a byte stay in a core's cache.
HELD = 1 << 17
#: Bytes of text in a block, about.
BLOCK = 16_000_000
#: Windows of a string at most (a hash that occurs once in its surroundings has no more than 27).
LONG = 64
#: Parts of a bucket that are sorted one by one; a string's part is kept above the SIZE_BITS bits of its size.
PARTS, SIZE_BITS = 8, 24
#: Windows whose least documents are looked up together.
STEP = 1 << 18
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _pieces(payload: bytes):
    """Lists of (row, doc_id, first byte, bytes) of about HELD bytes in all, or one of PIECE; rows count through the block."""
    row, waiting, held = 0, [], 0
    for part in open_block(payload):
        ids = part.column("doc_id")
        for k, text in enumerate(part.column("text")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            doc = ids[k].as_py()
            doc = np.iinfo(np.int64).min if doc is None else doc
            for at in range(0, max(0, len(data) - SPAN + 1), PIECE):
                waiting.append((row, doc, at, data[at : at + PIECE + SPAN - 1]))
                held += len(waiting[-1][3])
                if held >= HELD:
                    yield waiting
                    waiting, held = [], 0
            row += 1
    if waiting:
        yield waiting


def _powers(data: np.ndarray, base: int, up_to: int) -> dict[int, np.ndarray]:
    """Polynomial hashes of all strings of 1, 2, 4, ... bytes."""
    h, step, size = {1: data.astype(np.uint64) + np.uint64(1)}, np.uint64(base), 1
    with np.errstate(over="ignore"):
        while size < up_to:
            h[2 * size] = h[size][: len(h[size]) - size] * step + h[size][size:]
            step, size = step * step, 2 * size
    return h


def _power(base: int, n: int) -> np.uint64:
    return np.uint64(pow(base, n, 1 << 64))


def least_hashes(data: np.ndarray) -> np.ndarray:
    """For every window of SPAN bytes the least hash (48 bits) of its strings of GRAM bytes."""
    h = _powers(data, BASES[0], 16)
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        m = mix(h[16][:n] * _power(BASES[0], 8) + h[8][16 : 16 + n])
    for step in (1, 2, 4, 8):
        m = np.minimum(m[:-step], m[step:])
    rest = SPAN - GRAM + 1 - 16
    return np.minimum(m[: len(m) - rest], m[rest:]) >> np.uint64(16)


def window_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the windows that start at `at`."""
    out = []
    for base in BASES:
        h = _powers(data, base, 32)
        with np.errstate(over="ignore"):
            out.append(mix(h[32][at] * _power(base, 18) + h[16][at + 32] * _power(base, 2) + h[2][at + 48]))
    return out[0], out[1]


class Runs:
    """Runs of up to LONG windows with one least hash in a list of pieces: key, first window, number, piece."""

    def __init__(self, pieces: list):
        sizes = np.array([len(p[3]) for p in pieces])
        self.data = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
        self.starts = np.cumsum(sizes) - sizes
        self.rows, self.docs, self.base = (np.array([p[i] for p in pieces], dtype=np.int64) for i in range(3))
        least = least_hashes(self.data)
        # a run ends where the hash changes, a piece begins or its last window is over
        over = self.starts + sizes - SPAN + 1
        edge = np.empty(len(least) + 1, bool)
        np.not_equal(least[1:], least[:-1], out=edge[1:-1])
        edge[self.starts] = edge[over] = edge[-1] = True
        first = np.flatnonzero(edge)
        piece = np.searchsorted(self.starts, first[:-1], "right") - 1
        own = first[:-1] < over[piece]
        self.key, self.at, self.piece = least[first[:-1][own]], first[:-1][own], piece[own]
        self.n = np.diff(first)[own]
        if len(self.n) and self.n.max() > LONG:
            cut = -(-self.n // LONG)
            run = np.repeat(np.arange(len(cut)), cut)
            off = (np.arange(len(run)) - np.repeat(np.cumsum(cut) - cut, cut)) * LONG
            self.key, self.at, self.piece, self.n = self.key[run], self.at[run] + off, self.piece[run], np.minimum(self.n[run] - off, LONG)

    def place(self, pick: np.ndarray) -> np.ndarray:
        """First byte of the picked runs in their texts."""
        return self.at[pick] - self.starts[self.piece[pick]] + self.base[self.piece[pick]]

    def spread(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the picked runs' windows, and the index of their run in `pick`."""
        return _stretched(self.at[pick], self.n[pick]), np.repeat(np.arange(len(pick)), self.n[pick])


def _stretched(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of all stretches, one after the other."""
    return np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _stretches(of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first and number of the neighbours that have one `of` and follow each other by `at`."""
    head = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)))) if len(of) else np.empty(0, np.int64)
    return head, np.diff(np.append(head, len(of)))


def _due(parts: list[np.ndarray]) -> bool:
    """Merge the parts into the first when they have outgrown it."""
    return len(parts) > 1 and sum(map(len, parts[1:])) > max(1 << 20, len(parts[0]))


def _block_keys(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted least hashes of a block and how many of its rows have each."""
    keys, counts = [], []
    for pieces in _pieces(payload):
        runs = Runs(pieces)
        order = np.lexsort((runs.rows[runs.piece], runs.key))
        k, r = runs.key[order], runs.rows[runs.piece][order]
        once = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
        u, c = np.unique(k[once], return_counts=True)
        keys.append(u)
        counts.append(c)
        if _due(keys):
            u, c = merged(keys, counts)
            keys, counts = [u], [c]
    return merged(keys, counts)


def _keys_out(n: int):
    def run(frames):
        for pdf in frames:
            for block, payload in zip(pdf["block"], pdf["payload"]):
                u, c = _block_keys(payload)
                rows = [(b, block, squeeze(k, v.astype("<u4"))) for b, k, v in deal(u, n, c)]
                yield pd.DataFrame(rows, columns=["bucket", "block", "blob"])

    return run


def _flags(hot: int):
    """Per block the keys of several documents: 1, or 2 if more than `hot` have them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        u, c = np.empty(0, np.uint64), np.empty(0, np.int64)
        for at in range(0, len(pdf), 64):
            parts = [unsqueeze(b, "<u8", "<u4") for b in pdf["blob"][at : at + 64]]
            u, c = merged([u, *[p[0] for p in parts]], [c, *[p[1].astype(np.int64) for p in parts]])
        flag = (c > 1).astype(np.uint8) + (c > hot)
        blobs = []
        for b in pdf["blob"]:
            k = unsqueeze(b, "<u8")[0]
            f = flag[np.searchsorted(u, k)]
            blobs.append(squeeze(k[f > 0], f[f > 0]))
        return pd.DataFrame({"kind": 0, "bucket": pdf["bucket"], "block": pdf["block"], "blob": blobs, "data": b""})

    return run


def _flag_of(got: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that a block shares with other documents, and their flags."""
    parts = [unsqueeze(b, "<u8", "u1") for b in got["blob"]]
    u, flag = (np.concatenate([p[i] for p in parts]) for i in range(2)) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint8))
    order = np.argsort(u)
    return u[order], flag[order]


def _lookup(u: np.ndarray, flag: np.ndarray, key: np.ndarray) -> np.ndarray:
    if not len(u):
        return np.zeros(len(key), np.uint8)
    at = np.minimum(np.searchsorted(u, key), len(u) - 1)
    return np.where(u[at] == key, flag[at], 0)


def _least_windows(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((doc, b, a))
    a, b, doc = a[order], b[order], doc[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[new], b[new], doc[new]


def _hot_windows(runs: Runs, pick: np.ndarray):
    at, run = runs.spread(pick)
    a, b = window_keys(runs.data, at)
    return at, run, a, b


def _suffixes_out(wide: int):
    """Blocks and their flags -> strings of suffixes (kind 1) and single hot windows (kind 2), dealt to buckets."""

    def run(blocks: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for block, payload in zip(blocks["block"], blocks["payload"]):
            u, flag = _flag_of(got)
            if not len(u):
                continue
            text, parts, hot = bytearray(), [], []
            for pieces in _pieces(payload):
                runs = Runs(pieces)
                of = _lookup(u, flag, runs.key)
                pick = np.flatnonzero(of == 1)
                if len(pick):
                    own = runs.piece[pick]
                    places = (runs.rows[own], runs.place(pick), runs.n[pick] + SPAN - 1, runs.at[pick] + len(text))
                    parts.append((runs.key[pick], runs.docs[own], *(x.astype("<u4") for x in places)))
                    text += runs.data.data
                pick = np.flatnonzero(of == 2)
                if len(pick):
                    _, r, a, b = _hot_windows(runs, pick)
                    hot.append(_least_windows(a, b, runs.docs[runs.piece[pick]][r]))
                if _due([h[0] for h in hot]):
                    hot = [_least_windows(*(np.concatenate(x) for x in zip(*hot)))]
            if parts:
                key, doc, row, place, size, begin = (np.concatenate(x) for x in zip(*parts))
                text, parts = np.frombuffer(text, np.uint8), []
                to = mix(key) % np.uint64(PARTS * wide)
                order = np.lexsort((key, to))
                cuts = np.searchsorted(to[order], np.arange(wide + 1, dtype=np.uint64) * np.uint64(PARTS))
                for b in range(wide):
                    p = order[cuts[b] : cuts[b + 1]]
                    if len(p):
                        part = (to[p] % np.uint64(PARTS)).astype("<u4") << np.uint32(SIZE_BITS)
                        meta = squeeze(doc[p], row[p], place[p], size[p] | part)
                        data = text[_stretched(begin[p].astype(np.int64), size[p].astype(np.int64))]
                        rows.append((1, b, block, meta, pa.compress(data, "zstd", asbytes=True)))
            if hot:
                a, b, doc = _least_windows(*(np.concatenate(x) for x in zip(*hot)))
                rows += [(2, k, block, squeeze(x, y, z), b"") for k, x, y, z in deal(a, wide, b, doc)]
        return pd.DataFrame(rows, columns=["kind", "bucket", "block", "blob", "data"])

    return run


def radix_groups(data: np.ndarray, start: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first `span` bytes with another, ordered, and their group numbers.

    Most significant digit first; suffixes alone in their group drop out after each pass. The first digit
    has eight bytes, the later ones as many as fit into one sort key beside the number of the group.
    """
    value = data.astype(np.uint64)
    for size in (1, 2, 4):  # eight bytes from each position as one digit
        value = (value[: len(value) - size] << np.uint64(8 * size)) | value[size:]
    rows, group, at = np.arange(len(start)), np.zeros(len(start), np.uint64), 0
    while at < span and len(rows):
        taken = int(group[-1]).bit_length()
        wide = min((64 - taken) // 8, span - at)
        # the digit's bytes may lie at the end of the eight read before it, where the text ends
        back = max(0, at + 8 - span)
        key = value[start[rows] + (at - back)] << np.uint64(8 * back) >> np.uint64(64 - 8 * wide)
        if at:
            key |= group << np.uint64(8 * wide)
        order = np.argsort(key)
        rows, key = rows[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        alone = new & np.append(new[1:], True)
        group = (np.cumsum(new) - 1).astype(np.uint64)[~alone]
        rows = rows[~alone]
        at += wide
    return rows, group


def _covered(data: bytes, begin: np.ndarray, size: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that smaller documents have, too: index of their string, first window, number."""
    # equal strings are sorted once, for the least of their documents
    known = {}
    same = np.array([known.setdefault(data[at:to], len(known)) for at, to in zip(begin.tolist(), (begin + size).tolist())])
    windows = np.fromiter(map(len, known), np.int64, len(known)) - SPAN + 1
    text, known = np.frombuffer(b"".join(known), np.uint8), None
    least = np.full(len(windows), np.iinfo(np.int64).max)
    np.minimum.at(least, same, doc)
    place_of = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(windows)), windows)
    least = least[of]
    rows, group = radix_groups(text, np.arange(len(of)) + of * (SPAN - 1))
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        least[rows] = np.repeat(np.minimum.reduceat(least[rows], first), np.diff(np.append(first, len(rows))))
    del of, rows, group
    out, windows = [], size - SPAN + 1
    total = np.cumsum(windows)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] - windows[at] + STEP, "right")))
        n = windows[at:to]
        of = np.repeat(np.arange(at, to), n)
        within = _stretched(np.zeros(len(n), np.int64), n)
        hit = np.flatnonzero(doc[of] > least[place_of[same[of]] + within])
        of, within = of[hit], within[hit]
        head, n = _stretches(of, within)
        out.append((of[head], within[head], n))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out))


def _covers(kind_rows: pd.DataFrame) -> pd.DataFrame:
    """Bucket of suffix strings -> per block the covered stretches (row, first byte, bytes); hot windows -> least doc_id."""
    out = []
    strings, hot = kind_rows[kind_rows["kind"] == 1], kind_rows[kind_rows["kind"] == 2]
    if len(strings):
        parts = [unsqueeze(b, "<i8", "<u4", "<u4", "<u4") for b in strings["blob"]]
        block = np.repeat(strings["block"].to_numpy(), [len(p[0]) for p in parts])
        doc, row, place, size = (np.concatenate([p[i] for p in parts]) for i in range(4))
        part, size = size >> np.uint32(SIZE_BITS), (size & np.uint32((1 << SIZE_BITS) - 1)).astype(np.int64)
        ends = np.cumsum(size)
        last = ends[np.cumsum([len(p[0]) for p in parts]) - 1]
        data = b"".join(pa.decompress(d, int(n), "zstd", asbytes=True) for d, n in zip(strings["data"], np.diff(last, prepend=0)))
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(PARTS + 1))
        found = []
        for own in (order[cuts[k] : cuts[k + 1]] for k in range(PARTS)):
            if len(own):
                of, first, n = _covered(data, ends[own] - size[own], size[own], doc[own])
                found.append((own[of], first, n))
        of, first, n = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(block[of], kind="stable")
        of, first, n = of[by], first[by], n[by]
        start = np.flatnonzero(np.diff(block[of], prepend=block[of[:1]] - 1)) if len(of) else of
        for at, to in zip(start, np.append(start[1:], len(of))):
            r = of[at:to]
            out.append((1, block[r[0]], squeeze(row[r], (place[r] + first[at:to]).astype("<u4"), (n[at:to] + SPAN - 1).astype("<u4"))))
    if len(hot):
        parts = [unsqueeze(b, "<u8", "<u8", "<i8") for b in hot["blob"]]
        a, b, doc = _least_windows(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        for block, (x, y, _) in zip(hot["block"], parts):
            first = np.searchsorted(a, x)
            while True:  # equal first halves: step to the second half
                off = b[first] != y
                if not off.any():
                    break
                first = first + off
            out.append((2, block, squeeze(x, y, doc[first])))
    return pd.DataFrame([(k, 0, b, blob, b"") for k, b, blob in out], columns=["kind", "bucket", "block", "blob", "data"])


def _removed(blocks: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
    out = []
    for payload in blocks["payload"]:
        cover = [unsqueeze(b, "<u4", "<u4", "<u4") for b in got.loc[got["kind"] == 1, "blob"]]
        row, start, size = [np.concatenate([c[i] for c in cover]).astype(np.int64) if cover else np.empty(0, np.int64) for i in range(3)]
        minima = [unsqueeze(b, "<u8", "<u8", "<i8") for b in got.loc[got["kind"] == 2, "blob"]]
        if minima:
            a, b, least = _least_windows(*(np.concatenate([m[i] for m in minima]) for i in range(3)))
            u, flag = _flag_of(got[got["kind"] == 0])
            u, flag = u[flag == 2], flag[flag == 2]
            more = []
            for pieces in _pieces(payload):
                runs = Runs(pieces)
                pick = np.flatnonzero(_lookup(u, flag, runs.key) == 2)
                if len(pick):
                    at, r, x, y = _hot_windows(runs, pick)
                    first = np.searchsorted(a, x)
                    while (b[first] != y).any():
                        first = first + (b[first] != y)
                    own = runs.piece[pick][r]
                    hit = runs.docs[own] > least[first]
                    of, where = runs.rows[own][hit], (at - runs.starts[own] + runs.base[own])[hit]
                    head, n = _stretches(of, where)
                    more.append((of[head], where[head], n + SPAN - 1))
            if more:
                row, start, size = (np.concatenate([old, *[m[i] for m in more]]) for i, old in enumerate((row, start, size)))
        order = np.argsort(row, kind="stable")
        row, start, size = row[order], start[order], size[order]
        r = 0
        for part in open_block(payload):
            for k, text in enumerate(part.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                lo, hi = np.searchsorted(row, [r, r + 1])
                spans, kept = [], data
                if hi > lo:
                    step = np.bincount(start[lo:hi], minlength=len(data) + 1) - np.bincount(start[lo:hi] + size[lo:hi], minlength=len(data) + 1)
                    gone = np.cumsum(step)[:-1] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    spans = [{"start": int(s), "length": int(e - s)} for s, e in zip(edge[::2], edge[1::2])]
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                out.append((part.column("doc_id")[k].as_py(), len(data), spans, kept))
                r += 1
    return pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])


def suffix_dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed stretches and the bytes that stay, per document."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = buckets(text_bytes(docs))
    blocks = write_blocks(docs, BLOCK)
    keys = blocks.mapInPandas(_keys_out(n), "bucket bigint, block bigint, blob binary")
    fields = "kind int, bucket bigint, block bigint, blob binary, data binary"
    flags = stored(keys.groupBy("bucket").applyInPandas(_flags(hot), fields), "flags")
    dealt = blocks.groupBy("block").cogroup(flags.groupBy("block")).applyInPandas(_suffixes_out(4 * n), fields)
    covers = dealt.groupBy("bucket").applyInPandas(_covers, fields)
    got = flags.union(covers)
    return blocks.groupBy("block").cogroup(got.groupBy("block")).applyInPandas(
        _removed, f"doc_id {kind}, n_bytes bigint, spans array<struct<start:bigint,length:bigint>>, kept binary"
    )


def suffix_dedup_report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    lengths = F.transform("spans", lambda s: s["length"])
    return suffix_dedup(docs, hot).select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
