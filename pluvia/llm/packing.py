"""Packing by minimum bin slack.

A document is its token ids and an end id, cut into whole windows and a remainder. Pieces are
dealt to shards of about `SHARD_TOKENS` tokens by a hash; within a shard, each window starts with
the longest piece that remains, and subset sums over the multiset of remaining lengths, kept as
the bits of one integer, give the fill closest to the capacity; the steps are walked backwards for
the counts used. Only lengths take part: ids are turned into checksums where they are made.

Defined results: a NULL or empty text is the end id alone. Repeated rows are packed each for
itself. An empty table gives no rows. A shard leaves a few windows unfilled at its end, so the
padding is about one window in a thousand.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import stored

WINDOW, END, SHARD_TOKENS = 2048, 1, 4_000_000
#: Words a Python worker remembers; a fuller memory is emptied.
REMEMBERED = 1_500_000
#: Fixed value: the code points with the Unicode property White_Space. Arrow's split also takes \x1c-\x1f.
WHITE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile("[\x1c-\x1f]")
_encoders: dict[str, "WordEncoder"] = {}


class Store:
    """Ids by name, one after the other in an array that grows."""

    def __init__(self):
        self.slot: dict[str, int] = {}
        self.ids, self.ends = np.zeros(1 << 20, dtype=np.uint32), np.zeros(1 << 18, dtype=np.int64)

    def add(self, names: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.slot)
        base = int(self.ends[n - 1]) if n else 0
        while base + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(names) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[base : base + len(flat)] = flat
        self.ends[n : n + len(names)] = base + np.cumsum(sizes)
        self.slot.update(zip(names, range(n, n + len(names))))

    def take(self, slots: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the names slots[code] after each other, and where each name's ids end."""
        starts = np.where(slots > 0, self.ends[slots - 1], 0)
        sizes = (self.ends[slots] - starts)[code]
        after = np.cumsum(sizes)
        return self.ids[np.repeat(starts[code] - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)], after


class WordEncoder:
    """Ids of texts by way of their words: this tokenizer's rules never look across white space.

    New words are encoded many at a time, joined by blanks. Where one ends is seen from the marks of
    ended pieces in the vocabulary, of which a word has as many as the tokenizer's own pattern finds
    pieces in it; ASCII words are put together from the pieces, which many words share.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        suffix, steps = rules["model"].get("end_of_word_suffix"), (rules.get("pre_tokenizer") or {}).get("pretokenizers", [])
        patterns = [x["pattern"]["Regex"] for x in steps if x["type"] == "Split" and "Regex" in x["pattern"]]
        self.pieces = regex.compile(patterns[0]) if suffix and len(patterns) == 1 else None
        self.special = regex.compile("|".join([regex.escape(x["content"]) for x in rules["added_tokens"]] or ["(?!)"]))
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        self.words, self.units = Store(), Store()

    def _single(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *found]), np.array([len(x) for x in found], dtype=np.int64)

    def _joined(self, texts: list[str], pieces: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts and their numbers; `pieces` says of how many pieces each text is."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(texts), 512):
            some, upto = texts[at : at + 512], np.cumsum(pieces[at : at + 512])
            flat, _ = self._single([" ".join(some)])
            closed = np.concatenate(([0], np.flatnonzero(self.closes[flat]) + 1))
            if len(closed) != upto[-1] + 1 or closed[-1] != len(flat):
                flat, size = self._single(some)  # a rule that is not seen in the pattern: one by one
            else:
                size = np.diff(closed[upto], prepend=0)
            ids.append(flat)
            sizes.append(size)
        return np.concatenate(ids), np.concatenate(sizes)

    def _word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = " ".join(words)
        plain = self.tokenizer.normalizer.normalize_str(whole).split(" ") if self.pieces and self.tokenizer.normalizer else words
        if self.pieces is None or len(plain) != len(words) or self.special.search(whole):
            return self._single(words)
        units, counts, wide = [], [], {}
        for word, normal in zip(words, plain):
            parts = self.pieces.findall(normal)
            if not word.isascii():  # pieces that would change if they were normalised again stay together
                wide[word] = len(parts)
                parts = [word]
            units += parts
            counts.append(len(parts))
        fresh = [u for u in dict.fromkeys(units) if u not in self.units.slot]
        self.units.add(fresh, *self._joined(fresh, [wide.get(u, 1) for u in fresh]))
        slots = np.fromiter(map(self.units.slot.__getitem__, units), np.int64, len(units))
        flat, after = self.units.take(slots, np.arange(len(slots)))
        upto = np.concatenate(([0], after))[np.cumsum(counts)]
        return flat, np.diff(upto, prepend=0)

    def learn(self, new: list[str]) -> None:
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.words.add(part, *self._word_ids(part))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        flat, ends = self.coded(pa.array(texts, pa.string()))
        return np.split(flat, ends[:-1])

    def coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no NULLs) after each other, and where each text's ids end.

        Words are split and coded by Arrow; Python sees the distinct ones only.
        """
        split = pc.utf8_split_whitespace(texts)
        if pc.any(pc.match_substring_regex(texts, ODD.pattern)).as_py():
            split = pa.array([WHITE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.words.slot) > REMEMBERED:
            self.clear()
        known = self.words.slot
        found = list(map(known.get, words))
        self.learn([w for w, at in zip(words, found) if at is None])
        slots = np.array([known[w] if at is None else at for w, at in zip(words, found)], dtype=np.int64)
        flat, after = self.words.take(slots, coded.indices.to_numpy())
        return flat, np.concatenate(([0], after))[np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))]


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): whole windows of each document and its remainder."""

    def run(batches):
        encoder, closing = _encoder(path), np.array([end], dtype="<u4")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                row, start, length, crc, total = [], [], [], [], []
                flat, ends = encoder.coded(pc.fill_null(part.column(1), ""))
                flat, last = flat.astype("<u4"), 0
                for k, upto in enumerate(ends.tolist()):
                    n, ids = upto - last + 1, flat[last:upto]
                    last = upto
                    for a in range(0, n, window):
                        found = zlib.crc32(ids[a : a + window])
                        row.append(k)
                        start.append(a)
                        length.append(min(window, n - a))
                        crc.append(zlib.crc32(closing, found) if a + window >= n else found)
                        total.append(n)
                if row:
                    ids_of = part.column(0).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([ids_of, *[pa.array(x, pa.int64()) for x in (start, length, crc, total)]], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths, out of those at hand, whose sum is the largest that fits into `room`."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= length * take
    return used


def pack(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of every piece."""
    waiting: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        waiting.setdefault(n, []).append(i)
    number, offset, at = [0] * len(lengths), [0] * len(lengths), 0
    counts = {n: len(rows) for n, rows in waiting.items()}
    while counts:
        longest = max(counts)
        filling, chosen = 0, {longest: 1}
        counts[longest] -= 1
        for n, k in fullest({n: k for n, k in counts.items() if k}, window - longest).items() if longest < window else ():
            chosen[n] = chosen.get(n, 0) + k
            counts[n] -= k
        for n, k in chosen.items():
            for _ in range(k):
                i = waiting[n].pop()
                number[i], offset[i] = at, filling
                filling += n
            if not counts[n]:
                del counts[n]
        at += 1
    return number, offset


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Every piece with its sequence and offset."""
    pieces = stored(token_pieces(docs, path, window, end), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable")
        number, offset = pack(pdf["length"].tolist(), window)
        pdf["sequence_id"] = pdf["shard"].to_numpy() * (1 << 32) + np.array(number, dtype=np.int64)
        pdf["offset"] = np.array(offset, dtype=np.int64)
        return pdf.drop(columns="shard")

    shard = F.pmod(F.xxhash64("doc_id", "start"), F.lit(shards)).alias("shard")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return pieces.select("*", shard).groupBy("shard").applyInPandas(run, fields)
