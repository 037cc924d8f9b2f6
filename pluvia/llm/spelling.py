"""Spelling variants by blocked Gram matrices.

A word's letters are counted; words one edit apart differ by at most two in squared distance of these
counts (replaced letter: 2, inserted or deleted letter: 1). Blocks hold the words of one length and one
vector of counts over a few groups of letters. An edit moves a word to the same or an adjacent block
(one group up, one down, or both), so every near pair meets in one of them, and other blocks are never
compared. Inside a block numpy products of count matrices (Gram matrices) give all squared distances
of a slice of words and its adjacent slices; pairs of at most two are verified letter by letter.

A block is one task's work as long as its words have at most `TILE` letters in all. Larger ones are dealt
to pieces, and each pair of pieces meets in a task of its own, so no task holds a block of any size.
Per task and word only the count of near words and the best of them leave; pairs are never written.

Defined results: a NULL text has no words, a NULL doc_id counts as ''. Rows that repeat a doc_id are read
once each. Without any word that is frequent enough the result is empty. Letters outside A-Z keep their case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import stored

#: Fixed value: maximal runs of these characters are words.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: All letters a word can have, frequent ones of European languages first, so that groups of letters fill evenly.
LETTERS = "enthiaroslcdugbmzywxvqpfkj" + "".join(chr(c) for c in range(0xC0, 0x100))
#: One of so many occurrences is misspelt on purpose (0: none), as the query's contract says.
NOISE = 97
#: Letters of the words that one task compares.
TILE = 1_000_000
#: Candidate letters that are verified at once.
CHECK = 4_000_000
#: What a task returns of a word: its near words, and the most frequent of them.
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; `lower` does the same, faster, where all is ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, noise: int = NOISE) -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), F.lit(0))).alias("run"),
    ).select("id", lower_ascii(F.col("run")).alias("word"))
    if noise:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.expr("substring(word, 1, cast(h % length(word) as int))"), F.substring("word", at + 2, 2**31 - 1))
        runs = runs.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
    found = runs.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n"))
    return found.where(F.col("n") >= min_count)


def letter_groups(n: int) -> list[str]:
    """`n` groups of letters, dealt back and forth by frequency."""
    groups = [""] * n
    for place, letter in enumerate(LETTERS):
        at = place % (2 * n)
        groups[at if at < n else 2 * n - 1 - at] += letter
    return groups


def block_groups(n_words: int) -> int:
    """Groups of letters that part blocks: 4 up to ten million words, two more for each further digit."""
    return 4 + 2 * max(0, len(str(n_words)) - 8)


def _blocks(groups: int) -> Column:
    """Keys of a word's own block and of those it visits: in an unordered pair of adjacent blocks one visits the other."""
    counts = [F.length("word") - F.length(F.translate("word", letters, "")) for letters in letter_groups(groups)]

    def key(length: Column, v: list[Column]) -> Column:
        return F.concat_ws(".", *[x.cast("string") for x in [length, *v]])

    def moved(v: list[Column], **by: int) -> list[Column]:
        return [x + by.get(f"g{i}", 0) for i, x in enumerate(v)]

    keys = [key(F.length("word"), counts)]
    for i in range(groups):
        down = {f"g{i}": -1}
        keys += [F.when(counts[i] > 0, key(F.length("word"), moved(counts, **down, **{f"g{j}": 1}))) for j in range(i + 1, groups)]
        keys.append(F.when(counts[i] > 0, key(F.length("word") - 1, moved(counts, **down))))
    return F.array(*keys)


def _dealt(words: DataFrame, groups: int, tile: int) -> DataFrame:
    """(block, low, high, own, side, word, n): a task's rows are those of one block and pair of pieces."""
    visits = words.select("word", "n", F.posexplode(_blocks(groups)).alias("place", "block")).where("block is not null")
    sizes = visits.groupBy("block").agg(F.ceil(F.sum(F.length("word")) / F.lit(tile)).cast("int").alias("pieces"))
    crowded = stored(sizes.where("pieces > 1"), "spelling-crowded")
    rows = visits.join(crowded, "block", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    return rows.select(
        "block", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"),
        (F.col("place") == 0).alias("own"), (F.col("piece") > F.col("other")).alias("side"), "word", "n",
    )


def _one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of letter codes: is the second row one edit from the first, which is as long or shorter by one?"""
    width = short.shape[1]
    if long.shape[1] == width:
        return (short != long).sum(axis=1) == 1
    front = np.cumprod(short == long[:, :width], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    back = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return front + back >= width


class Tile:
    """The words of one task: `home` rows are those of the block itself, all others visit it."""

    def __init__(self, words: np.ndarray, own: np.ndarray, side: np.ndarray):
        self.size = np.char.str_len(words)
        self.width = int(self.size.min())
        self.codes = words.view(np.uint32).reshape(len(words), -1)
        self.own, self.side, self.crossed = own, side, bool(side.any())
        letters, at = np.unique(self.codes, return_inverse=True)
        at = at.reshape(self.codes.shape)
        flat = at + np.arange(len(words))[:, None] * len(letters)
        counts = np.bincount(flat.ravel(), minlength=len(words) * len(letters)).reshape(len(words), -1)
        counts = counts[:, letters != 0].astype(np.float32)
        letters = letters[letters != 0]
        half = (counts * counts).sum(axis=1, keepdims=True) / 2
        one = np.ones_like(half)
        # the product of a left and a right row is minus half their squared distance
        self.left, self.right = np.hstack([counts, -half, one]), np.hstack([counts, one, -half])
        self._slices(counts, letters)

    def _slices(self, counts: np.ndarray, letters: np.ndarray, groups: int = 10) -> None:
        """Sorts rows by a linear hash of counts over more groups, in which adjacent slices lie at known offsets."""
        marks = np.random.default_rng(11).integers(1, 2**62, groups, dtype=np.uint64)
        group = {ord(c): g for g, members in enumerate(letter_groups(groups)) for c in members}
        of = np.array([group[int(c)] for c in letters], dtype=np.int64)
        grouped = np.zeros((len(counts), groups), dtype=np.uint64)
        for g in range(groups):
            grouped[:, g] = counts[:, of == g].sum(axis=1).astype(np.uint64)
        self.key = (grouped * marks).sum(axis=1, dtype=np.uint64)
        swap = [0, *[int(a) - int(b) for a in marks for b in marks if a != b]]
        self.offsets = [np.array([x % 2**64 for x in swap], dtype=np.uint64), marks]

    def pairs(self):
        """Arrays (home row, other row) of candidates at squared distance two or less."""
        home = np.flatnonzero(self.own & (self.size == self.width))
        home = home[np.argsort(self.key[home], kind="stable")]
        for extra in (0, 1):
            rest = np.flatnonzero(self.size == self.width + extra)
            if not len(home) or not len(rest):
                continue
            rest = rest[np.argsort(self.key[rest], kind="stable")]
            keys, starts = np.unique(self.key[home], return_index=True)
            wanted = keys[:, None] + self.offsets[extra][None, :]
            low, high = (np.searchsorted(self.key[rest], wanted, side=s) for s in ("left", "right"))
            right = self.right[rest]
            for b, (start, end) in enumerate(zip(starts, [*starts[1:], len(home)])):
                at = [np.arange(x, y) for x, y in zip(low[b], high[b]) if y > x]
                if not at:
                    continue
                at = np.unique(np.concatenate(at))
                # a slice of the product at a time, however many words share a slice
                for first in range(start, end, 1024):
                    rows = home[first : min(first + 1024, end)]
                    for other in range(0, len(at), 4096):
                        near = self.left[rows] @ right[at[other : other + 4096]].T >= -1.25
                        i, j = np.nonzero(near)
                        yield rows[i], rest[at[other : other + 4096][j]]

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Verified pairs (row, near row), home-home pairs in both directions, others once from the home row."""
        out_i, out_j = [], []
        for i, j in self._gathered():
            different = i != j
            if self.crossed:  # words of one piece meet in the task of that piece alone
                different &= self.side[i] != self.side[j]
            i, j = i[different], j[different]
            for extra in (0, 1):
                pick = self.size[j] == self.width + extra
                a, b = i[pick], j[pick]
                ok = _one_edit(self.codes[a, : self.width], self.codes[b, : self.width + extra])
                out_i.append(a[ok])
                out_j.append(b[ok])
        return np.concatenate(out_i or [np.empty(0, np.int64)]), np.concatenate(out_j or [np.empty(0, np.int64)])

    def _gathered(self):
        """Candidates in batches of about CHECK letters."""
        held, n, most = [], 0, max(1, CHECK // max(1, self.width))
        for i, j in self.pairs():
            for at in range(0, len(i), most):
                held.append((i[at : at + most], j[at : at + most]))
                n += len(held[-1][0])
                if n >= most:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, n = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held))


def near_in_tile(words: np.ndarray, n: np.ndarray, own: np.ndarray, side: np.ndarray) -> pa.Table:
    """(word, n_near, best, best_n) of one task's rows. `side` tells the pieces of a pair of different pieces apart."""
    tile = Tile(words, own, side)
    i, j = tile.near()
    visitor = ~tile.own[j]
    i, j = np.concatenate([i, j[visitor]]), np.concatenate([j, i[visitor]])
    place = np.empty(len(words), dtype=np.int64)
    place[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((place[j], -n[j], i))
    i, j = i[order], j[order]
    rows, first, count = np.unique(i, return_index=True, return_counts=True)
    return pa.table([pa.array(words[rows], pa.string()), count, pa.array(words[j[first]], pa.string()), n[j[first]]], schema=NEAR)


def _compared(rows: pa.Table) -> pa.Table:
    own, side, n = (rows[c].to_numpy(zero_copy_only=False) for c in ("own", "side", "n"))
    if len(rows) < 2 or not own.any():
        return NEAR.empty_table()
    return near_in_tile(np.array(rows["word"].to_pylist()), n, own, side)


def near_words(words: DataFrame, tile: int = TILE, groups: int | None = None) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near word: their number and the most frequent one."""
    dealt = _dealt(words, groups or block_groups(words.count()), tile)
    found = dealt.groupBy("block", "low", "high").applyInArrow(_compared, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    both = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return both.select("word", "n_near", F.col("b")["word"].alias("best"), (-F.col("b")["n"]).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling over (word, form): each round doubles the steps of a chain, and words
    that have arrived take no part in further joins. A form is at least twice as frequent as its word, so a
    chain ends after at most 63 steps and six rounds."""
    state = stored(forms.select("word", F.col("form").alias("up"), F.lit(True).alias("open")), "spelling-forms")
    while state.where("open").limit(1).count():
        ahead = state.select(F.col("word").alias("at"), F.col("up").alias("next"))
        moving = state.where("open").join(ahead, F.col("up") == F.col("at"), "left")
        moving = moving.select("word", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("open"))
        state = stored(state.where("not open").unionByName(moving), "spelling-roots")
    return state.select("word", F.col("up").alias("root"))


def spelling_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, noise: int = NOISE, ratio: int = 2) -> DataFrame:
    """One row per word: its occurrences, near words, the form it is a variant of, and that chain's last form."""
    words = stored(vocabulary(docs, min_length, min_count, noise), "spelling-words")
    near = words.join(near_words(words), "word", "left")
    has_form = F.col("best_n") >= ratio * F.col("n")
    near = stored(near.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has_form, F.col("best")).alias("form"), F.when(has_form, F.col("best_n")).alias("form_n"),
    ), "spelling-near")
    roots = _roots(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
WITH RECURSIVE bits(b, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
t AS (SELECT b, c FROM bits WHERE k = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
                translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
d AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
z(k, b, c) AS (SELECT 0, b, c FROM t UNION ALL
  SELECT z.k + 1, z.b, xor(z.c >> 8, t.c) FROM z JOIN t ON t.b = z.c & 255 WHERE z.k < (SELECT max(len(x)) // 2 FROM d)),
s(k, c) AS (SELECT 0, 4294967295 UNION ALL
  SELECT s.k + 1, xor(s.c >> 8, t.c) FROM s JOIN t ON t.b = s.c & 255 WHERE s.k < (SELECT max(len(x)) // 2 FROM d)),
y AS (SELECT x, len(x) // 2 AS m, unnest(range(len(x) // 2)) AS i FROM (SELECT DISTINCT x FROM d)),
l AS (SELECT y.x, any_value(y.m) AS m, bit_xor(z.c) AS c FROM y JOIN z ON z.k = y.m - 1 - y.i AND z.b = CAST('0x' || substr(y.x, 2 * y.i + 1, 2) AS BIGINT) GROUP BY y.x),
h AS (SELECT l.x, xor(xor(l.c, s.c), 4294967295) AS h FROM l JOIN s ON s.k = l.m),
w AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM d JOIN h USING (x)),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
g AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM v, LATERAL (SELECT unnest(range(length(word))) AS i)),
p AS (SELECT a.word, b.word AS near FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT g.word, v.word FROM g JOIN v ON v.word = g.rest UNION SELECT v.word, g.word FROM g JOIN v ON v.word = g.rest),
q AS (SELECT p.word, p.near, v.n, count(*) OVER (PARTITION BY p.word) AS n_near,
             row_number() OVER (PARTITION BY p.word ORDER BY v.n DESC, p.near) AS place FROM p JOIN v ON v.word = p.near),
f AS (SELECT v.word, v.n, coalesce(q.n_near, 0) AS n_near, CASE WHEN q.n >= 2 * v.n THEN q.near END AS form,
             CASE WHEN q.n >= 2 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON q.word = v.word AND q.place = 1),
c(word, root) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM f JOIN c USING (word) JOIN f AS e ON e.word = c.root WHERE e.form IS NULL"""
