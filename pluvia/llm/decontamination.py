"""Benchmark decontamination by SimHash of item-sized windows.

A window has as many words as an item and starts at a word whose five-word shingle occurs in an
item of that size; windows with fewer such shingles than the similarity needs are left out, which
loses nothing, as their similarity is below it. Windows and items get 64-bit SimHashes of their
shingles. Cut into `RADIUS` + 1 blocks, two fingerprints within the radius agree in one block at
least, so an equi-join on (size, block, value) finds every pair within it. A pair counts when the
weighted Jaccard similarity of its shingles (each with its number of occurrences) reaches
`similarity`. DataFrame functions only.

Words are runs of letters and digits in lower case. Defined results: NULL or empty texts and items
of fewer than five words match nothing. A document shorter than an item is one window. At
similarity 0.8 fingerprints differ in about 10 of 64 bits; 15 holds all but some 3 of 100 such
pairs and practically all from 0.85 on. Rows that repeat a doc_id with the same text are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import boxed, let, null_safe, stored, unboxed
from pluvia.session import cut_lineage

SIZE, RADIUS = 5, 15
BITS = 64 // (RADIUS + 1)
KEYS = ["doc_id", "mark"]


def _shifted(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashes(w: Column, at: Column, n: Column) -> Column:
    """Hashes of the `n` shingles from word `at`."""
    part = lambda i: [F.get(w, i + j) for j in range(SIZE)]
    return F.when(n > 0, F.transform(F.sequence(at, at + n - 1), lambda i: F.xxhash64(*part(i)))).otherwise(F.array().cast("array<bigint>"))


def _shingles(w: Column, at: Column, n: Column) -> Column:
    """The shingles as text, equal ones numbered, so that sets of them are multisets."""
    part = lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(SIZE)])
    numbered = lambda s: F.transform(s, lambda x, i: F.struct(x.alias("s"), F.size(F.filter(F.slice(s, 1, i), lambda y: y == x)).alias("k")))
    return let(F.transform(F.sequence(at, at + n - 1), part), numbered)


def simhash(h: Column) -> Column:
    """A bit is 1 where over half of the hashes have it."""
    ones = lambda b: F.aggregate(h, F.lit(0), lambda a, x: a + _shifted(x, b).bitwiseAND(F.lit(1)).cast("int"))
    bits = F.transform(F.sequence(F.lit(63), F.lit(0)), lambda b: (ones(b) * 2 > F.size(h)).cast("bigint"))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))


def _blocks(fp: str) -> Column:
    """(block, value) of each of the RADIUS + 1 blocks of a fingerprint."""
    mask = F.lit((1 << BITS) - 1)
    return F.inline(F.transform(
        F.sequence(F.lit(0), F.lit(RADIUS)),
        lambda k: F.struct(k.alias("block"), _shifted(F.col(fp), k * BITS).bitwiseAND(mask).alias("value")),
    ))


def leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, mark, item_id, similarity, first_word, n_words): the best window of every document and item that match."""
    bench = items.select("item_id", plain_words(F.col("text")).alias("item_words")).withColumn("size", F.size("item_words"))
    bench = bench.where(F.col("size") >= SIZE).withColumn("item_fp", let(_hashes(F.col("item_words"), F.lit(0), F.col("size") - SIZE + 1), simhash))
    bench = stored(bench, "benchmark")
    marks = stored(
        bench.select("size", F.explode(_hashes(F.col("item_words"), F.lit(0), F.col("size") - SIZE + 1)).alias("h")).distinct(), "benchmark-shingles"
    )

    rows = boxed(docs).select(F.col("row")["doc_id"].alias("doc_id"), F.xxhash64(F.col("row")["text"]).alias("mark"), F.col("row")["text"].alias("text"))
    all_hashes = let(plain_words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), _hashes(w, F.lit(0), F.size(w) - SIZE + 1).alias("h")))
    seen = rows.select(*KEYS, all_hashes.alias("c")).select(*KEYS, F.col("c")["n"].alias("n"), F.posexplode(F.col("c")["h"]).alias("i", "h"))
    hits = seen.join(marks, "h").groupBy(*KEYS, "n", "size").agg(F.sort_array(F.collect_set("i")).alias("at"))

    # windows that start at a hit (or end with the text) and hold enough hits
    def windows(a: Column) -> Column:
        width = F.least(F.col("size"), F.col("n")) - SIZE + 1
        start = lambda p: F.greatest(F.least(p, F.col("n") - F.col("size")), F.lit(0))
        enough = lambda p, i: F.get(a, i + F.ceil((F.col("size") - SIZE + 1) * similarity).cast("int") - 1) < p + width
        return F.array_distinct(F.transform(F.filter(a, enough), start))

    placed = hits.select(*KEYS, "size", let(F.col("at"), windows).alias("starts")).where(F.size("starts") > 0)
    placed = cut_lineage(placed.groupBy(*KEYS).agg(F.collect_list(F.struct("size", "starts")).alias("places")))
    # a window keeps its own words only, not the document's
    found = null_safe(rows, placed, KEYS).dropDuplicates(KEYS)
    found = found.select(*KEYS, let(plain_words(F.col("text")), lambda w: F.flatten(F.transform(
        "places", lambda p: F.transform(p["starts"], lambda s: F.struct(p["size"].alias("size"), s.alias("first_word"), F.slice(w, s + 1, p["size"]).alias("words"))),
    ))).alias("all"))
    found = found.select(*KEYS, F.inline("all")).withColumn("n_words", F.size("words"))
    found = found.withColumn("fp", let(_hashes(F.col("words"), F.lit(0), F.col("n_words") - SIZE + 1), simhash))

    left = found.select("*", _blocks("fp"))
    pairs = left.join(bench.select("item_id", "item_words", "item_fp", "size", _blocks("item_fp")), ["size", "block", "value"])
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # a pair that agrees in several blocks is taken in the first of them
    x = F.col("fp").bitwiseXOR(F.col("item_fp"))
    pairs = pairs.where((F.col("block") == 0) | ~F.exists(
        F.sequence(F.lit(0), F.greatest(F.col("block") - 1, F.lit(0))), lambda k: _shifted(x, k * BITS).bitwiseAND(F.lit((1 << BITS) - 1)) == 0
    ))
    mine = _shingles(F.col("words"), F.lit(0), F.col("n_words") - SIZE + 1)
    theirs = _shingles(F.col("item_words"), F.lit(0), F.size("item_words") - SIZE + 1)
    score = let(F.struct(mine.alias("a"), theirs.alias("b")), lambda s: let(
        F.size(F.array_intersect(s["a"], s["b"])), lambda c: c / (F.size(s["a"]) + F.size(s["b"]) - c)
    ))
    pairs = pairs.withColumn("similarity", score).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word")))
    return pairs.groupBy(*KEYS, "item_id").agg(best.alias("b")).select(*KEYS, "item_id", "b.*")


def leak_report(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    return leaks(docs, items, similarity).drop("mark")


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The documents without those that hold a benchmark item, with their own columns."""
    rows = boxed(docs).select("row", F.col("row")["doc_id"].alias("doc_id"), F.xxhash64(F.col("row")["text"]).alias("mark"))
    bad = leaks(docs, items, similarity).select(*KEYS).distinct().withColumn("bad", F.lit(True))
    return unboxed(null_safe(rows, bad, KEYS, "left").where(F.col("bad").isNull()), docs.columns)
