"""Source divergence audit by ranking count cells.

A term's value f depends on nothing but its count in the group and its count in what the group is held
against, so f is evaluated per cell (group count, language count), not per term. Cells of equal value
are merged, values are ranked by the cumulative number of terms in them, and only the values that reach
the wanted ranks are expanded to terms in UTF-8 order. Each value has a term or more, so the best `top`
values of a group are enough, and of each cell no more than its first `top` terms can get a rank: both
limits are taken per task before anything meets, and no group of any size is gathered.

For pairs of sources terms with the same counts in all sources are one cell with a multiplicity. Tasks
hold some cells of a language and the totals of its sources, and return one sum per pair.

All arithmetic is on integers: products that could pass 64 bits are divided in two steps.

Defined results: NULL text, lang and source count as ''. Each row is a document of its own, also where
it repeats a doc_id. A group without any term takes part with counts of zero; a language with one source
has no pairs, and one without kept terms has values of 0 and no terms. No documents give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pluvia.llm.common import stored
from pluvia.llm.spelling import LOWER, UPPER

#: Terms are maximal runs of ASCII letters and bytes beyond ASCII: A-Z to lower case, other ASCII to blanks.
SEPARATED = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not 97 <= b <= 122 else b for b in range(256))
#: Bytes of a text that are split at once, and the terms that a task holds before it hands them on.
PIECE, HELD = 1 << 20, 500_000
BILLION = 1_000_000_000
GROUP = ["lang", "source"]
#: Cells a task holds: as many as a task returns sums, between these bounds. Evaluations it makes at once.
PART, EVALUATED = (5_000, 100_000), 2_000_000
PAIR = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _keys() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]


def _words(text: bytes):
    """Lists of the terms of a text, a piece at a time; pieces end where a term does."""
    text = text.translate(SEPARATED)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, c, docs) of a task's documents; what it holds is handed on before it gets large."""
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def handed_on():
        for (lang, source), (counts, docs) in held.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            n = pa.array(list(counts.values()), pa.int64())
            columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, terms, n, pa.array([docs[t] for t in counts], pa.int64())], names=["lang", "source", "term", "c", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        langs, sources = (batch.column(i).to_pylist() for i in range(2))
        for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary())):
            counts, docs = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(counts)
            seen = set()
            for words in _words(text.as_py()):
                counts.update(words)
                seen.update(words)
            docs.update(seen)
            size += len(counts)
            if size > HELD:
                yield from handed_on()
                size = 0
    yield from handed_on()


def term_counts(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term, n, by): kept terms with their count in the language and a sorted array (source, c) of the counts in its sources."""
    texts = docs.select(*_keys(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = texts.mapInArrow(_count_terms, "lang string, source string, term string, c bigint, docs bigint")
    counts = rows.groupBy(*GROUP, "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))
    by = F.sort_array(F.collect_list(F.struct("source", "c"))).alias("by")
    kept = counts.groupBy("lang", "term").agg(F.sum("c").alias("n"), F.sum("docs").alias("docs"), by)
    return kept.where(F.col("docs") >= min_docs).select("lang", "term", "n", "by")


def group_totals(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kept): occurrences of kept terms per group and language, and the number of kept terms."""
    groups = docs.select(*_keys()).distinct()
    total = terms.select("lang", F.inline("by")).groupBy(*GROUP).agg(F.sum("c").alias("total"))
    kept = terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    none = F.lit(0).cast("bigint")
    out = groups.join(total, GROUP, "left").join(kept, "lang", "left")
    return out.select(*GROUP, *[F.coalesce(c, none).alias(c) for c in ("total", "lang_total", "kept")])


def top_terms(terms: DataFrame, totals: DataFrame, top: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): the terms a group uses more than its language, best values first."""
    rows = terms.select("lang", "term", "n", F.inline("by"))
    cells = rows.groupBy(*GROUP, "c", "n").agg(F.count("*").alias("members")).join(totals, GROUP)
    p = F.expr(f"1 + (cast(c + 1 as decimal(38,0)) * {BILLION}) div (total + kept)")
    q = F.expr(f"1 + (cast(n + 1 as decimal(38,0)) * {BILLION}) div (lang_total + kept)")
    cells = cells.withColumns({"p": p, "q": q}).where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div q"))
    cells = stored(cells.select(*GROUP, "c", "n", "members", "value"), "divergence-cells")
    # the first `top` values of a group, and the ranks before each
    values = cells.groupBy(*GROUP, "value").agg(F.sum("members").alias("members"))
    best = W.partitionBy(*GROUP).orderBy(F.desc("value"))
    values = values.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("members").over(best.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    values = values.withColumn("before", before).where(F.col("before") < top).select(*GROUP, "value", "before")
    chosen = cells.drop("members").join(values, [*GROUP, "value"])
    # of a cell no more than its first terms can have a rank
    inside = W.partitionBy(*GROUP, "c", "n").orderBy("term")
    heads = rows.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= top).drop("place")
    found = heads.join(chosen, [*GROUP, "c", "n"])
    among = W.partitionBy(*GROUP, "value").orderBy("term")
    found = found.withColumn("place", F.row_number().over(among)).where(F.col("place") <= top)
    found = found.withColumn("rank", (F.col("before") + F.col("place")).cast("int")).where(F.col("rank") <= top)
    return found.select(*GROUP, F.col("term").alias("item"), "value", "rank")


def per_billion(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (counts + 1) / total) in 64 bits: the product is divided in two steps."""
    whole, rest = np.divmod((counts + 1) * 10_000, total)
    return 1 + whole * 100_000 + rest * 100_000 // total


def _pair_sums(key, cells: pa.Table, totals: pa.Table) -> pa.Table:
    """Sums of f over one part of a language's cells, for each ordered pair of its sources."""
    sources = totals["source"].to_pylist()
    place = {s: i for i, s in enumerate(sources)}
    total = totals["total"].to_numpy() + totals["kept"].to_numpy()
    out = np.zeros((len(sources), len(sources)), dtype=np.int64)
    step = max(1, EVALUATED // max(1, len(sources)))
    for at in range(0, len(cells), step):
        part = cells.slice(at, step).combine_chunks()
        by = part["by"].combine_chunks() if part.num_rows else None
        if by is None:
            continue
        flat = by.flatten()
        rows = np.repeat(np.arange(len(part)), by.value_lengths().to_numpy())
        columns = np.array([place[s] for s in flat.field("source").to_pylist()], dtype=np.int64)
        counts = np.zeros((len(part), len(sources)), dtype=np.int64)
        counts[rows, columns] = flat.field("c").to_numpy()
        p, members = per_billion(counts, total), part["members"].to_numpy()
        for a in range(len(sources)):
            apart = p[:, a : a + 1] - p
            out[a] += members @ (apart * apart // p)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    names = np.array(sources, dtype=object)
    lang = totals["lang"][0].as_py() if len(totals) else ""
    return pa.table([pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), out[a, b]], schema=PAIR)


def source_pairs(terms: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): how far each source is from each other source of its language."""
    cells = stored(terms.groupBy("lang", "by").agg(F.count("*").alias("members")), "divergence-vectors")
    sizes = cells.groupBy("lang").agg(F.count("*").alias("cells")).join(totals.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    of_part = F.least(F.greatest(F.col("sources") * F.col("sources"), F.lit(PART[0])), F.lit(PART[1]))
    sizes = sizes.select("lang", F.ceil(F.col("cells") / of_part).cast("int").alias("parts"))
    parts = stored(totals.join(sizes, "lang", "left").select(*GROUP, "total", "kept", F.coalesce("parts", F.lit(1)).alias("parts")), "divergence-parts")
    of_lang = parts.select("lang", "parts").distinct()
    left = cells.join(of_lang, "lang").withColumn("part", F.pmod(F.xxhash64("by"), F.col("parts")).cast("int"))
    right = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keys = ["lang", "part"]
    left = left.select(*keys, "by", "members").groupBy(*keys)
    sums = left.cogroup(right.select(*keys, "source", "total", "kept").groupBy(*keys)).applyInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = W.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order))


def divergence_audit(docs: DataFrame, min_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and the `top` terms of each group."""
    terms = stored(term_counts(docs, min_docs), "divergence-terms")
    totals = stored(group_totals(docs, terms), "divergence-totals")
    names = ["lang", "source", "part", "item", "value", "rank"]
    pairs = source_pairs(terms, totals).withColumn("part", F.lit("pair"))
    return pairs.select(names).unionByName(top_terms(terms, totals, top).withColumn("part", F.lit("term")).select(names))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT lang, source, doc, translate(unnest(terms), '{UPPER}', '{LOWER}') AS term FROM d),
q AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM t JOIN q USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS kept, CAST(sum(n) AS BIGINT) AS total FROM q GROUP BY lang),
s AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
a AS (SELECT s.lang, s.source, q.term, coalesce(c.c, 0) AS c,
             CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (s.total + v.kept)::HUGEINT AS HUGEINT) AS p,
             CAST(1 + (1000000000::HUGEINT * (q.n + 1)) // (v.total + v.kept)::HUGEINT AS HUGEINT) AS q
      FROM s JOIN v USING (lang) JOIN q USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = q.term),
pairs AS (SELECT x.lang, x.source, y.source AS item, CAST(coalesce(sum(f), 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
          LEFT JOIN (SELECT m.lang, m.source, o.source AS other, ((m.p - o.p) * (m.p - o.p)) // o.p AS f
                     FROM a m JOIN a o ON m.lang = o.lang AND m.term = o.term) z ON z.lang = x.lang AND z.source = x.source AND z.other = y.source
          GROUP BY x.lang, x.source, y.source),
best AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM a WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank
FROM best QUALIFY rank <= 200"""
