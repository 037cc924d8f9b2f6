"""Line dedup by content-defined line chunks.

A rolling hash over the hashes of `WINDOW` neighbouring lines puts a boundary wherever it is
divisible by `divisor`. Boundaries depend on nothing but the lines around them, so inserted lines
shift no other boundary. Chunks of two lines or more that occur again are removed, but for their
first occurrence by (doc_id, place); they count as equal only when all their bytes are.

Defined results: a NULL or empty text is one empty line, never removed. Chunks of fewer than
`min_chars` characters stay. Rows that repeat a doc_id with the same text are one document and
keep or lose the same chunks. The text of a document that loses all chunks is ''.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import boxed, let, null_safe, unboxed

WINDOW, BASE, MODULUS = 2, 31, 1000003
KEYS = ["doc_id", "mark"]


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("bigint")


def line_chunks(text: Column, divisor: int) -> Column:
    """Struct of `lines` and `chunks` (k, first line, number of lines) that cover them."""

    def bounds(h: Column) -> Column:
        rolled = lambda i: (F.get(h, i - 1) * BASE + F.get(h, i)) % MODULUS
        last = lambda i: i == F.size(h) - 1
        ends = F.transform(h, lambda x, i: F.when(last(i) | ((i > 0) & (rolled(i) % divisor == 0)), i))
        return F.filter(ends, lambda e: e.isNotNull())

    def spans(ends: Column) -> Column:
        start = lambda k: F.coalesce(F.get(ends, k - 1) + 1, F.lit(0))
        return F.transform(ends, lambda e, k: F.struct(k.alias("k"), start(k).alias("at"), (e - start(k) + 1).alias("n")))

    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return let(lines, lambda a: F.struct(a.alias("lines"), let(let(F.transform(a, _line_hash), bounds), spans).alias("chunks")))


def _joined(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["at"] + 1, c["n"]), "\n")


def removed_chunks(rows: DataFrame, divisor: int, min_chars: int) -> DataFrame:
    """(doc_id, mark, gone): numbers of the chunks a document loses."""
    occurrences = (
        rows.select(*KEYS, F.inline(F.transform(
            F.filter(F.col("cut")["chunks"], lambda c: c["n"] > 1),
            lambda c: F.struct(c["k"].alias("k"), _joined(F.col("cut")["lines"], c).alias("chunk")),
        )))
        .where(F.length("chunk") >= min_chars)
        .withColumn("h", F.xxhash64("chunk"))
    )
    # bytes travel only for hashes that occur again; the group key of the second count is the bytes
    again = occurrences.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    suspects = occurrences.join(again, "h").select(*KEYS, "k", "chunk")
    place = F.struct(*KEYS, "k")
    firsts = suspects.groupBy("chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = suspects.join(firsts, "chunk").where(~place.eqNullSafe(F.col("first")))
    return later.groupBy(*KEYS).agg(F.collect_set("k").alias("gone"))


def _cleaned(docs: DataFrame, divisor: int, min_chars: int) -> DataFrame:
    rows = boxed(docs).select(
        "row", F.col("row")["doc_id"].alias("doc_id"), F.xxhash64(F.col("row")["text"]).alias("mark"),
        line_chunks(F.col("row")["text"], divisor).alias("cut"),
    )
    gone = removed_chunks(rows, divisor, min_chars)
    # the cut is not shuffled with the text but made again behind the join
    df = null_safe(rows.select("row", *KEYS), gone, KEYS, "left")
    df = df.withColumn("cut", line_chunks(F.col("row")["text"], divisor))
    chunks, lines = F.col("cut")["chunks"], F.col("cut")["lines"]
    kept = F.array_except(F.sequence(F.lit(0), F.size(chunks) - 1), F.col("gone"))
    text = F.array_join(let(F.struct(lines.alias("l"), chunks.alias("c")), lambda s: F.transform(kept, lambda k: _joined(s["l"], F.get(s["c"], k)))), "\n")
    return df.withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("row")["text"]).otherwise(text))


def line_dedup(docs: DataFrame, divisor: int = 3, min_chars: int = 50) -> DataFrame:
    """The documents with their own columns, repeated chunks gone from `text`."""
    return unboxed(_cleaned(docs, divisor, min_chars), docs.columns, F.col("kept_text"))


def line_dedup_report(docs: DataFrame, divisor: int = 3, min_chars: int = 50) -> DataFrame:
    """One row per document: its lines, removed chunks and lines, and the text that stays."""
    df = _cleaned(docs, divisor, min_chars)
    lost = F.aggregate(
        F.filter(F.col("cut")["chunks"], lambda c: F.array_contains(F.col("gone"), c["k"])), F.lit(0), lambda a, c: a + c["n"]
    )
    return df.select(
        "doc_id",
        F.size(F.col("cut")["lines"]).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed_chunks"),
        F.when(F.col("gone").isNull(), 0).otherwise(lost).cast("bigint").alias("n_removed"),
        F.coalesce(F.col("kept_text"), F.lit("")).alias("text"),
    )


ORACLE = f"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i + 1] AS line, len(lines) AS n,
             CAST('0x' || substr(md5(lines[i + 1]), 1, 7) AS BIGINT) AS h
      FROM cut, LATERAL (SELECT unnest(range(len(lines))) AS i)),
b AS (SELECT *, CASE WHEN i = n - 1 OR (i > 0 AND ((lag(h) OVER w * {BASE} + h) % {MODULUS}) % 3 = 0) THEN 1 ELSE 0 END AS stop
      FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(stop) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b),
c AS (SELECT doc_id, k, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, k),
r AS (SELECT *, lines > 1 AND length(chunk) >= 50 AND row_number() OVER (PARTITION BY chunk, lines > 1 ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT doc_id, CAST(sum(lines) AS BIGINT) AS n_lines, count(*) FILTER (gone) AS n_removed_chunks,
       CAST(coalesce(sum(lines) FILTER (gone), 0) AS BIGINT) AS n_removed,
       coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
FROM r GROUP BY doc_id"""
