"""Substring dedup by sliding sentence spans.

A text is cut into sentences at stops and line ends, and these at commas, colons and semicolons,
so that a passage which starts or ends inside a sentence loses little; the pieces put together are
the text. From every piece starts one span: the shortest run of at least `run` consecutive pieces
that has `min_words` words. Spans are hashed (128 bits over the trimmed pieces) and counted over all
documents, and a piece that lies in any span but the first of its kind by (doc_id, place) is removed.

Defined results: a NULL text has no pieces. The words of a piece are its runs of white space inside
and one, so a piece of white space counts one. A text with fewer words than `min_words` has no span.
Rows that repeat a doc_id with the same text are one document and lose the same pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import boxed, let, null_safe, unboxed

#: A sentence or a part of one, in a form that Java, Python and RE2 read alike.
SENTENCE = r"[^.!?\n,;:]*[.!?\n,;:]+[ \t\r\n]*|[^.!?\n,;:]+"
BLANKS = r"[ \t\n\x0B\f\r]+"
KEYS = ["doc_id", "mark"]


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def _spans(raw: Column, run: int, min_words: int) -> Column:
    """Structs (i, k, a, b): the place of a span, its number of pieces and two hashes of them."""
    most = max(run, min_words)  # every piece has a word

    def size(counts: Column) -> Column:
        """Pieces a span takes from the start of `counts` and its words, as pieces * scale + words."""
        scale = 2 * most * (min_words + 1)
        open_ = lambda at: (F.pmod(at, F.lit(scale)) < min_words) | (at < run * scale)
        return let(F.aggregate(counts, F.lit(0), lambda at, x: F.when(open_(at), at + scale + x).otherwise(at)), lambda at: F.when(~open_(at), F.floor(at / scale).cast("int")))

    def hashed(s: Column, n: Column) -> Column:
        def span(i: Column) -> Column:
            def taken(k: Column) -> Column:
                return let(F.slice(s, i + 1, k), lambda p: F.struct(i.alias("i"), k.alias("k"), F.xxhash64(p).alias("a"), F.xxhash64(F.lit("span"), F.reverse(p)).alias("b")))

            return let(size(F.slice(n, i + 1, most)), lambda k: F.when(k.isNotNull(), taken(k)))

        return F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - run), span), lambda x: x.isNotNull())

    words = lambda x: F.least(F.regexp_count(x, F.lit(BLANKS)) + 1, F.lit(min_words))
    trimmed = F.transform(raw, lambda x: F.btrim(x, F.lit(" \t\r\n")))
    return F.when(F.size(raw) >= run, let(trimmed, lambda s: let(F.transform(s, words), lambda n: hashed(s, n))))


def removed_sentences(rows: DataFrame, run: int, min_words: int) -> DataFrame:
    """(doc_id, mark, gone): numbers of the pieces a document loses."""
    spans = rows.select(*KEYS, F.inline(let(sentences(F.col("row")["text"]), lambda s: _spans(s, run, min_words))))
    place = F.struct(*KEYS, "i")
    firsts = spans.groupBy("a", "b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = spans.join(firsts, ["a", "b"]).where(~place.eqNullSafe(F.col("first")))
    covered = F.flatten(F.transform("at", lambda x: F.sequence(x["i"], x["i"] + x["k"] - 1)))
    return later.groupBy(*KEYS).agg(F.collect_set(F.struct("i", "k")).alias("at")).select(*KEYS, F.array_distinct(covered).alias("gone"))


def _cleaned(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    rows = boxed(docs).select("row", F.col("row")["doc_id"].alias("doc_id"), F.hash(F.col("row")["text"]).alias("mark"))
    df = null_safe(rows, removed_sentences(rows, run, min_words), KEYS, "left")
    df = df.withColumn("raw", sentences(F.col("row")["text"]))
    kept = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), F.col("gone"))
    text = F.array_join(let(F.col("raw"), lambda s: F.transform(kept, lambda i: F.get(s, i))), "")
    return df.withColumn("kept_text", F.when(F.col("gone").isNull(), F.col("row")["text"]).otherwise(text))


def substring_dedup(docs: DataFrame, run: int = 2, min_words: int = 25) -> DataFrame:
    """The documents with their own columns, repeated sentences gone from `text`."""
    return unboxed(_cleaned(docs, run, min_words), docs.columns, F.col("kept_text"))


def substring_dedup_report(docs: DataFrame, run: int = 2, min_words: int = 25) -> DataFrame:
    """One row per document: its pieces (sentences cut at commas, colons and semicolons, too), how many go, and the text that stays."""
    return _cleaned(docs, run, min_words).select(
        "doc_id",
        F.size("raw").cast("bigint").alias("n_sentences"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.col("kept_text"), F.lit("")).alias("text"),
    )


ORACLE = r"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n,;:]*[.!?\n,;:]+[ \t\r\n]*|[^.!?\n,;:]+') AS raw FROM documents),
t AS (SELECT *, list_transform(raw, lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(10))) AS ts FROM s),
e AS (SELECT doc_id, i, raw[i + 1] AS r, len(regexp_extract_all(ts[i + 1], '[ \t\n\x0B\f\r]+')) + 1 AS n
      FROM t, LATERAL (SELECT unnest(range(len(raw))) AS i)),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM e),
j AS (SELECT a.doc_id, a.i, min(b.i) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i + 1 AND a.i + 24 AND b.upto - a.upto + a.n >= 25 GROUP BY ALL),
d AS (SELECT j.doc_id, j.i, j.j, row_number() OVER (PARTITION BY ts[j.i + 1 : j.j + 1] ORDER BY j.doc_id, j.i) AS nth FROM j JOIN t USING (doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i, true AS gone FROM d WHERE nth > 1)
SELECT doc.doc_id, count(e.i) AS n_sentences, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(r, '' ORDER BY e.i) FILTER (gone IS NULL), '') AS text
FROM documents doc LEFT JOIN e USING (doc_id) LEFT JOIN g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY doc.doc_id"""
