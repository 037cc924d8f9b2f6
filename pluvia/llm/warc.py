"""WARC archives and an index merged from sorted runs.

Pages are written as WARC records (gzip files of at most about `FILE_BYTES`), one per page: the first
page_id with a payload is a response, others with the same payload revisit it and carry no copy.
Reading parses every archive by its record lengths and gives index entries. The entries of one
archive, sorted by URL key and timestamp, are a run; up to `FAN_IN` runs at a time are merged by a
loser tree, pass after pass, each pass split into key ranges, until one run is left. Its order is
the global capture order: all captures of a URL by time.

Defined results: a NULL html is an empty payload, a NULL url an empty target. Line ends in a url
are percent-encoded. Payloads under `min_bytes` are never shared. Pages that repeat a page_id give
a record each, all of the same role. A NULL page_id comes back as NULL.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import null_safe, stored
from pluvia.session import scratch_path

FILE_BYTES, FAN_IN, RANGE_ROWS, SAMPLE = 16_000_000, 64, 100_000, 4096
CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed value: the base32 alphabet.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URL = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:www\d*\.)?([^/:?#]*)(?::\d+)?([^#]*)", re.S)
ENTRY = "page_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint, url_key string, captured string, run bigint, at bigint, bytes bigint"


def base32_sha1(payload: Column) -> Column:
    digest = F.sha1(payload)
    out = []
    for i in range(8):
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def url_key(url: str) -> str:
    """Host labels reversed, then the path and query: captures of a site sort together."""
    host, path = URL.match(url).groups()
    return ",".join(reversed(host.lower().split("."))) + ")" + (path.lower() or "/")


def _roles(pages: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha, refers_to) of the pages that revisit another."""
    seen = pages.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("n")).where(F.col("n") >= min_bytes)
    firsts = seen.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return seen.select("page_id", "sha").join(firsts, "sha").where("refers_to < page_id").distinct()


def write_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Writes pages (page_id, url, html) as WARC files; returns their folder."""
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows, total = pages.agg(F.count("*"), F.sum(F.octet_length("payload") + 600)).first()
    roles = _roles(pages, min_bytes)
    df = null_safe(pages.withColumn("sha", F.sha1("payload")), roles, ["page_id", "sha"], "left")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    when = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.xxhash64("page_id"), F.lit(31_536_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    again = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(again, "").otherwise(F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), name, F.lit(">")),
        F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">")),  # NULL, hence left out, for responses
        F.when(again, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_sha1(F.col("payload"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF + CRLF), block)
    folder = scratch_path(pages.sparkSession, "warc")
    # written where the join left them, a file per so many records: payloads are not shuffled again for it
    each = max(1, math.floor(FILE_BYTES * rows / total)) if rows else 1
    written = df.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip")
    written.option("maxRecordsPerFile", each).text(folder)
    return folder


def records(data: bytes):
    """(headers, block, offset, length) of every record of an unpacked archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split(CRLF)[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size], at, end + 8 + size - at
        at = end + 8 + size


def _inside(urn: str | None) -> str | None:
    return urn[len("<urn:page:") : -1] if urn else None


def read_archives(spark, folder: str) -> DataFrame:
    """Index entries of all records; payload size and digest are those of the payload read, or for a revisit of its header."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                number = zlib.crc32(path.rsplit("/", 1)[-1].encode())
                found = []
                for head, block, at, size in records(zlib.decompress(content.as_py(), 31)):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest, n = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if head["WARC-Type"] == "response":
                        n = len(payload)
                        if digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                            raise ValueError(f"{path}: the payload at {at} does not match its digest")
                    found.append((_inside(head["WARC-Record-ID"]), head["WARC-Type"], _inside(head.get("WARC-Refers-To")), digest, n,
                                  url_key(head["WARC-Target-URI"]), head["WARC-Date"], number, at, size))
                found.sort(key=lambda r: (r[5], r[6], r[0]))
                yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=[f.split()[0] for f in ENTRY.split(", ")]), schema=SCHEMA, preserve_index=False)

    types = {"string": pa.string(), "bigint": pa.int64()}
    SCHEMA = pa.schema([(f.split()[0], types[f.split()[1]]) for f in ENTRY.split(", ")])
    return spark.read.format("binaryFile").load(folder).where("path like '%.gz'").select("path", "content").mapInArrow(run, ENTRY)


class LoserTree:
    """Merges k sorted lists: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._play(1) if runs else -1

    def _before(self, a: int, b: int) -> bool:
        if self.at[a] >= len(self.runs[a]):
            return False
        return self.at[b] >= len(self.runs[b]) or (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self):
        """(run, place in the run) in order."""
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield run, self.at[run]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._before(self.losers[node], run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of one group and key range as one run."""
    parts = [p.sort_values("key", kind="stable") for _, p in pdf.groupby("run", sort=True)]
    tree = LoserTree([p["key"].tolist() for p in parts])
    begin, total = [], 0
    for p in parts:
        begin.append(total)
        total += len(p)
    order = [begin[run] + at for run, at in tree]
    out = pd.concat(parts).iloc[order]
    return out.assign(run=out["grp"], place=range(total))


def merged_index(entries: DataFrame) -> DataFrame:
    """Entries with `capture_order`, their place in the order of (url_key, captured, page_id)."""
    spark = entries.sparkSession
    key = F.concat_ws("\u0001", "url_key", "captured", F.lpad(F.coalesce("page_id", F.lit("")), 20, "0"))
    numbers = entries.select("run").distinct().withColumnRenamed("run", "file")
    runs = numbers.count()
    ranked = numbers.select("file", F.pmod(F.xxhash64("file"), F.lit(max(1, runs))).alias("run"))
    cur = entries.withColumnRenamed("run", "file").join(ranked, "file").withColumn("key", key)
    total = entries.count()
    sample = sorted(r[0] for r in cur.orderBy(F.xxhash64("key")).limit(SAMPLE).select("key").collect())
    ranges = min(math.ceil(total / RANGE_ROWS) or 1, max(1, len(sample)))
    cuts = spark.sparkContext.broadcast([sample[len(sample) * i // ranges] for i in range(1, ranges)])

    @F.pandas_udf("long")
    def slot(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: bisect_right(cuts.value, k))

    cur = cur.withColumn("slot", slot("key")).withColumn("place", F.lit(0).cast("bigint")).withColumn("grp", F.lit(0).cast("bigint"))
    while True:
        groups = math.ceil(runs / FAN_IN) or 1
        cur = cur.withColumn("grp", F.pmod("run", F.lit(groups)).cast("bigint"))
        cur = stored(cur.groupBy("grp", "slot").applyInPandas(_merge, cur.schema), "runs")
        runs = groups
        if runs == 1:
            break
    from pyspark.sql import Window

    sizes = cur.groupBy("slot").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("slot", before.alias("before"))
    return cur.join(offsets, "slot").withColumn("capture_order", F.col("before") + F.col("place")).drop("before", "slot", "place", "grp", "run", "key")


def capture_index(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to archives and back: one row per record with its role and place in the capture order."""
    folder = write_archives(pages, min_bytes)
    entries = stored(read_archives(pages.sparkSession, folder), "index")
    merged = merged_index(entries)
    sizes = entries.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size")).distinct()
    kind = pages.schema["page_id"].dataType
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    return merged.join(sizes, "refers_to", "left").select(
        number("page_id").alias("page_id"),
        F.coalesce("payload_bytes", "size").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        number("refers_to").alias("refers_to"),
        "url_key",
        "captured",
        "capture_order",
        F.col("file").alias("archive"),
        "at",
        "bytes",
    )
