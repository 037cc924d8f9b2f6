"""URL filters: lists of rules, then an empirical-Bayes reputation of hosts.

Labelled pages are outcomes, bad or not. The share of bad pages of a host has a beta prior around the
posterior mean of its registered domain, a domain's one around its suffix, a suffix's one around all
pages. How closely children follow their parent is estimated from the data, per level: a beta-binomial
child with n labelled pages, k of them bad, has E[k (k - 1)] = n (n - 1) (m^2 + r m (1 - m)) for the
parent's mean m, which gives r from three sums, and r = 1 / (s + 1) for a prior worth s pages. A host is
blocked when its share is above `limit` at the lower bound mean - z sd (0 at least) of its posterior; a host without
labels is judged by its prior alone. Rules decide before that.

Sums are of integers (means in millionths), so that no result depends on how rows are dealt. The counts
of a host, domain or suffix of any size are partial sums. Keys with at least a thousandth of the rows,
which are a thousand at most, join by broadcast and all others by shuffle, so no task gets a hot host.

Defined results: a NULL url, or one without '://', has host and path '', is matched by no rule and
shares the reputation of host ''. Rows that repeat a page_id are judged one by one. Labels of one
document count once, as bad where any row says so; rows with NULL in all outcomes are no labels. Without
labels every mean is a half, and nothing but rules blocks as long as the bound stays below the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.llm.common import stored
from pluvia.llm.spelling import lower_ascii

#: (verdict, host, path): a rule holds for its host and all subdomains where the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Suffixes of two labels under which names are registered; all others have one label.
SUFFIXES = (
    "ac.jp ac.nz ac.uk ac.za co.id co.il co.in co.jp co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.hk com.mx "
    "com.my com.pe com.ph com.pl com.sg com.tr com.tw com.ua com.vn edu.au edu.cn go.jp gov.au gov.br gov.cn gov.in gov.uk ne.jp "
    "net.au net.br net.cn net.nz net.uk or.jp or.kr org.au org.br org.cn org.nz org.uk org.za"
).split()
#: Blocked above this share of bad pages, at this many standard deviations below the posterior mean.
LIMIT, Z = 0.3, 1.645
#: Bounds of r, and r where no group has two labelled pages.
R_LEAST, R_MOST, R_UNKNOWN = 1_000, 500_000, 100_000
#: Keys with a share of one in HOT of the rows are broadcast.
HOT = 1_000
MILLION = 1_000_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, 2**31 - 1)).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else NULL."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def registered(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; user and port don't count, and addresses are their own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    address = name.rlike(r"^[0-9.]+$") | name.startswith("[")
    two = F.substring_index(name, ".", -2)
    listed = two.isin(SUFFIXES)
    suffix = F.when(address, "").when(listed, two).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(address, name).when(listed, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, suffix


def outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of labelled pages: the last number in a page's path is the id of the document it shows.
    A document is bad if its quality is 0 or it is toxic."""
    host, path = parts(F.col("url"))
    number = F.regexp_extract(path, r"([0-9]+)(?:\.[a-z]+)?/?$", 1).try_cast("bigint")
    shown = pages.select(host.alias("host"), number.alias("doc_id")).where("doc_id is not null")
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = labels.where("quality is not null or toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    return shown.join(known.agg(F.max(bad.cast("bigint")).alias("bad")), "doc_id").select("host", "bad")


def _spread(rows: DataFrame, values: DataFrame, key: str, weight: str) -> DataFrame:
    """Rows with the values of their key; `weight` is the number of rows of the key, so at most HOT keys are broadcast."""
    total = values.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT >= total
    often, seldom = values.where(hot).drop(weight), values.where(~hot).drop(weight)
    return rows.join(F.broadcast(often), key).unionByName(rows.join(seldom, key))


def _closeness(children: DataFrame) -> float:
    """s, the pages that the prior of a child is worth, from rows (n, k, prior); prior in millionths."""
    n, k, m = (F.col(c).cast("decimal(38,0)") for c in ("n", "k", "prior"))
    one = F.lit(MILLION).cast("decimal(38,0)")
    both, pairs = F.sum(k * (k - 1)), n * (n - 1)
    seen, mean, spread = children.agg(both, F.sum(pairs * m * m), F.sum(pairs * m * (one - m))).first()
    if not spread:
        r = R_UNKNOWN
    else:
        r = (int(seen) * MILLION**2 - int(mean)) / int(spread)
        r = min(max(int(r * MILLION + 0.5) if r > 0 else 0, R_LEAST), R_MOST)
    return (MILLION - r) / r


def _mean(s: float) -> Column:
    """Posterior mean in millionths."""
    share = (F.col("k") + s * (F.col("prior") / float(MILLION))) / (F.col("n") + F.lit(s))
    return F.floor(share * float(MILLION) + 0.5)


def reputations(visited: DataFrame, judged: DataFrame, z: float = Z) -> DataFrame:
    """(host, pages, labelled, bad, prior_mean, posterior_mean, posterior_low) from rows (host) of all pages and (host, bad) of labelled ones."""
    nothing = F.lit(0).cast("bigint")
    rows = visited.select("host", (nothing + 1).alias("pages"), nothing.alias("n"), nothing.alias("k"))
    rows = rows.unionByName(judged.select("host", nothing.alias("pages"), (nothing + 1).alias("n"), F.col("bad").cast("bigint").alias("k")))
    domain, suffix = registered(F.col("host"))
    hosts = rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "n", "k")]).where("pages > 0")
    hosts = stored(hosts.select("*", domain.alias("domain"), suffix.alias("suffix")), "url-hosts")
    added = [F.count("*").alias("members"), F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = stored(hosts.groupBy("domain", "suffix").agg(*added), "url-domains")
    suffixes = stored(domains.groupBy("suffix").agg(*added), "url-suffixes")

    n, k = suffixes.agg(F.sum("n"), F.sum("k")).first()
    top = int(((k or 0) + 1) / ((n or 0) + 2) * MILLION + 0.5)
    suffixes = suffixes.withColumn("prior", F.lit(top))
    below = suffixes.select("suffix", "members", _mean(_closeness(suffixes)).alias("prior"))
    domains = stored(_spread(domains.withColumnRenamed("members", "hosts"), below, "suffix", "members"), "url-domain-priors")
    below = domains.select("domain", "hosts", _mean(_closeness(domains)).alias("prior"))
    hosts = stored(_spread(hosts, below, "domain", "hosts"), "url-host-priors")
    s = _closeness(hosts)
    m = F.col("prior") / float(MILLION)
    a, total = F.col("k") + s * m, F.col("n") + F.lit(s)
    mean = a / total
    low = F.greatest(F.lit(0.0), mean - z * F.sqrt(mean * (1.0 - mean) / (total + 1.0)))
    rounded = lambda x: F.floor(x * float(MILLION) + 0.5) / float(MILLION)
    return hosts.select(
        "host", "pages", F.col("n").alias("labelled"), F.col("k").alias("bad"), m.alias("prior_mean"),
        rounded(mean).alias("posterior_mean"), rounded(low).alias("posterior_low"),
    )


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """One row per page: its host and path, the rule that fits, the verdict, and what its host's reputation rests on."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = stored(reputations(rows.select("host"), outcomes(pages, labels), z), "url-reputations")
    out = _spread(rows, known, "host", "pages").withColumn("r", matched_rule(F.col("host"), F.col("path"), rules))
    reputed = F.when(F.col("posterior_low") > limit, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", F.col("r")["rule"].alias("rule"), F.coalesce(F.col("r")["verdict"], reputed).alias("verdict"),
        "labelled", "bad", "prior_mean", "posterior_mean", "posterior_low",
    )


def _level(name: str, rows: str, up: str, key: str) -> str:
    """SQL of one level: rows (key, n, k, prior) of `name`, and of `name`_s the worth of their prior."""
    return f"""{name} AS (SELECT c.*, u.mean AS prior FROM {rows} c JOIN {up} u ON u.{key} = c.{key}),
{name}_r AS (SELECT CAST(sum(CAST(k AS HUGEINT) * (k - 1)) AS DOUBLE) * 1e12 AS seen, CAST(sum(CAST(n AS HUGEINT) * (n - 1) * prior * prior) AS DOUBLE) AS mean,
  CAST(sum(CAST(n AS HUGEINT) * (n - 1) * prior * ({MILLION} - prior)) AS DOUBLE) AS spread FROM {name}),
{name}_s AS (SELECT ({MILLION} - r) / CAST(r AS DOUBLE) AS s FROM (SELECT CASE WHEN coalesce(spread, 0) = 0 THEN {R_UNKNOWN}
  ELSE least(greatest(floor((seen - mean) / spread * 1e6 + 0.5), {R_LEAST}), {R_MOST}) END AS r FROM {name}_r))"""


_POSTERIOR = "floor((k + s * (prior / 1e6)) / (n + s) * 1e6 + 0.5)::BIGINT AS mean"
_TWO = "array_to_string(string_split(name, '.')[-2:], '.')"
_IN = "(" + ", ".join(f"'{s}'" for s in SUFFIXES) + ")"
ORACLE = f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
l AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
o AS (SELECT p.host, bad FROM p JOIN l ON l.doc_id = try_cast(regexp_extract(path, '([0-9]+)(?:\\.[a-z]+)?/?$', 1) AS BIGINT)),
h AS (SELECT host, n, k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
      FROM (SELECT host, count(*) AS pages FROM p GROUP BY host) LEFT JOIN (SELECT host, count(*) AS n, sum(bad) AS k FROM o GROUP BY host) USING (host)),
d AS (SELECT host, coalesce(n, 0) AS n, coalesce(k, 0) AS k, regexp_matches(name, '^[0-9.]+$') OR starts_with(name, '[') AS address, {_TWO} AS two, name FROM h),
hosts AS (SELECT host, n, k,
  CASE WHEN address THEN '' WHEN two IN {_IN} THEN two ELSE string_split(name, '.')[-1] END AS suffix,
  CASE WHEN address THEN name WHEN two IN {_IN} THEN array_to_string(string_split(name, '.')[-3:], '.') ELSE two END AS domain FROM d),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, 0 AS root, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
tops AS (SELECT 0 AS root, floor((sum(k) + 1) / (sum(n) + 2) * 1e6 + 0.5)::BIGINT AS mean FROM suffixes),
{_level("l1", "suffixes", "tops", "root")},
m1 AS (SELECT suffix, {_POSTERIOR} FROM l1, l1_s),
{_level("l2", "domains", "m1", "suffix")},
m2 AS (SELECT domain, {_POSTERIOR} FROM l2, l2_s),
{_level("l3", "hosts", "m2", "domain")},
post AS (SELECT *, (k + s * (prior / 1e6)) / (n + s) AS mean, n + s AS total FROM l3, l3_s),
known AS (SELECT host, n AS labelled, k AS bad, prior / 1e6 AS prior_mean, floor(mean * 1e6 + 0.5) / 1e6 AS posterior_mean,
          floor(greatest(0e0, mean - {Z} * sqrt(mean * (1.0 - mean) / (total + 1.0))) * 1e6 + 0.5) / 1e6 AS posterior_low FROM post),
rules(verdict, name, start) AS (VALUES {", ".join(f"('{v}', '{n}', '{s}')" for v, n, s in RULES)}),
fit AS (SELECT page_id, host, path, rules.name || rules.start AS rule, rules.verdict AS said FROM p LEFT JOIN rules
        ON (host = rules.name OR ends_with(host, '.' || rules.name)) AND starts_with(path, rules.start)
        QUALIFY row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rules.name || rules.start) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN posterior_low > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       CAST(labelled AS BIGINT) AS labelled, CAST(bad AS BIGINT) AS bad, prior_mean, posterior_mean, posterior_low
FROM fit JOIN known USING (host)"""
