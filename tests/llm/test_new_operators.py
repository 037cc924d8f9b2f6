"""Spelling variants, URL filters and the divergence audit against brute force, and on awkward tables."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.llm import divergence, spelling, url_filters

CLASH = "doc_id bigint, text string, lang string, source string, word string, n int, block string, h string, docs int, c int, by string, part int"
PAGE = "page_id bigint, url string, html string, host string, path string, doc_id bigint, bad int, members int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, *([None] * 8)) for r in rows], CLASH)


@pytest.fixture(scope="module")
def awkward(spark):
    rng = np.random.default_rng(2)
    letters = list("abcdeé")
    stock = ["".join(rng.choice(letters, rng.integers(5, 9))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(stock, 40)) + " STRASSE Straße ÀÉ'x 12ab", "en" if i % 3 else "de", f"s{i % 4}") for i in range(30)]
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, "ab " * 20_000 + "x" * 5_000, "en", "s2"), (None, rows[0][1], None, "s1"), rows[3], rows[3]]
    rows += [(103, "only here", "fr", "s9"), (104, None, "fr", "s8"), (105, "日本語 日本語\U0001f642 ok", "en", "s1")]
    return rows


def _edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def _variants(rows, noise=97):
    low = {c: c + 32 for c in range(65, 91)}
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if noise and h % noise == 0 else run
            if len(word) >= 5:
                n[word] += 1
    n = {w: k for w, k in n.items() if k >= 3}
    near = {w: [v for v in n if _edits(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    root = {}
    for w in n:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return {(w, form[w], root[w], n[w], len(near[w]), n.get(form[w])) for w in n}


def _found(df):
    return [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()]


def test_spelling_variants(spark, awkward):
    for noise in (97, 2):
        got = _found(spelling.spelling_variants(_docs(spark, awkward), noise=noise))
        assert len(got) == len(set(got)) and set(got) == _variants(awkward, noise)
    assert spelling.spelling_variants(_docs(spark, awkward).limit(0)).count() == 0
    assert spelling.spelling_variants(_docs(spark, [(1, "too short", "en", "s")])).count() == 0


def test_crowded_blocks_in_pieces_find_the_same_pairs(spark):
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("eant"), rng.integers(5, 8))) for _ in range(700)})
    df = spark.createDataFrame([(w, int(n)) for w, n in zip(words, rng.integers(3, 50, len(words)))], "word string, n bigint")
    n = {r["word"]: r["n"] for r in df.collect()}
    want = {}
    for w in words:
        near = [v for v in words if _edits(w, v)]
        if near:
            best = min(near, key=lambda v: (-n[v], v))
            want[w] = (len(near), best, n[best])
    for tile, groups in ((10**6, 4), (200, 4), (500, 7), (300, 1)):
        got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near_words(df, tile, groups).collect()}
        assert got == want


def test_near_words_lie_in_adjacent_blocks():
    assert sorted("".join(spelling.letter_groups(6))) == sorted(spelling.LETTERS)
    assert set(spelling.LETTERS) == set("abcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}
    assert [spelling.block_groups(n) for n in (0, 10**6, 10**7, 10**8, 10**9)] == [4, 4, 4, 6, 8]


def _judge(pages, labels, limit):
    """The posterior bound per host in plain arithmetic, one level at a time."""

    def cut(url):
        if not url or "://" not in url:
            return "", ""
        rest = url[url.index("://") + 3 :]
        host = re.match("[^/?#]*", rest)[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), re.match("[^?#]*", rest[len(host) :])[0]

    bad = {}
    for doc, quality, toxic in labels:
        if doc is not None and (quality is not None or toxic is not None):
            bad[doc] = max(bad.get(doc, 0), int(quality == 0 or toxic == 1))
    n, k = Counter(), Counter()
    hosts = {cut(u)[0] for _, u in pages}
    for _, url in pages:
        host, path = cut(url)
        number = re.search(r"([0-9]+)(?:\.[a-z]+)?/?$", path)
        if number and int(number[1]) in bad:
            n[host] += 1
            k[host] += bad[int(number[1])]
    of = {}
    for h in hosts:
        name = re.sub(":[0-9]*$", "", re.sub("^.*@", "", h))
        of[h] = (name, "") if re.fullmatch("[0-9.]+", name) else (".".join(name.split(".")[-2:]), name.split(".")[-1])
    up = dict(of.values())
    domain, suffix = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h in hosts:
        for table, key in ((domain, of[h][0]), (suffix, of[h][1])):
            table[key][0] += n[h]
            table[key][1] += k[h]
    total = sum(v[0] for v in suffix.values()), sum(v[1] for v in suffix.values())

    def worth(rows):
        seen = sum(k * (k - 1) for n, k, m in rows)
        spread = sum(n * (n - 1) * m * (1 - m) for n, k, m in rows)
        r = (seen - sum(n * (n - 1) * m * m for n, k, m in rows)) / spread if spread else 0.1
        r = min(max(r, 0.001), 0.5)
        return (1 - r) / r

    def means(table, prior):
        s = worth([(*table[x], prior(x)) for x in table])
        return {x: (table[x][1] + s * prior(x)) / (table[x][0] + s) for x in table}

    top = (total[1] + 1) / (total[0] + 2)
    of_suffix = means(suffix, lambda x: top)
    of_domain = means(domain, lambda x: of_suffix[up[x]])
    prior = lambda h: of_domain[of[h][0]]
    s = worth([(n[h], k[h], prior(h)) for h in hosts])
    out = {}
    for h in hosts:
        m = (k[h] + s * prior(h)) / (n[h] + s)
        out[h] = (m, max(0.0, m - 1.645 * math.sqrt(m * (1 - m) / (n[h] + s + 1))))
    return {"hosts": out, "cut": cut}


def test_url_verdicts(spark):
    rng = np.random.default_rng(12)
    pages, labels = [], []
    for i in range(600):
        host = f"{'abc'[i % 3]}.site{i % 7}.{['net', 'info'][i % 2]}"
        pages.append((i, f"https://{host}/en/{i}{['', '.html', '/', '?x=1#y'][i % 4]}"))
        labels.append((i, int(rng.random() > (0.9 if i % 7 == 3 else 0.1)), 0))
    odd = [None, "no scheme", "http://", "http://EXAMPLE.org/es/5", "http://a.example.org/en/12", "http://x.com/fr/1", "http://com/de/9", "http://example.org", "ftp://u@Com:80/de/"]
    odd += ["http://badexample.org/es/", "http://x.org?/q", "http://1.2.3.4/de/1", "http://münchen.de/ß#f", "http://xcom/de/"]
    pages += [(1000 + i, u) for i, u in enumerate(odd)] + [(None, odd[3]), pages[5], pages[5]]
    labels += [(None, 0, 1), (3, None, None), (4, 0, None), (4, 1, 0)]
    p = spark.createDataFrame([(*r, *([None] * 6)) for r in pages], PAGE)
    l = spark.createDataFrame([(*r, "x") for r in labels], "doc_id bigint, quality int, toxic int, host string")
    want = _judge(pages, labels, url_filters.LIMIT)
    rows = url_filters.url_verdicts(p, l).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(i for i, _ in pages)
    url = dict(pages)
    for r in rows:
        host, path = want["cut"](url[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        rule = None
        for verdict, name, start in url_filters.RULES:
            if (host == name or host.endswith("." + name)) and path.startswith(start) and len(name + start) > len(rule or ""):
                rule, said = name + start, verdict
        assert r["rule"] == rule
        assert r["posterior_mean"] == pytest.approx(want["hosts"][host][0], abs=2e-5)
        assert r["posterior_low"] == pytest.approx(want["hosts"][host][1], abs=2e-5)
        assert r["verdict"] == (said if rule else "block" if r["posterior_low"] > url_filters.LIMIT else "allow")
    blocked = {r["host"] for r in rows if r["rule"] is None and r["verdict"] == "block"}
    assert blocked and all(".site3." in h for h in blocked)
    assert url_filters.url_verdicts(p.limit(0), l).count() == 0
    assert {r["verdict"] for r in url_filters.url_verdicts(p, l.limit(0)).where("rule is null").collect()} <= {"allow", "block"}


def test_registered_domains(spark):
    hosts = {"a.b.example.com": ("example.com", "com"), "x.co.uk": ("x.co.uk", "co.uk"), "a.x.co.uk": ("x.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"),
             "localhost": ("localhost", "localhost"), "u:p@q.example.org:8080": ("example.org", "org"), "10.0.0.1:80": ("10.0.0.1", ""), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    domain, suffix = url_filters.registered(F.col("host"))
    assert {r[0]: (r[1], r[2]) for r in df.select("host", domain, suffix).collect()} == hosts


def _audit(rows, top):
    low = {c: c + 32 for c in range(65, 91)}
    docs = [(lang or "", source or "", [t.translate(low) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, n = Counter(), Counter()
        count = defaultdict(Counter)
        for l, s, terms in docs:
            if l == lang:
                df.update(set(terms))
                count[s].update(terms)
        kept = [t for t in df if df[t] >= 3]
        for s in count:
            for t in kept:
                n[t] += count[s][t]
        rate = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p, q = {s: rate(count[s]) for s in count}, rate(n)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in count if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def test_divergence_audit(spark, awkward, monkeypatch):
    names = ["lang", "source", "part", "item", "value", "rank"]
    rows = lambda df: sorted(tuple(r[c] for c in names) for r in df.collect())
    for top in (200, 7):
        assert rows(divergence.divergence_audit(_docs(spark, awkward).repartition(3), top=top)) == _audit(awkward, top)
    assert divergence.divergence_audit(_docs(spark, awkward).limit(0)).count() == 0


def test_counts_are_handed_on_in_parts(awkward, monkeypatch):
    import pyarrow as pa

    texts = [r[1] or "" for r in awkward]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(["s"] * len(texts)), pa.array(texts)], names=["lang", "source", "text"])

    def counted():
        total = defaultdict(lambda: [0, 0])
        for part in divergence._count_terms([batch]):
            for row in part.to_pylist():
                total[row["term"]][0] += row["c"]
                total[row["term"]][1] += row["docs"]
        return dict(total)

    whole = counted()
    monkeypatch.setattr(divergence, "HELD", 10)
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert counted() == whole


def test_rates_beyond_64_bits():
    counts, total = np.array([0, 5, 10**13, 9 * 10**13 - 1]), 9 * 10**13
    assert divergence.per_billion(counts, np.int64(total)).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_counts_of_the_corpus_pass_32_bits():
    import pandas as pd

    from pluvia.llm import lm_scoring
    from pluvia.llm.blocks import squeeze

    codes, n = np.array([97, 98, 353], dtype=np.uint64), np.array([2**32 + 5, 7, 1], dtype=np.int64)
    block = pd.DataFrame({"blob": [squeeze(codes, np.array([2**32 - 1, 7, 0]).astype("<u4")), squeeze(codes, np.array([6, 0, 1]).astype("<u4"))]})
    u, c = lm_scoring._added(block)
    assert u.tolist() == codes.tolist() and c.tolist() == n.tolist()
    nodes = lm_scoring._subtrees(pd.DataFrame({"blob": [squeeze(u, c.astype("<u8"))]}))
    roots = nodes[nodes["node"] == 1]
    assert roots["a"].sum() + roots["b"].sum() == n.sum()
