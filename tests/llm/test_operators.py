"""Operators against brute force, and their defined results on awkward tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pluvia.llm import decontamination, line_dedup, lm_scoring, packing, pii, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, warc

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PASSAGE = "The quick brown fox jumps over the lazy dog near the old river bank. It then rests a while under a tree. Nobody sees it leave at dawn."
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
CLASH = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, stat int, kept int, mark int, gone string, fp int, label int, salt int, block int, payload string, bad int"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)).capitalize() + "."
    plain = lambda: "\n".join(" ".join(sentence(rng.randint(4, 12)) for _ in range(3)) for _ in range(4))
    texts = [plain() for _ in range(40)]
    texts += [texts[0], texts[0], texts[1].replace("a", "b", 1), PASSAGE, plain() + "\n" + PASSAGE + "\n" + plain(), plain() + " " + PASSAGE]
    texts += ["", None, " \n\t ", "x", "é🙂 " * 30, "word " * 30_000, "a" * 5_000, plain() + " " + ITEM + " " + plain(), ITEM]
    texts += ["+1 (743) 555-3824 then 743-555-3824, a.b@c.example.org, 10.0.0.1, 4111 1111 1111 1111"]
    return texts


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, repeated rows, very long and empty texts, columns named like working columns."""
    rows = [(i, t, *(["en", "s1", 3] if i % 3 else [None, None, None]), *([None] * 11)) for i, t in enumerate(_texts())]
    rows += [rows[5], rows[5], (None, None, *([None] * 14))]
    return spark.createDataFrame(rows, CLASH).repartition(4).cache()


@pytest.fixture(scope="module")
def clean(awkward):
    """Without NULL ids and repeated rows, for comparisons row by row."""
    return awkward.where("doc_id is not null").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, ""), (4, "too short"), (1, ITEM)], "item_id bigint, text string")


def _pairs(df):
    return {r[0]: r[1] or "" for r in df.select("doc_id", "text").collect()}


WORKS = {
    "line": (line_dedup.line_dedup_report, line_dedup.line_dedup),
    "substring": (substring_dedup.substring_dedup_report, substring_dedup.substring_dedup),
    "quality": (quality_rules.quality_report, None),
    "simhash": (simhash_dedup.simhash_components, None),
    "suffix": (suffix_dedup.suffix_dedup_report, None),
    "lm": (lm_scoring.ctw_scores, None),
    "pii": (pii.find_pii, None),
}


@pytest.mark.parametrize("name", WORKS)
def test_one_row_per_document(awkward, none, name):
    report, rewrite = WORKS[name]
    assert report(awkward).count() == awkward.count()
    assert report(none).count() == 0
    if rewrite:
        out = rewrite(awkward)
        assert out.columns == awkward.columns and out.count() == awkward.count()


def test_filters_return_their_input_columns(awkward, none, bench):
    for work in (quality_rules.keep_good, simhash_dedup.keep_leaders, lambda d: decontamination.drop_leaks(d, bench)):
        out = work(awkward)
        assert out.columns == awkward.columns and 0 < out.count() <= awkward.count()
        assert work(none).count() == 0


def test_quality_base_counts(clean):
    got = {r.doc_id: r for r in quality_rules.quality_report(clean).collect()}
    for i, text in _pairs(clean).items():
        words = re.findall(r"[^ \t-\r]+", text)
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) for j in range(3) if grams[tuple(words[k : k + 3])] > 1}
        lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(words), sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_quality_rejects_a_planted_outlier(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("w" * int(n) for n in rng.integers(2, 9, 200)), "en", "s") for i in range(300)]
    rows.append((300, " ".join(f"{'w' * 5}$$$" for _ in range(200)), "en", "s"))
    got = {r.doc_id: r.kept for r in quality_rules.quality_report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(got[i] or _fails(rows[i][1]) for i in range(300)) and not got[300]


def _fails(text):
    words = text.split()
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) for j in range(3) if grams[tuple(words[k : k + 3])] > 1}
    return len(words) < 50 or 2 * len(covered) > len(words)


def test_chi_squared_quantiles():
    for q, p in ((quality_rules.CHI2_MEDIAN, 0.5), (quality_rules.CHI2_975, 0.025), (quality_rules.CHI2_FAR, 1e-6)):
        assert quality_rules.tail(q) == pytest.approx(p, rel=0.02)


def test_factor_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 5)) * 1000).astype(int)
    df = spark.createDataFrame([(row.tolist(),) for row in x], "x array<bigint>")
    e = quality_rules._factor(df.groupBy(F.lit(1).alias("grp")).agg(*quality_rules._moment_sums(F.col("x"), F.lit(True), "t")), est=("t", 1.0)).first().est
    cov = np.cov(x.T / 1000, bias=True) + np.diag(np.square(list(quality_rules.FEATURES.values())))
    lower = np.linalg.cholesky(cov)
    assert np.allclose(e.l, lower[np.tril_indices(5)]) and np.allclose(e.m, x.mean(0) / 1000)


def test_lines_lose_later_copies_only(spark):
    block = "\n".join(f"shared line number {i} with enough words in it" for i in range(12))
    rows = [(1, "own start\n" + block + "\nown end"), (2, "another start\nmore\n" + block), (3, "nothing shared\nat all here")]
    got = {r.doc_id: r for r in line_dedup.line_dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed == 0
    assert 0 < got[2].n_removed <= 12 and got[2].text.startswith("another start\nmore")


def test_passages_go_but_for_the_first(clean):
    texts = _pairs(clean)
    got = {r.doc_id: r for r in substring_dedup.substring_dedup_report(clean).collect()}
    holders = sorted(i for i, t in texts.items() if PASSAGE in t)
    assert PASSAGE in got[holders[0]].text
    assert all("jumps over the lazy dog" not in got[i].text for i in holders[1:])


def test_simhash_components_match_brute_force(clean):
    got = {r.doc_id: r for r in simhash_dedup.simhash_components(clean).collect()}
    ids, prints = [], []
    for i, text in sorted(_pairs(clean).items()):
        h = simhash_dedup.shingle_hashes(simhash_dedup.word_bytes(text), 3).tolist()
        ids.append(i)
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    up = list(range(len(ids)))
    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                lo, hi = sorted((up[a], up[b]))
                up = [lo if u == hi else u for u in up]
    for k, i in enumerate(ids):
        assert got[i].fingerprint == f"{prints[k]:016x}" and got[i].component_id == ids[up[k]]


def test_tree_shards_lose_no_pair():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base[:100] ^ np.uint64(5), base[:50] ^ np.uint64(1 << 40)]))
    row, leaf, own = simhash_dedup.Tree(fps, 3).visits(fps, 3)
    assert sorted(row[own]) == list(range(len(fps)))
    met = set()
    for shard in np.unique(leaf):
        here, mine = row[leaf == shard], row[(leaf == shard) & own]
        for i, j in simhash_dedup.near_pairs(fps[mine], fps[here], 3):
            met |= set(zip(mine[i].tolist(), here[j].tolist()))
    want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if bin(int(fps[a] ^ fps[b])).count("1") <= 3}
    assert met == want


def test_leaders_cover_what_goes(clean):
    texts = _pairs(clean)
    kept = {r.doc_id for r in simhash_dedup.keep_leaders(clean).collect()}
    sets = {i: set(simhash_dedup.shingle_hashes(simhash_dedup.word_bytes(t), 5).tolist()) for i, t in texts.items()}
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert all(any(like(i, k) for k in kept) for i in texts if i not in kept)
    assert not any(a < b and like(a, b) for a in kept for b in kept)


@pytest.mark.parametrize("drift", [1, 5])
def test_leaders_of_groups_in_small_parts(spark, drift):
    """Groups far above the part size: close copies thin out in rounds, a drifting chain needs the blocks of pairs."""
    words = [f"w{k}" for k in range(200)]
    texts = []
    for i in range(60):
        texts.append(" ".join(words))
        words[(i * 37) % 200 : (i * 37) % 200 + drift] = [f"x{i}_{k}" for k in range(drift)]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = simhash_dedup.keep_leaders(spark.createDataFrame(rows, "doc_id bigint, text string"), part=4)
    kept = {r.doc_id for r in got.collect()}
    sets = [set(simhash_dedup.shingle_hashes(simhash_dedup.word_bytes(t), 5).tolist()) for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert 0 in kept and len(kept) < 60
    assert not any(like(a, b) for a in kept for b in kept if a < b)
    assert all(any(like(i, j) for j in range(i)) for i in range(60) if i not in kept)


def test_leaders_without_ids(spark):
    text = " ".join(f"w{k}" for k in range(100))
    rows = [(None, text), (None, text + " more"), (3, text + " and more"), (4, None), (4, "another text of its own"), (4, text + " x")]
    got = simhash_dedup.keep_leaders(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "None"]
    assert {r.text for r in got if r.doc_id == 4} == {None, "another text of its own"}


def test_leaks_match_brute_force(clean, bench):
    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    item = words(ITEM)
    want = {}
    for i, t in _pairs(clean).items():
        w = words(t)
        for a in range(max(1, len(w) - len(item) + 1)) if len(w) < 5000 else ():
            x, y = shingles(w[a : a + len(item)]), shingles(item)
            want[i] = max(want.get(i, 0), sum((x & y).values()) / max(1, sum((x | y).values())))
    got = {r.doc_id: r.similarity for r in decontamination.leak_report(clean, bench.where("item_id = 1").limit(1)).collect()}
    assert got == {i: s for i, s in want.items() if s >= 0.8} and len(got) == 2


def test_pieces_hold_every_id_once(awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(awkward.where("doc_id is not null").dropDuplicates(["doc_id"]), TOKENIZER, shard_tokens=20_000).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, text in _pairs(awkward.where("doc_id is not null")).items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_fullest_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(0, 80)
        sums = {0}
        for n, k in counts.items():
            sums = {s + n * j for s in sums for j in range(k + 1)}
        used = packing.fullest(counts, room)
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)
        assert all(k <= counts[n] for n, k in used.items())


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), packing.WordEncoder(TOKENIZER)
    odd = ["it's don't", "12ab <|endoftext|> x<|startoftext|>y", "a\x1cb\x85c d​e", "ÀÉ é ́x ΑΣ ΣΑΣ İI ﬁ", "  \t\n ", "日本語 テキスト🙂🙂", "\x00a\x1f b"]
    for text in odd:
        assert encoder.encode([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_suffixes_match_brute_force(clean):
    seen, want = {}, {}
    for i, text in sorted(_pairs(clean).items()):
        data = text.encode()
        gone = np.zeros(len(data) + 50, bool)
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            if seen.setdefault(w, i) < i:
                gone[p : p + 50] = True
        gone = gone[: len(data)]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        want[i] = (len(data), int(gone.sum()), len(edge) // 2, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    for hot in (10_000, 1):
        got = {r[0]: tuple(r[1:]) for r in suffix_dedup.suffix_dedup_report(clean, hot).collect()}
        assert got == want


def test_radix_groups():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 2000).astype(np.uint8)
    start = np.arange(len(data) - 49)
    rows, group = suffix_dedup.radix_groups(data, start, 16)
    by = defaultdict(set)
    for s in start.tolist():
        by[data[s : s + 16].tobytes()].add(s)
    got = defaultdict(set)
    for r, g in zip(rows.tolist(), group.tolist()):
        got[g].add(r)
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in by.values() if len(v) > 1)


def test_equal_strings_of_suffixes_are_sorted_once(monkeypatch):
    """Fifty copies of a run cost the sort no more than one, and each loses what a smaller document has."""
    text = np.frombuffer(bytes(range(33, 113)), np.uint8)
    size = np.array([len(text)], "<u4")
    blobs = [suffix_dedup.squeeze(np.array([d], "<i8"), np.array([0], "<u4"), np.array([7], "<u4"), size) for d in range(50)]
    data = suffix_dedup.pa.compress(text.tobytes(), "zstd", asbytes=True)
    rows = suffix_dedup.pd.DataFrame({"kind": 1, "bucket": 0, "block": range(50), "blob": blobs, "data": [data] * 50})
    sorted_, radix = [], suffix_dedup.radix_groups
    monkeypatch.setattr(suffix_dedup, "radix_groups", lambda data, start: sorted_.append(len(start)) or radix(data, start))
    got = {b: tuple(int(x[0]) for x in suffix_dedup.unsqueeze(blob, "<u4", "<u4", "<u4")) for b, blob in suffix_dedup._covers(rows)[["block", "blob"]].itertuples(index=False)}
    assert got == {b: (0, 7, len(text)) for b in range(1, 50)}
    assert sorted_ == [len(text) - suffix_dedup.SPAN + 1]


def test_runs_of_periodic_text_are_cut():
    """One hash over thousands of windows gives short strings, nearly all equal; no window is lost or told twice."""
    runs = suffix_dedup.Runs([(0, 5, 0, b"xyz" + b"abcdefgh" * 500), (1, 6, 0, b"abcdefgh" * 500)])
    assert runs.n.max() <= 64
    at, run = runs.spread(np.arange(len(runs.n)))
    assert list(zip(runs.docs[runs.piece[run]].tolist(), at.tolist())) == [(5, p) for p in range(4003 - 49)] + [(6, 4003 + p) for p in range(4000 - 49)]
    assert len({runs.data[a : a + n + 49].tobytes() for a, n in zip(runs.at, runs.n)}) < 20


def test_a_bucket_is_sorted_in_parts():
    """The memory for a bucket of strings stays far below what all of its windows take at once."""
    import tracemalloc

    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 30_000).astype(np.uint8).tobytes().decode() for _ in range(10)]
    ids = list(range(30))
    part = suffix_dedup.pa.RecordBatch.from_pydict({"doc_id": ids, "text": texts * 3})
    sink = suffix_dedup.pa.BufferOutputStream()
    with suffix_dedup.pa.ipc.new_stream(sink, part.schema) as writer:
        writer.write_batch(part)
    payload = sink.getvalue().to_pybytes()
    keys, counts = suffix_dedup._block_keys(payload)
    assert (counts == 3).all()
    blocks = suffix_dedup.pd.DataFrame({"block": [7], "payload": [payload]})
    got = suffix_dedup.pd.DataFrame({"blob": [suffix_dedup.squeeze(keys, np.ones(len(keys), np.uint8))]})
    rows = suffix_dedup._suffixes_out(1)(blocks, got)
    tracemalloc.start()
    covers = suffix_dedup._covers(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gone = {k: np.zeros(30_000, bool) for k in ids}
    for blob in covers["blob"]:
        for row, start, size in zip(*(x.tolist() for x in suffix_dedup.unsqueeze(blob, "<u4", "<u4", "<u4"))):
            gone[row][start : start + size] = True
    assert [k for k in ids if gone[k].any()] == [k for k in ids if gone[k].all()] == ids[10:]
    assert peak < 60 * sum(map(len, texts)) * 3, peak / sum(map(len, texts)) / 3


def test_ln_gamma():
    for x in (0.5, 1.0, 3.5, 100.5, 1e6):
        assert float(lm_scoring.ln_gamma(np.float64(x), np.log)) == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-9)


def test_context_trees_match_brute_force(clean):
    docs = clean.where("length(text) < 3000")
    got = {r.doc_id: r for r in lm_scoring.ctw_scores(docs).collect()}
    counts = defaultdict(lambda: [0, 0])

    def walk(text):
        x = b"\n" * 5 + b" ".join(simhash_dedup.word_bytes(text)) + b"\n"
        for t in range(5, len(x)):
            for k in range(8):
                node = (x[t] >> (8 - k)) + (1 << k)
                yield [(node, x[t - d : t]) for d in range(6)], x[t] >> (7 - k) & 1

    texts = _pairs(docs)
    for i, text in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for path, bit in walk(text):
                for p in path:
                    counts[p][bit] += 1
    below = defaultdict(list)
    for node, ctx in counts:
        if ctx:
            below[node, ctx[1:]].append((node, ctx))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted = {}
    for depth in range(5, -1, -1):
        for key, (a, b) in counts.items():
            if len(key[1]) == depth:
                own = kt(a, b)
                weighted[key] = own if depth == 5 else np.logaddexp(own, sum(weighted[q] for q in below[key])) + math.log(0.5)
    for i, text in texts.items():
        total = 0.0
        for path, bit in walk(text):
            mixed, rest, p = 0.0, 1.0, 0.5
            for depth, key in enumerate(path):
                if key not in counts:
                    break
                a, b = counts[key]
                one = (b + 0.5) / (a + b + 1)
                p = mixed + rest * one
                if depth < 5:
                    w = math.exp(math.log(0.5) + kt(a, b) - weighted[key])
                    mixed, rest = mixed + rest * w * one, rest * (1 - w)
            total += math.log10(p if bit else 1 - p)
        assert got[i].score == pytest.approx(total, rel=1e-5, abs=1e-6)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_archives_round_trip(spark):
    rows = [(i, f"https://www.site{i % 3}.example.com/p?q={i % 5}", "page " + "x" * (i % 4) + "é") for i in range(60)]
    rows += [(100, None, None), (101, "a\r\nb", ""), (102, "http://h/WARC/1.1", "WARC/1.1\r\n\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.capture_index(pages).collect()}
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    for i, _, html in rows:
        data, r = (html or "").encode(), got[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == i else ("revisit", first[html or ""]))
    ordered = sorted(got.values(), key=lambda r: r.capture_order)
    assert [r.capture_order for r in ordered] == list(range(len(rows)))
    keys = [(r.url_key, r.captured) for r in ordered]
    assert keys == sorted(keys)
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_loser_tree_merges():
    rng = random.Random(9)
    for k in range(0, 9):
        runs = [sorted(rng.choices("abcdef", k=rng.randint(0, 6))) for _ in range(k)]
        assert [runs[r][i] for r, i in warc.LoserTree(runs)] == sorted(x for r in runs for x in r)


def test_merge_takes_several_passes(spark):
    fields = warc.ENTRY
    rows = [(str(i), "response", None, "d", 1, f"k{i * 7 % 50:02d}", f"t{i % 3}", i % 150, 0, 1) for i in range(900)]
    out = warc.merged_index(spark.createDataFrame(rows, fields)).orderBy("capture_order").collect()
    keys = [(r.url_key, r.captured, int(r.page_id)) for r in out]
    assert keys == sorted(keys) and len(keys) == 900


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def _base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 14 <= len(digits) <= 19 and pii.luhn(digits), 10 <= len(digits) <= 15]
            if good[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pattern_spans():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice("a1@..+- ()9-4") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(text) == _base(text)
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == []


def test_field_finds_other_mentions(clean):
    got = {r.doc_id: r for r in pii.find_pii(clean).collect()}
    for i, text in _pairs(clean).items():
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in _base(text))
        assert got[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(got[i].spans.split(","))


def test_field_labels_a_number_without_its_prefix(spark):
    model = pii.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    text = "Call +1 (743) 555-3824 now, or dial 743-555-3824 later. Order 4381893557741600 is no card."
    base, spans = pii.all_spans(text, *model)
    at = text.index("743-555")
    assert set(base) < set(spans) and (at, 3, at + 12) in spans
    assert not any(text.index("4381") <= a < text.index(" is no") for a, _, _ in spans)


def test_crowded_shards_lose_no_link(spark):
    """One fingerprint and its neighbours crowd a shard: cut into blocks, it links as brute force does."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    close = [base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (150, 2))]
    far = [int(x) for x in rng.integers(1 << 62, size=150)]
    fps = sorted({base, *close, *far})
    nodes = spark.createDataFrame([(f, f, 0, None) for f in fps], "node bigint, fp bigint, band int, sketch binary")
    edges = simhash_dedup.link_edges(nodes, 3, shard=8).collect()
    up = {f: f for f in fps}

    def head(f):
        while up[f] != f:
            f = up[f]
        return f

    for e in edges:
        a, b = sorted((head(e["a"]), head(e["b"])))
        up[b] = a
    got = {f: head(f) for f in fps}
    up = {f: f for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = sorted((head(a), head(b)))
                up[y] = x
    assert got == {f: head(f) for f in fps}


def test_leaders_do_not_depend_on_the_group_size(spark):
    """A drifting chain: whoever goes is similar to a smaller document that stays, in parts of 4 as in one part."""
    rng, words, texts = random.Random(8), [f"w{k}" for k in range(200)], []
    for i in range(60):
        texts.append(" ".join(words))
        words[(i * 37) % 200 : (i * 37) % 200 + 5] = [f"x{i}_{k}" for k in range(5)]
    rng.shuffle(texts)
    sets = [set(simhash_dedup.shingle_hashes(simhash_dedup.word_bytes(t), 5).tolist()) for t in texts]
    want = []
    for i in range(60):
        if not any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in want):
            want.append(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for part in (4, 512):
        assert sorted(r.doc_id for r in simhash_dedup.keep_leaders(docs, part=part).collect()) == want


def test_repeats_inside_a_text_do_not_hide_its_copy(spark):
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words + 2 * words[-100:]), " ".join(f"v{k}" for k in range(400))]
    kept = simhash_dedup.keep_leaders(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_copies_at_the_threshold_meet(spark):
    """Pairs of similarity 0.8 to 0.82, among them many whose fingerprints differ in more than 12 bits."""
    rng, rows, far = random.Random(11), [], 0
    while len(rows) < 120:
        words = [f"w{len(rows)}_{rng.random()}" for _ in range(204)]
        other = list(words)
        for k in rng.sample(range(204), 5):
            other[k] += "x"
        a, b = (np.unique(simhash_dedup.shingle_hashes(simhash_dedup.word_bytes(" ".join(w)), 5)) for w in (words, other))
        common = len(np.intersect1d(a, b))
        if 0.8 <= common / (len(a) + len(b) - common) <= 0.82:
            far += bin((simhash_dedup.simhash(a) ^ simhash_dedup.simhash(b)) % (1 << 64)).count("1") > 12
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
    kept = simhash_dedup.keep_leaders(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert far > 0 and sorted(r.doc_id for r in kept.collect()) == list(range(0, 120, 2))


def test_letters_that_lower_to_more_do_not_hide_mentions():
    for lead in ("", "\u0130stanbul: "):
        text = lead + "Write to Jane.Roe@example.org today; jane.roe will answer."
        found = [text[a:b] for a, b, _ in pii.tokens_of(text, pii.base_spans(text))]
        assert found == ["Jane.Roe@example.org", "jane.roe"]
    assert pii._shape("9" * 70 + "-x") == "9" * 70 + "-a"


def test_field_carries_evidence_to_every_mention():
    """Potentials that say nothing: only the number with its prefix, first or last, tells what the others are."""
    mentions = [(20 * i, 20 * i + 12, "743-555-3824") for i in range(1, 31)]
    for at, tokens in ((0, [(0, 17, "+1-743-555-3824"), *mentions]), (30, [*mentions, (700, 717, "+1-743-555-3824")])):
        fixed = [4 if i == at else 0 for i in range(31)]
        p = pii._beliefs(tokens, np.zeros((pii.FEATURES + 1, 5)), np.zeros((5, 5)), fixed)
        assert (p.argmax(1) == 4).all() and p[:, 4].min() >= pii.BELIEF


def test_quality_tells_labelled_documents_apart(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = quality_rules.quality_report(docs).where("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    assert {r.quality for r in got} == {0, 1} and all(r.kept == (r.quality == 1) for r in got)


def test_joined_words_equal_the_tokenizer():
    """Words learned together, ASCII or not, with and without special tokens, and texts without words."""
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(TOKENIZER), packing.WordEncoder(TOKENIZER)
    texts = ["The the THE. the!! don't 'Ts ''s 12 3a4 a-b_c", "", "J̌ ǰx İI ΣΑΣ café ﬁn", " 　 ", "plain words, twice; plain words", "x<|endoftext|>y z", "the\x1cthe\x1fend"]
    for some in (texts[:5], texts):
        assert [x.tolist() for x in encoder.encode(some)] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
    encoder.pieces = None  # a tokenizer without such a pattern: one by one
    encoder.clear()
    assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_masked_searches_lose_no_pair():
    """Pairs within 3 bits have a half within 1: trees over both halves find all, crowded halves too."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 3, replace=False)) for _ in base], dtype=np.uint64)
    crowd = (base[0] & simhash_dedup.HALVES[1]) | rng.integers(0, 1 << 10, 200, dtype=np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips, crowd]))
    want = {(a, b) for a in range(len(fps)) for b in range(len(fps)) if int(fps[a] ^ fps[b]).bit_count() <= 3}
    met = set()
    for half in simhash_dedup.HALVES:
        row, leaf, own = simhash_dedup.Tree(np.unique(fps & half), 3).visits(fps & half, 1)
        for shard in np.unique(leaf):
            here, mine = row[leaf == shard], row[(leaf == shard) & own]
            for i, j in simhash_dedup.near_pairs(fps[mine], fps[here], 3, half, 1):
                met |= set(zip(mine[i].tolist(), here[j].tolist()))
    assert met == want
