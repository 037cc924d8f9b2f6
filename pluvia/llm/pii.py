"""Personal data by patterns and a skip-chain conditional random field.

Patterns find e-mail addresses, IP addresses, card and phone numbers; these spans stay. The field
labels every token that holds a digit or '@', or equals the local part of an address found in its
document. Its local potentials are log-odds of hashed token features, and its chain potentials
those of neighbouring labels, both counted over all documents against the patterns' labels
(`FEATURES` counters, whatever the corpus). Tokens of a document that are the same but for
separators, or end in the same digits, share a skip potential that favours equal labels; each
occurrence is joined to the next and to the first one of each label that patterns gave, so edges
stay linear and what a pattern found reaches every mention directly. Loopy belief propagation passes
messages along both kinds of edges until they change by less than `TOLERANCE`; a token whose belief
in a label passes `BELIEF` becomes a span, if no pattern span touches it. What a pattern found and its checksum or range ruled out is labelled
none. A number written without its prefix is so found by its other mentions.

Defined results: a NULL text is empty and has no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
#: The base patterns, written so that a failed start is not tried again inside its run.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"[^ \t-\r]+")
MARKED = re.compile(r"[^ \t-\r]*[0-9@][^ \t-\r]*")
#: Lower case of A-Z alone: lengths and offsets stay.
LOWER = {c: c + 32 for c in range(65, 91)}
EDGE = " \"'()[]{}<>,;:.!?#*$%&|"

FEATURES, TOLERANCE, BELIEF, SKIP = 16_384, 1e-3, 0.6, 3.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """Every '@' takes the run of local characters before it, back to the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and LOCAL.match(text, begin - 1):
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the pattern matches that hold, and of those a range or checksum rules out."""
    good, bad = [(a, 0, b) for a, b in emails(text)], []
    for m in IP.finditer(text):
        fits = all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in m.group().split("."))
        (good if fits else bad).append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 14 <= len(digits) <= 19:
            (good if luhn(digits) else bad).append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        fits = 10 <= sum(c.isdigit() for c in m.group()) <= 15
        (good if fits else bad).append((m.start(), 3, m.end()))
    return sorted(good), sorted(bad)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all pattern matches, by start and kind."""
    return matches(text)[0]


def _shape(token: str) -> str:
    s = re.sub("[0-9]", "9", re.sub(r"[^\W\d_]", "a", token))
    return re.sub(r"a+", "a", s)


def tokens_of(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, core) of the labelled tokens, punctuation around them left out."""
    found = [(m.start(), m.group()) for m in MARKED.finditer(text)]
    names = {text[a:b].split("@")[0].translate(LOWER) for a, k, b in base if k == 0}
    if names:
        low = text.translate(LOWER)
        for name in names:
            at = low.find(name)
            while at >= 0:
                m = TOKEN.match(text, at)
                if (not at or text[at - 1].isspace()) and m and m.group().strip(EDGE).translate(LOWER) == name:
                    found.append((at, m.group()))
                at = low.find(name, at + 1)
    out = []
    for at, raw in sorted(set(found)):
        core = raw.strip(EDGE)
        if core:
            begin = at + raw.index(core)
            out.append((begin, begin + len(core), core))
    return out


def _labels(tokens: list, base: list) -> list[int]:
    """Pattern label of every token: 0 none, else kind + 1."""
    out, spans = [], sorted(base)
    starts = np.array([s[0] for s in spans])
    reach = np.maximum.accumulate([s[2] for s in spans]) if spans else np.empty(0)
    for a, b, _ in tokens:
        label, i = 0, int(np.searchsorted(starts, b)) - 1
        while i >= 0 and reach[i] > a:
            if spans[i][2] > a:
                label = spans[i][1] + 1
            i -= 1
        out.append(label)
    return out


def _features(core: str) -> list[int]:
    shape = _shape(core)
    digits = sum(c.isdigit() for c in core)
    names = ["s:" + shape, f"d:{min(digits, 20)}", "@" if "@" in core else "-", f"p:{shape[:4]}", f"e:{shape[-4:]}"]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def _keys(core: str) -> list[str]:
    """What a token shares with its other mentions."""
    digits = re.sub("[^0-9]", "", core)
    keys = ["t:" + core.lower()]
    if len(digits) >= 7:
        keys += ["n:" + digits, "l:" + digits[-7:]]
    if "@" in core:
        keys.append("t:" + core.split("@")[0].lower())
    return keys


def _counts(frames):
    """(slot, label, n): features by label, then label pairs of neighbours behind them."""
    for pdf in frames:
        seen = np.zeros((FEATURES + 5, 5), np.int64)
        for text in pdf["text"]:
            text = text or ""
            base = base_spans(text)
            tokens = tokens_of(text, base)
            labels = _labels(tokens, base)
            for (_, _, core), y in zip(tokens, labels):
                for f in _features(core):
                    seen[f, y] += 1
            for y, z in zip(labels, labels[1:]):
                seen[FEATURES + y, z] += 1
        slot, label = np.nonzero(seen)
        yield pd.DataFrame({"slot": slot, "label": label, "n": seen[slot, label]})


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Local and chain potentials from counts over all documents; their size is fixed."""
    rows = docs.select("text").mapInPandas(_counts, "slot bigint, label bigint, n bigint").groupBy("slot", "label").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros((FEATURES + 5, 5))
    for slot, label, n in rows:
        seen[slot, label] = n
    local, chain = seen[:FEATURES], seen[FEATURES:]
    prior = local.sum(0) + 1.0
    prior /= prior.sum()
    share = (local + 2 * prior) / (local.sum(1, keepdims=True) + 2)
    weight = np.log(share) - np.log(prior)
    pair = (chain + 5 * prior) / (chain.sum(1, keepdims=True) + 5)
    # the prior enters once per token; features of one token overlap, so each counts for a half
    return np.concatenate([weight / 2, np.log(prior)[None]]), np.log(pair) - np.log(prior)


def _beliefs(tokens: list, local: np.ndarray, chain: np.ndarray, fixed: list[int]) -> np.ndarray:
    """Marginals by loopy belief propagation; pattern labels, and -1 for none of them, are evidence."""
    n = len(tokens)
    score = np.array([local[_features(core)].sum(0) + local[-1] for _, _, core in tokens])
    for i, y in enumerate(fixed):
        if y:
            score[i] = -30.0
            score[i, max(y, 0)] = 0.0
    edges = [(i, i + 1, 0) for i in range(n - 1)]
    linked = set()
    keys = [_keys(core) for _, _, core in tokens]
    proof: dict[str, dict[int, int]] = {}  # the first mention of a key with each label of a pattern
    for i, y in enumerate(fixed):
        if y:
            for key in keys[i]:
                proof.setdefault(key, {}).setdefault(y, i)
    last: dict[str, int] = {}
    for i in range(n):
        for key in keys[i]:
            near = [last[key]] if key in last else []
            if not fixed[i]:
                near += proof.get(key, {}).values()
            linked.update((min(i, j), max(i, j), 1) for j in near if j != i)
            last[key] = i
    edges += sorted(linked)
    if not edges:
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)
    a, b, kind = np.array(edges).T
    table = np.stack([chain, SKIP * np.eye(5)])
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([table[kind], table[kind].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), 5))
    step = 0.5
    # evidence crosses a document of n tokens in n rounds; the bound stops loops that never settle
    for turn in range(1, 64 + 2 * n):
        belief = score.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        joint = out[:, :, None] + pot
        top = joint.max(1)
        new = top + np.log(np.exp(joint - top[:, None, :]).sum(1))
        new -= new.max(1, keepdims=True)
        change = np.abs(new - message).max()
        message += step * (new - message)
        if change < TOLERANCE:
            break
        if turn % 64 == 0:  # loops that swing are damped more
            step *= 0.75
    belief = score.copy()
    np.add.at(belief, target, message)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(text: str, local: np.ndarray, chain: np.ndarray) -> tuple[list, list]:
    """Pattern spans, and spans with those the field adds."""
    base, bad = matches(text)
    tokens = tokens_of(text, base)
    # a number that fails its checksum or range is evidence against a label, unless a span touches it
    fixed = [y or -min(1, z) for y, z in zip(_labels(tokens, base), _labels(tokens, bad))]
    if all(fixed) or not tokens:
        return base, base
    p = _beliefs(tokens, local, chain, fixed)
    label = p.argmax(1)
    more = [(a, int(y) - 1, b) for (a, b, _), y, f, q in zip(tokens, label, fixed, p.max(1)) if not f and y and q >= BELIEF]
    return base, sorted(base + more)


def _joined(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """One row per document: pattern counts and digest, and all spans."""
    local, chain = fit(docs)
    model = docs.sparkSession.sparkContext.broadcast((local, chain))

    def run(frames):
        for pdf in frames:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                base, spans = all_spans(text or "", *model.value)
                n = [sum(k == i for _, k, _ in base) for i in range(4)]
                out.append((doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans) - len(base)))
            yield pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return docs.select("doc_id", "text").mapInPandas(run, fields)
