"""Secret scan: candidates by shape or place, false positives removed by a random forest.

Candidates are runs of 16 key characters and more with a letter and a digit, of any length, and values
of six characters and more that are assigned to a name such as ``password`` or ``token``, whatever they
are made of. Features are a candidate's length, shares of character kinds, transitions between kinds,
entropy, surprise of its letter pairs, how much of it dictionary words cover, and what stands around it:
the words before and after, an assignment, quotes, a path or URL. The forest is trained in numpy on
labelled findings, whose number is bounded; ``labelled`` takes such findings from documents by a rule,
``made_findings`` makes some of both kinds.

Defined cases: null and empty texts have no candidates; repeated rows give repeated findings; an
``=`` belongs to a candidate only as padding at its end; with findings of one class only, every
candidate gets that class, without any the probability is 0; columns other than those named are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernel

SHORTEST, AROUND = 16, 48
#: Characters of an assigned value at least.
ASSIGNED = 6
#: Words that go with secrets, words that go with other long strings, dictionary words.
SECRET_WORDS = "access api apikey auth authorization bearer credential credentials key passphrase passwd password private pwd secret signing token".split()
OTHER_WORDS = "blob build checksum commit digest etag example file fixture guid hash href html http https id image img md5 placeholder ref release revision sample sha sha1 sha256 src test url uuid version www".split()
DICTIONARY = SECRET_WORDS + OTHER_WORDS + "account admin alpha application archive article asset backup base beta branch bucket button cache client cluster code color common config connection console container content control core count customer data database date debug default demo deploy device display document domain download east element email engine entry error event feature field final folder footer format frame gateway global graph group handler header helper home host icon index info input instance internal item java job label layer layout library line link list local login main manager master media member menu message meta method metric mobile model module monitor name network node north note number object offer option order output package page panel parent part path pattern payment photo platform player plugin point policy pool port post preview primary print process product production profile program project property provider public query queue record region remote report request resource response result return role route sales schema screen script search section server service session setting shared simple site size source south space stage staging start state static status storage store stream string style summary support system table target task team template text theme thread time title tool topic total trace track type update upload user value video view web west widget window word work worker world zone".split()

KEY = np.zeros(256, bool)
KEY[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-"]] = True
DIGIT, ALPHA = np.zeros(256, bool), np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

_WORD = re.compile(rb"[A-Za-z][A-Za-z0-9]*")
_VALUE = re.compile(rb"(?i)(?<![A-Za-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key)s?[\"'`]?\s{0,4}[:=]{1,2}\s{0,4}([\"'`]?)([^\s\"'`]{6,})")
#: Between texts: more white space than an assignment may hold, so no match crosses it.
_BETWEEN = b"\n" * 5
_PARTS = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+")


def candidates(texts: kernel.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last byte (exclusive) of every candidate of a slice."""
    d = texts.data
    if not len(d):
        return (np.zeros(0, np.int64),) * 3
    mask = KEY[d]
    edge = np.zeros(len(d) + 1, bool)
    edge[texts.offsets] = True
    begins, stops = mask.copy(), mask.copy()
    begins[1:] &= ~mask[:-1] | edge[1:-1]
    stops[:-1] &= ~mask[1:] | edge[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    digits, letters = (np.concatenate(([0], np.cumsum(kind[d]))) for kind in (DIGIT, ALPHA))
    take = (e - s >= SHORTEST) & (digits[e] > digits[s]) & (letters[e] > letters[s])
    s, e = s[take], e[take]
    limit = texts.offsets[np.searchsorted(texts.offsets, s, "right")] if len(s) else s
    for _ in range(2):  # padding
        e = e + ((e < limit) & (d[np.minimum(e, len(d) - 1)] == ord("=")))
    raw = _BETWEEN.join([texts.text(i) for i in range(texts.n)])
    found = [(m.start(2), m.end(2)) for m in _VALUE.finditer(raw)]
    if found:
        a, b = np.array(found).T
        own = np.searchsorted(texts.offsets + len(_BETWEEN) * np.arange(texts.n + 1), a, "right") - 1
        a, b = a - len(_BETWEEN) * own, b - len(_BETWEEN) * own
        enough = b - a >= ASSIGNED
        a, b = a[enough], b[enough]
        free = np.ones(len(s), bool)  # runs that no assigned value covers
        at = np.searchsorted(a, s, "right") - 1
        free[at >= 0] = s[at >= 0] >= b[at[at >= 0]] if len(a) else True
        s, e = np.concatenate((s[free], a)), np.concatenate((e[free], b))
        order = np.argsort(s)
        s, e = s[order], e[order]
    return np.searchsorted(texts.offsets, s, "right") - 1, s, e


def _pair_surprise() -> np.ndarray:
    seen = np.ones((26, 26))
    for w in DICTIONARY:
        for a, b in zip(w, w[1:], strict=False):
            if a.isalpha() and b.isalpha():
                seen[ord(a) - 97, ord(b) - 97] += 1
    return -np.log2(seen / seen.sum(1, keepdims=True))


_SURPRISE = _pair_surprise()
_WORDS = {w for w in DICTIONARY if len(w) > 2}
FEATURES = ["length", "digits", "upper", "lower", "symbols", "transitions", "distinct", "entropy", "surprise", "dictionary", "hex", "dashes", "longest_repeat", "steps", "secret_before", "other_before", "other_after", "assigned", "quoted", "slash_before", "slashes", "gap"]


def features(value: bytes, before: bytes, after: bytes) -> list[float]:
    x = np.frombuffer(value, np.uint8).astype(np.int64)
    n = len(x)
    kind = np.select([DIGIT[x], (x >= 65) & (x <= 90), (x >= 97) & (x <= 122)], [0, 1, 2], 3)
    share = np.bincount(kind, minlength=4) / n
    p = np.bincount(x)
    p = p[p > 0] / n
    low = np.where((x >= 65) & (x <= 90), x + 32, x) - 97
    pair = (low[:-1] >= 0) & (low[:-1] < 26) & (low[1:] >= 0) & (low[1:] < 26)
    surprise = float(_SURPRISE[low[:-1][pair], low[1:][pair]].mean()) if pair.any() else 8.0
    covered = sum(len(w) for w in _PARTS.findall(value) if w.lower().decode() in _WORDS)
    same = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
    words_before = {w.lower().decode() for w in _WORD.findall(before)[-3:]}
    words_after = {w.lower().decode() for w in _WORD.findall(after)[:2]}
    tail = before.rstrip(b" \t\"'`")
    return [
        n, *share, float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0, len(p) / n, float(-(p * np.log2(p)).sum()), surprise, covered / n,
        float(all(c in b"0123456789abcdefABCDEF-" for c in value)), float((x == 45).sum()), float(np.diff(same).max()) / n, float((np.abs(np.diff(x)) == 1).mean()) if n > 1 else 0.0,
        float(any(w in SECRET_WORDS or any(s in w for s in ("token", "secret", "passw", "apikey")) for w in words_before)), float(any(w in OTHER_WORDS for w in words_before)), float(any(w in OTHER_WORDS for w in words_after)),
        float(tail[-1:] in (b"=", b":")), float(before[-1:] in (b'"', b"'", b"`")), float(before[-1:] in (b"/", b".", b"#")), float((x == 47).sum()), float(len(before) - len(tail)),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left child, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, threshold, child, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := feature[at] >= 0).any():
                go = np.flatnonzero(inner)
                right = x[go, feature[at[go]]] > threshold[at[go]]
                at[go] = child[at[go]] + right
            out += share[at]
        return out / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int):
    feature, threshold, child, share = [-1], [0.0], [0], [float(y.mean())]
    todo = [(0, np.arange(len(y)), 0)]
    while todo:
        node, rows, level = todo.pop()
        mine = y[rows]
        if level == depth or len(rows) < 2 * least or mine.min() == mine.max():
            continue
        best = None
        for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
            v = x[rows, f]
            for t in np.unique(np.quantile(v, np.linspace(0.05, 0.95, 12))):
                left = v <= t
                n = int(left.sum())
                if least <= n <= len(rows) - least:
                    p, q = mine[left].mean(), mine[~left].mean()
                    cost = n * p * (1 - p) + (len(rows) - n) * q * (1 - q)
                    if best is None or cost < best[0]:
                        best = (cost, f, t, left)
        if best is None:
            continue
        _, feature[node], threshold[node], left = best
        child[node] = len(feature)
        for part in (rows[left], rows[~left]):
            todo.append((len(feature), part, level + 1))
            feature.append(-1), threshold.append(0.0), child.append(0), share.append(float(y[part].mean()))
    return np.array(feature), np.array(threshold), np.array(child), np.array(share)


def fit(findings: list[tuple], trees: int = 31, depth: int = 9, least: int = 3, seed: int = 7) -> Forest:
    """Trains on labelled findings (value, before, after, 1 for a secret), of strings or bytes."""
    raw = lambda s: s.encode() if isinstance(s, str) else s
    x = np.array([features(raw(v), raw(a)[-AROUND:], raw(b)) for v, a, b, _ in findings]).reshape(len(findings), len(FEATURES))
    y = np.array([f[3] for f in findings], float)
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees if len(y) else 0):
        rows = rng.integers(0, len(y), len(y))
        out.append(_tree(x[rows], y[rows], rng, depth, least))
    return Forest(out)


def made_findings(n: int = 4000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """Labelled findings by rule, half of them secrets: random keys in assignments, and look-alikes."""
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]
    text = lambda k: " ".join(r.choice(DICTIONARY) for _ in range(k))
    draw = lambda a, k: "".join(r.choice(a) for _ in range(k))
    out = []
    while len(out) < n:
        if len(out) % 2 == 0:
            value = draw(r.choice(alphabets), r.choice([20, 24, 32, 36, 40, 43, 48, 64]))
            name = r.choice(SECRET_WORDS) if r.random() < 0.5 else f"{r.choice(DICTIONARY)}_{r.choice(SECRET_WORDS)}"
            q = r.choice(['"', "'", ""])
            before = f"{text(3)} {name}{r.choice([' = ', '=', ': ', ' : ', ' '])}{q}"
            out.append((value, before, f"{q} {text(2)}", 1))
            continue
        kind = r.randrange(7)
        before, after = f"{text(3)} ", f" {text(2)}"
        if kind == 0:
            value = "-".join(draw("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))
            before += r.choice(["id ", "uuid: ", "guid="])
        elif kind == 1:
            value = draw("0123456789abcdef", r.choice([32, 40, 64]))
            before += r.choice(["commit ", "sha256:", "md5 ", "digest ", "etag ", "checksum: "])
        elif kind == 2:
            value = "/".join(r.choice(DICTIONARY) for _ in range(r.randrange(3, 6))) + str(r.randrange(1000))
            before += r.choice(["https://www.example.com/", "src=\"/", "./"])
        elif kind == 3:
            value = r.choice(["_", "-"]).join(r.choice(DICTIONARY) for _ in range(r.randrange(3, 5))) + f"_{r.randrange(100)}"
        elif kind == 4:
            value = r.choice(["x", "X", "0", "a1"]) * r.randrange(16, 30) + str(r.randrange(10)) + "a"
            before += f"{r.choice(SECRET_WORDS)} = \""
        elif kind == 5:
            value = f"your{r.choice(['_', '-'])}{r.choice(SECRET_WORDS)}_{r.choice(['here', 'example', 'value'])}{r.randrange(1000)}"
            before += f"{r.choice(SECRET_WORDS)} = \""
        else:
            value = "".join(r.choice(DICTIONARY).capitalize() for _ in range(r.randrange(2, 5))) + str(r.randrange(1, 99))
        if len(value) >= SHORTEST:
            out.append((value, before, after, 0))
    return out


#: Findings that are taken from documents at most.
LABELLED = 4000
_ASSIGNED_TO = re.compile(rb"(?i)(?:pass(?:word|wd|phrase)?|pwd|secret|token|credential|api[_-]?key|access[_-]?key)s?[\"'`]?\s{0,4}[:=]{1,2}\s{0,4}[\"'`]?$")


@kernel.released
def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in kernel.slices(kernel.column(batch, "text")):
            own, s, e = candidates(texts)
            d, off = texts.data, texts.offsets
            cut = lambda a, b: [d[i:j].tobytes() for i, j in zip(a, b, strict=True)]
            before = cut(np.maximum(s - AROUND, off[own]), s)
            yield pa.RecordBatch.from_arrays([pa.array(cut(s, e), pa.binary()), pa.array(before, pa.binary()), pa.array(cut(e, np.minimum(e + AROUND, off[own + 1])), pa.binary()), pa.array([int(_ASSIGNED_TO.search(b) is not None) for b in before], pa.int32())], names=["value", "before", "after", "label"])


def labelled(docs: DataFrame, most: int = LABELLED) -> list[tuple[bytes, bytes, bytes, int]]:
    """At most ``most`` findings from (doc_id, text) as fit takes them, chosen by a hash of the value: secrets are what is assigned to a secret's name.

    Findings of one value and label count once. Rows whose crc32(doc_id) mod 4 is 2 are left out, to measure on.
    """
    rows = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 != 2).select(F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_sampled, "value binary, before binary, after binary, label int").groupBy("value", "label").agg(F.min(F.struct("before", "after")).alias("x"))
    chosen = found.orderBy(F.xxhash64("value", "label"), "value").limit(most).collect()
    return [(bytes(r.value), bytes(r.x.before), bytes(r.x.after), r.label) for r in chosen]


FOUND = "doc_id long, start long, n_chars long, value_sha256 string, probability double"


def _scan(forest):
    @kernel.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = kernel.column(batch, "doc_id")
            for texts in kernel.slices(kernel.column(batch, "text")):
                own, s, e = candidates(texts)
                if not len(own):
                    continue
                d, off = texts.data, texts.offsets
                lead = np.concatenate(([0], np.cumsum((d & 0xC0) != 0x80)))  # code points before each byte
                lo, hi = np.maximum(s - AROUND, off[own]), np.minimum(e + AROUND, off[own + 1])
                values = [d[a:b].tobytes() for a, b in zip(s, e, strict=True)]
                x = np.array([features(v, d[a:b].tobytes(), d[c:f].tobytes()) for v, a, b, c, f in zip(values, lo, s, e, hi, strict=True)])
                yield pa.RecordBatch.from_arrays([doc.take(pa.array(own + texts.first)), pa.array(lead[s] - lead[off[own]]), pa.array(e - s), pa.array([hashlib.sha256(v).hexdigest() for v in values]), pa.array(forest.value.probability(x))], names=["doc_id", "start", "n_chars", "value_sha256", "probability"])

    return run


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """Every candidate of (doc_id, text): place in code points, digest, and probability of a secret."""
    cast = docs.sparkSession.sparkContext.broadcast(forest)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan(cast), FOUND)
