"""Fill-in-the-middle against a plain version, and its big-integer steps one by one."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tessera.llm import infill
from tests.llm.test_operators import docs_of


def plain(text, doc_id, seed, rate, spm):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < spm:
        return n, "spm", len(x), len(m), f"<S>{s}<P>{x}<M>{m}"
    return n, "psm", len(x), len(m), f"<P>{x}<S>{s}<M>{m}"


def texts(n=400, seed=1):
    r = random.Random(seed)
    symbols = [*"ab é中😀\x00\r  \x0b<>PSM", "\n", "\n", "\n", "<P", "S>", "\r\n"]
    out = ["".join(r.choice(symbols) for _ in range(r.randrange(80))) for _ in range(n)]
    return [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb", "x <P> y\nz", "<S>", "tail <", "<P", "a\n" * 40_000, "é" * 70_000, *out]


def test_transformation_matches_the_plain_version(spark):
    rows = [*enumerate(texts()), (None, "no\nid\nat all"), (5, "again\n5\n"), (5, "again\n5\n")]
    for keys in ({}, {"seed": 3, "rate": 40, "spm": 10}):
        got = infill.fill_in_middle(docs_of(spark, rows), **keys).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        seed, rate, spm = keys.get("seed", 7), keys.get("rate", 100), keys.get("spm", 50)
        order = lambda x: str(x)
        assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=order) == sorted(((i, *plain(t or "", i, seed, rate, spm)) for i, t in rows), key=order)
        assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in rows)
        assert {"plain", "spm", "psm"} == {r.form for r in got}


def test_empty_table(spark):
    assert infill.fill_in_middle(docs_of(spark, [(1, "x")]).where("false")).collect() == []


def test_select_finds_every_line():
    r = random.Random(2)
    for text in [t.encode() for t in texts(60) if t and len(t) < 1000]:
        starts = infill.line_starts(text)
        want = [m.start() for m in re.finditer(rb"[^\n]*\n|[^\n]+", text)]
        assert starts.bit_count() == len(want)
        assert [infill.select(starts, k, 8 * len(text)) for k in range(len(want))] == [8 * x for x in want]
        assert [infill.cut(text, starts, len(want), k) for k in range(len(want) + 1)] == [*want, len(text)]
    bits = r.getrandbits(5000)
    assert [infill.select(bits, k, 5000) for k in range(bits.bit_count())] == [i for i in range(5000) if bits >> i & 1]


def test_code_points_are_counted_by_class():
    for text in ("é中😀x", "", "plain"):
        assert infill.mask(text.encode(), infill._CODE_POINT).bit_count() == len(text)
