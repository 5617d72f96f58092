"""Literal queries over whole tables against plain Python."""

import re

from tessera.functions import literals
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
WIDE = r"[\t-\r    -     　﻿]"


def found(pattern, group, text):
    return [m.group(group) for m in re.finditer(pattern, text or "", re.ASCII)]


def distinct(xs):
    return list(dict.fromkeys(xs))


def compact(x):
    return re.sub("^ | $", "", re.sub(f"{WIDE}+", " ", x))


def evidence(text):
    out = []
    for i, (pattern, group, cap) in enumerate(literals.EVIDENCE):
        mine = [re.sub(f"^{WIDE}+|{WIDE}+$", "", compact(x)[:180]) for x in found(pattern, group, text)]
        mine = distinct(x for x in mine if len(x) >= 2)
        if i == 5:
            mine.sort(key=lambda x: (not x.startswith("/"), -len(x), x))
        out += mine[:cap]
    return distinct(out)[:128]


def concepts(text):
    inline = found(r"`([^`\n]{2,80})`", 1, text)
    tokens = [t for t in found(r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_.:/-]{2,}(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])", 0, text) if t.lower() not in literals.STOP and (re.search("[A-Z0-9_./:-]", t) or len(t) >= 10)]
    return distinct(x for x in map(compact, inline + tokens) if x)[:16]


def test_paths_of_pages(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = catalogue.QUERIES["path_literals"](spark, SF).collect()
    assert {r.page_id: r.p for r in got} == {i: distinct(found(literals.PATH, 1, t))[:20] for i, t in html.items()} and any(r.n_paths for r in got)


def test_evidence_of_pages_with_all_groups(spark):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r.literals for r in catalogue.QUERIES["evidence_quota"](spark, SF).collect()}
    assert got == {i: evidence(t) for i, t in html.items()}
    text = "- `keep me`\nuv run job.py --x\nERR_42 in src/app/main.py, /abs/path and application/json `inline code`\n@@file src/b.py\n" + " ".join(f"wording{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40))
    mine = spark.createDataFrame([(text,)], ["t"]).select(literals.evidence("t").alias("l")).first().l
    assert mine == evidence(text) and any(x.startswith("wording") for x in mine)


def test_concepts_of_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.concepts for r in catalogue.QUERIES["concepts"](spark, SF).collect()} == {i: concepts(t) for i, t in texts.items()}
