"""Sentence selection stays within a row: texts are dealt once, terms are counted once, nothing is sorted or joined by task."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest

from tessera.operators import dspc
from tessera.plans import catalogue as queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dspc_selected", "dspc_query_terms", "dspc_tokens_df_idf", "dspc_stage1"])
def test_counts_once_in_the_row(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("Exchange"), plan.count("ArrowEvalPython [")) == (1, 1)
    assert not re.search("Window|Join|Aggregate|Sort |MapInArrow", plan)
    below = plan[plan.index("Exchange") :]
    assert "regexp_extract_all" not in below and "(?<=" not in below  # texts are cut behind the exchange, once
    assert plan.count("(?<=") == 1


def test_parts_lose_no_words(spark, monkeypatch):
    bodies = [[["a", "b", "a"], [], ["b"]], [], [["c"] * 9, ["a"]], [["b"], ["b"], ["d", "a"]]]
    whole = dspc._sums(pa.array(bodies)).to_pylist()
    for words in (1, 2, 7):
        monkeypatch.setattr(dspc, "WORDS", words)
        assert dspc._sums(pa.array([[["x"]], *bodies]).slice(1)).to_pylist() == whole
    for body, sums in zip(bodies, whole, strict=True):
        tf, df = Counter(t for s in body for t in s), Counter(t for s in body for t in set(s))
        idf = {t: math.log(len(body) / df[t]) for t in df}
        assert [x["m"] for x in sums] == [len(s) for s in body]
        assert [x["told"] for x in sums] == pytest.approx([sum(idf[t] for t in s) for s in body])
        assert [x["salient"] for x in sums] == pytest.approx([sum(tf[t] * idf[t] for t in s) for s in body])
