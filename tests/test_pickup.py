"""Commands and paths of whole pages are cleaned once each; white space is cut by character."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import literals, text


@pytest.mark.parametrize(("made", "most"), [(lambda x: literals.is_command(x), 1), (lambda x: literals.is_path(x), 1), (lambda x: literals.next_command(F.array(x), F.lit("")), 4)])
def test_cleans_a_text_once(spark, made, most):
    # Of a next command: what is given, asked and cleaned, what is offered, and the one that is taken.
    df = spark.createDataFrame([("",)], "x string").select(made(F.col("x")).alias("y"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("`.*`") <= most


def test_commands_stay_as_they_were(spark):
    rows = [("`git push.`", True), ("(npm test。)\n", True), ("'a", False), ("`", False), ("  npm run x ", True), ("note: git push", False), (None, False), ("", False)]
    got = spark.createDataFrame([(x,) for x, _ in rows], "x string").select("x", literals.is_command(F.col("x")).alias("y"), literals.next_command(F.array("x"), F.lit("")).alias("c")).collect()
    assert [r.y for r in got] == [y for _, y in rows]
    assert [r.c for r in got] == ["git push", "npm test。)", "", "", "npm run x", "git push", "", ""]


def test_trims_white_space_alone(spark):
    assert set(text.WS_CHARS) == {c for c in map(chr, range(0x110000)) if re.match(text.WS, c)}
    texts = [text.WS_CHARS + "a b" + text.WS_CHARS, text.WS_CHARS, "", "a \x85", "​ a　"]
    got = [r.y for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(text.trim_ws(F.col("x")).alias("y")).collect()]
    assert got == ["a b", "", "", "a \x85", "​ a"]  # a line end that isn't white space doesn't lose the space before it
