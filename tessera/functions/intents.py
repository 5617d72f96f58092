"""What a user's message asks for, by word lists tested in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import word

#: The word lists.
CONSTRAINT = "do not|don't|never|must|always|required|require|preserve|keep|avoid|only"
SAFETY = "secret|credential|token|key|password|safety|security|private"
CORRECTION = "actually|correction|instead|scratch that|not that|supersede"
PREFERENCE = "prefer|preference|style|tone|format"
STRONG = "do not|don't|never|must|required|preserve|keep"
RANKS = {"must_keep": 0, "high": 1, "normal": 2, "low": 3}


def kind(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(t.rlike(word(CONSTRAINT)), "constraint").when(t.rlike(word(SAFETY)), "safety")
    return out.when(t.rlike(word(CORRECTION)), "correction").when(t.rlike(word(PREFERENCE)), "preference").otherwise("request")


def priority(kind: Column, text: Column) -> Column:
    strong = F.lower(F.coalesce(text, F.lit(""))).rlike(word(STRONG))
    return F.when(kind == "safety", "must_keep").when(strong | kind.isin("correction", "constraint"), "high").otherwise("normal")


def rank(priority: Column) -> Column:
    out = F.when(priority == "must_keep", 0).when(priority == "high", 1)
    return out.when(priority == "low", 3).otherwise(2)
