"""Settings of a compaction: keys, kinds and ranges, checked before anything runs.

Keys are those of a session's configuration under ``tessera.``; a mapping given beside it comes first. What
depends on other settings (until when to ask again, temperature, prompt adaptation) is derived in one place.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession

PREFIX = "tessera."


class SettingError(ValueError):
    pass


@dataclass(frozen=True)
class Key:
    read: Callable[[str, str], object]
    default: object


def _count(key: str, x: str) -> int:
    try:
        n = int(x)
    except ValueError:
        n = -1
    if n < 0:
        raise SettingError(f"{key} must be a whole number of at least 0, not {x!r}")
    return n


def _real(key: str, x: str) -> float:
    try:
        n = float(x)
    except ValueError:
        n = math.nan
    if not math.isfinite(n):
        raise SettingError(f"{key} must be a finite number, not {x!r}")
    return n


def _flag(key: str, x: str) -> bool:
    if x.lower() not in ("true", "false", "1", "0"):
        raise SettingError(f"{key} must be true or false, not {x!r}")
    return x.lower() in ("true", "1")


def _one_of(*names: str):
    def read(key: str, x: str) -> str:
        if x not in names:
            raise SettingError(f"{key} must be one of {', '.join(names)}, not {x!r}")
        return x

    return read


def _several(*names: str):
    def read(key: str, x: str) -> list[str]:
        return [_one_of(*names)(key, part.strip()) for part in x.split(",") if part.strip()]

    return read


def _text(key: str, x: str) -> str:
    return x


RENDERERS = ("stripped", "sentinel", "jsonl", "onto")
#: Keys with their defaults; None is derived or unset.
KEYS = {
    "model": Key(_text, ""), "provider": Key(_text, ""), "renderer": Key(_one_of(*RENDERERS), "onto"), "stats.renderers": Key(_several(*RENDERERS), ["stripped", "sentinel", "jsonl"]),
    "tail.records": Key(_count, 16), "temperature": Key(_real, None), "reask.until-pass": Key(_flag, None), "reask.most": Key(_count, None), "prompt.adapt": Key(_flag, None), "prompt.instructions": Key(_text, ""),
    "density.capsules": Key(_count, 30), "density.cited": Key(_count, 25), "density.promises": Key(_count, 0),
    "message.collapse-at": Key(_count, 2400), "message.head": Key(_count, 900), "message.tail": Key(_count, 900), "ledger.messages": Key(_count, 64), "ledger.tokens": Key(_count, 8000), "ledger.lines": Key(_count, 300),
    "output.strategy": Key(_one_of("headtail", "dspc", "mask"), "headtail"), "output.after": Key(_count, 64), "output.least": Key(_count, 2400), "output.head": Key(_count, 900), "output.tail": Key(_count, 500),
    "call.after": Key(_count, None), "call.least": Key(_count, 800), "call.head": Key(_count, 400), "call.tail": Key(_count, 200), "path.prefix": Key(_text, ""),
    "dspc.keep": Key(_real, 0.7), "dspc.attention": Key(_real, 0.6), "dspc.information": Key(_real, 0.3), "dspc.place": Key(_real, 0.1), "dspc.lambda": Key(_real, 1.0), "dspc.sigma": Key(_real, 0.25),
}
#: Models that are asked until they pass, that run at a given temperature, and providers whose prompts need no help.
UNTIL_PASS, WARM, TEMPERATURE, STRONG, REASKS = ("flash-lite",), ("grok-4.3", "grok-4.20", "flash-lite"), 0.4, ("codex",), 10


def settings(given: Mapping[str, object] | None = None, spark: SparkSession | None = None) -> dict[str, object]:
    """All settings by key; an unknown key and a value out of its range are errors that name the key."""
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (given or {}).items()}
    if spark is not None:
        known = {k: spark.conf.get(PREFIX + k, None) for k in KEYS}
        given = {k: v for k, v in known.items() if v is not None} | given
    if unknown := sorted(set(given) - set(KEYS)):
        raise SettingError(f"unknown setting {unknown[0]}")
    out = {k: key.read(PREFIX + k, given[k]) if k in given else key.default for k, key in KEYS.items()}
    model = str(out["model"]).lower()
    has = lambda names: any(n in model for n in names)
    if out["reask.until-pass"] is None:
        out["reask.until-pass"] = has(UNTIL_PASS)
    if out["reask.most"] is None:
        out["reask.most"] = REASKS if out["reask.until-pass"] else 0
    if out["prompt.adapt"] is None:
        out["prompt.adapt"] = bool(out["reask.until-pass"]) and str(out["provider"]).lower() not in STRONG
    if out["temperature"] is None and has(WARM):
        out["temperature"] = TEMPERATURE
    if out["call.after"] is None:
        out["call.after"] = out["output.after"]
    return out


def density(s: Mapping[str, object]) -> dict[str, int]:
    """Thresholds as scoring.density takes them."""
    return {n: s[f"density.{n}"] for n in ("capsules", "cited", "promises")}


def ledger_budget(s: Mapping[str, object]) -> dict[str, int]:
    """Budgets as ledger.selected takes them."""
    return {"most": s["ledger.messages"], "most_tokens": s["ledger.tokens"], "most_lines": s["ledger.lines"]}
