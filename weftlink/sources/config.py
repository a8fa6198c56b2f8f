"""Settings of a study: a file of ``key: value`` lines, checked, with paths expanded. No globals."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping, Sequence


def _value(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_value(x) for x in text[1:-1].split(",") if x.strip()]
    low = text.lower()
    if low in ("true", "yes", "false", "no"):
        return low in ("true", "yes")
    if low in ("", "null", "~", "na"):
        return None
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def read_config(path: str) -> dict:
    """Flat ``key: value`` settings, lists as ``[a, b]`` or as ``- a`` lines; ``#`` begins a comment."""
    out: dict = {}
    key = None
    with open(path) as f:
        for line in f:
            line = line.split(" #")[0].rstrip() if not line.lstrip().startswith("#") else ""
            if line.strip().startswith("- ") and key:
                out[key] = [*(out[key] or []), _value(line.strip()[2:])]
            elif ":" in line:
                key, _, text = line.strip().partition(":")
                out[key] = _value(text)
    return out


def check_config(config: Mapping, required: Sequence[str] = (), numeric: Sequence[str] = ()) -> None:
    """Required keys must be set, numeric ones finite single numbers."""
    missing = [k for k in required if config.get(k) is None]
    if missing:
        raise ValueError(f"missing settings: {missing}")
    odd = [k for k in numeric if isinstance(config.get(k), bool) or not isinstance(config.get(k), int | float) or not math.isfinite(config[k])]
    if odd:
        raise ValueError(f"settings that are no finite numbers: {odd}")


def expand_paths(config: Mapping, keys: Sequence[str]) -> dict:
    """Settings with ``~`` expanded in the named keys."""
    return {k: os.path.expanduser(v) if k in keys and isinstance(v, str) else v for k, v in config.items()}


def motif_db_candidates(db: str, genome: str, folder: str) -> list[str]:
    """Files that may hold a motif table, in order of preference."""
    return [f"{folder}/{db}_{genome}.txt", f"{folder}/{db.upper()}_{genome}.txt", f"{folder}/{db}.txt"]
