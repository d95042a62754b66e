"""JSON documents: canonical text and deep containment, as Arrow UDFs (Spark has neither)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F

from ..sources.shared import ship

#: Leading zeros of a number outside strings, which the lenient form accepts.
_ZEROS = re.compile(r'("(?:[^"\\]|\\.)*+")|(?<![\d.eE+-])(-?)0+(?=\d)')


def _number(text: str) -> int | float:
    value = float(text)
    return int(value) if value == int(value) and abs(value) < 1e15 else value


def canonical_text(text: str | None) -> str | None:
    """Sorted keys, shortest numbers, no white space. Raises ValueError for what is not JSON."""
    if text is None:
        return None
    lenient = _ZEROS.sub(lambda m: m[1] or m[2], text)
    return json.dumps(json.loads(lenient, parse_float=_number, parse_int=int), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def contained(whole, part) -> bool:
    """Whether `whole` has everything that `part` has: objects by key, arrays by element, scalars by value."""
    if isinstance(part, dict):
        return isinstance(whole, dict) and all(k in whole and contained(whole[k], v) for k, v in part.items())
    if isinstance(part, list):
        return isinstance(whole, list) and all(any(contained(w, p) for w in whole) for p in part)
    return type(whole) is type(part) and whole == part or (isinstance(whole, (int, float)) and isinstance(part, (int, float)) and not isinstance(whole, bool) and not isinstance(part, bool) and whole == part)


def canonical(column):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(canonical_text, na_action="ignore")

    ship()
    return run(column)


def json_contains(column, pattern: str):
    part = json.loads(pattern)

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: contained(json.loads(t), part), na_action="ignore")

    ship()
    return run(column)
