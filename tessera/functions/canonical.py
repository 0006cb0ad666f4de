"""JSON in one form: sorted keys, arrays in their order, whatever order and spacing it was written in."""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Levels of nesting that are followed; deeper texts count as malformed.
DEPTH = 4_000
#: What a content store adds to a document by itself.
METADATA = ("_id", "_type", "_rev", "_createdAt", "_updatedAt")
_GONE = object()


def written(value: Any, prune: bool, drop: Sequence[str] = ()) -> Any:
    """The text of a parsed value, or ``_GONE`` where pruning leaves nothing of it."""
    if isinstance(value, dict):
        names = sorted((k for k in value if k not in drop), key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        parts = [(k, text) for k in names if (text := written(value[k], prune)) is not _GONE]
        if prune and not parts:
            return _GONE
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{text}" for k, text in parts) + "}"
    if isinstance(value, list):
        return "[" + ",".join(text for x in value if (text := written(x, prune)) is not _GONE) + "]"
    if value is None and prune:
        return _GONE
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        value = int(value)
    return json.dumps(value, ensure_ascii=False)


def _refused(name: str) -> Any:
    raise ValueError(f"{name} is no JSON")


def one(text: str | None, prune: bool = False, drop: Sequence[str] = ()) -> str | None:
    if text is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * DEPTH))
    try:
        told = written(json.loads(text, parse_constant=_refused), prune, drop)
    except (ValueError, RecursionError):
        return None
    return None if told is _GONE else told


def canonical_json(text: Column, drop: Sequence[str] = (), prune: bool = False) -> Column:
    """``text`` with the keys of all objects sorted by UTF-16 code units and no spaces; null where it is null or malformed.

    Arrays keep their order, whole numbers their digits, and a number like 1.0 is 1; of a repeated key the last counts. ``drop`` names keys of
    the outermost object that are left out; ``prune`` leaves out nulls and objects that hold nothing else, at any depth, but not empty arrays.
    """
    drop = tuple(drop)

    @F.pandas_udf(StringType())
    def canonical(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t, prune, drop))

    return canonical(text)


def json_digest(text: Column, drop: Sequence[str] = (), prune: bool = False) -> Column:
    """SHA-256 of the canonical form, equal for equal values; null where that is null."""
    return F.sha2(canonical_json(text, drop, prune).cast("binary"), 256)
