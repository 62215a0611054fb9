"""Values at paths inside JSON strings: taken out for protection, put back for reading."""

from __future__ import annotations

import json
import re
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.errors import unsupported
from veilframe.rules import JsonRule

STEP = re.compile(r"\.([A-Za-z0-9_]+)|\[([0-9]+)\]")


class Number(str):
    """A number in the digits in which it was written."""


def load(text: str) -> Any:
    return json.loads(text, parse_float=Number, parse_int=Number)


def dump(value: Any) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def locate(root: Any, path: str) -> tuple[Any, Any] | None:
    """The container and the key of what a path names; None if it isn't there."""
    at: Any = root
    place = None
    for m in STEP.finditer(path):
        if place is not None:
            at = place[0][place[1]]
        key: Any = m[1] if m[1] is not None else int(m[2])
        if not (isinstance(at, dict) and key in at if m[1] is not None else isinstance(at, list) and key < len(at)):
            return None
        place = (at, key)
    return place


def plain_text(value: Any) -> str | None:
    """A scalar as text; null and blank aren't protected, containers are refused."""
    if value is None:
        return None
    if isinstance(value, (dict, list)):
        raise unsupported("INVALID_ENCRYPTED_WRITE_OPERAND", "a protected JSON path holds a container")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, Number):
        return format(Decimal(value), "f") if re.search(r"[eE]", value) else str(value)
    return value if value.strip() else None


def take_out(text: str | None, hashes: dict[str, Any], known: frozenset[str] = frozenset()) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The JSON with hashes at its paths, and (path, hash, value) of what was there. Values that are known hashes stay."""
    if text is None or not text.strip():
        return text, []
    root, writes = load(text), []
    for path, digest in hashes.items():
        place = locate(root, path)
        value = None if place is None else plain_text(place[0][place[1]])
        if value is not None and value not in known:
            place[0][place[1]] = digest(value)
            writes.append((path, place[0][place[1]], value))
    return dump(root), writes


def put_back(text: str | None, paths: list[str], values: dict[str, str] | None) -> str | None:
    """The JSON with values for the hashes at its paths; unknown hashes stay."""
    if text is None or not text.strip() or not values:
        return text
    root = load(text)
    for path in paths:
        place = locate(root, path)
        if place is not None and isinstance(place[0][place[1]], str) and place[0][place[1]] in values:
            place[0][place[1]] = values[place[0][place[1]]]
    return dump(root)


def take_out_column(c: Column, rule: JsonRule, hash_of: Any) -> Column:
    """struct<json, writes: array<struct<path, hash, plain>>>."""
    hashes = {p.path: hash_of(p.hash) for p in rule.paths}

    def run(s: pd.Series) -> pd.DataFrame:
        found = [take_out(v, hashes) for v in s.astype(object).where(s.notna(), None)]
        return pd.DataFrame({"json": [x for x, _ in found], "writes": [[{"path": p, "hash": h, "plain": v} for p, h, v in w] for _, w in found]})

    return F.pandas_udf(run, "json string, writes array<struct<path:string,hash:string,plain:string>>", F.PandasUDFType.SCALAR)(c)


def put_back_column(c: Column, values: Column, rule: JsonRule) -> Column:
    """``values`` is a map from hash to value."""
    paths = [p.path for p in rule.paths]

    def run(s: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([put_back(a, paths, None if b is None else dict(b)) for a, b in zip(s.astype(object).where(s.notna(), None), v, strict=True)], dtype=object)

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR)(c, values)
