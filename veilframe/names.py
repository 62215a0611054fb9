"""Identifiers: stripping, snake and camel case, and the codes that name a protected field."""

from __future__ import annotations

import hashlib
import re


def strip(name: str | None) -> str:
    """An identifier without quotes or brackets around its parts."""
    return re.sub(r'[`"\[\]]', "", name or "").strip()


def normal(name: str | None) -> str:
    """For comparing: bare and lower case, without a catalog or schema in front."""
    return strip(name).lower().rpartition(".")[2]


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])|(?<=[A-Z])([A-Z])(?=[a-z])", lambda m: "_" + m[0], name).lower()


def camel(name: str) -> str:
    head, *rest = name.lower().split("_")
    return head + "".join(x.capitalize() for x in rest)


def alias_token(name: str) -> str:
    """A name that can stand inside a hidden alias."""
    return re.sub(r"[^A-Za-z0-9]", "_", strip(name))


def quote(name: str, dialect: str = "SPARK") -> str:
    """Quotes an identifier: back-ticks for Spark, MySQL, OceanBase and ClickHouse, double quotes for DM and Oracle."""
    mark = '"' if dialect.upper() in ("DM", "ORACLE12") else "`"
    bare = name[1:-1] if len(name) > 1 and name[0] + name[-1] in ("``", '""', "[]") else name
    return mark + bare.replace(mark, mark * 2) + mark


def lookup_code(prefix: str, table: str, prop: str = "") -> str:
    """sid and pid codes: the prefix and a digest of what they name."""
    payload = "|".join((prefix, normal(table), normal(prop)))
    return f"{prefix}_{hashlib.sha256(payload.encode()).hexdigest()}"
