"""Statements that give tables the columns which their rules need."""

from __future__ import annotations

import re
from dataclasses import dataclass

from veilframe.errors import migration_error
from veilframe.names import normal, quote
from veilframe.rules import Rules


@dataclass(frozen=True)
class Sizing:
    hash_length: int = 64
    fallback_length: int = 255
    least_cipher_length: int = 64
    bytes_per_char: int = 4
    overhead: int = 28
    longest_varchar: int = 4000
    id_length: int = 64


def text_type(dialect: str) -> str:
    return {"CLICKHOUSE": "String", "DM": "clob", "ORACLE12": "clob"}.get(dialect, "text")


def varchar(n: int, dialect: str) -> str:
    return "String" if dialect == "CLICKHOUSE" else f"varchar2({n})" if dialect == "ORACLE12" else f"varchar({n})"


def length_of(kind: str, s: Sizing) -> int:
    """Characters that a column holds; decimals and other types count as the fallback, decimals by their digits."""
    m = re.match(r"\s*(\w+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?", kind)
    name, n = m[1].lower(), m[2]
    if n and "char" in name:
        return int(n)
    if n and name in ("decimal", "numeric", "number"):
        return int(n) + 2
    return {"bigint": 20, "int": 11, "integer": 11, "smallint": 6, "tinyint": 4, "date": 10, "timestamp": 26, "datetime": 26}.get(name, s.fallback_length)


def is_large(kind: str) -> bool:
    return bool(re.match(r"\s*(text|clob|longtext|mediumtext|string)", kind, re.I))


def cipher_type(kind: str, dialect: str, s: Sizing) -> str:
    n = max(s.least_cipher_length, (length_of(kind, s) * s.bytes_per_char + s.overhead + 2) // 3 * 4)
    return text_type(dialect) if is_large(kind) or n > s.longest_varchar else varchar(n, dialect)


def longest(a: str, b: str) -> str:
    """Of two requirements for one column the one that holds both; text holds any varchar."""
    if is_large(a) or is_large(b):
        return a if is_large(a) else b
    family = lambda k: "char" in k.lower()
    if family(a) != family(b):
        raise migration_error("DEFINITION_INVALID", f"{a} and {b} for one column")
    return max((a, b), key=lambda k: length_of(k, Sizing()))


def statements(rules: Rules, table: str, columns: dict[str, str], dialect: str = "SPARK", existing: dict[str, dict[str, str]] | None = None, sizing: Sizing = Sizing(), backup: dict[str, str] | None = None) -> list[str]:
    """ALTER and CREATE statements for a table and its external tables. ``columns`` are its columns and types, ``existing`` those of
    other tables that are already there."""
    dialect, have = dialect.upper(), {normal(k): v for k, v in columns.items()}
    existing = {normal(t): {normal(k): v for k, v in c.items()} for t, c in (existing or {}).items()}
    main: dict[str, str] = {}
    other: dict[str, dict[str, str]] = {}

    def require(of: dict[str, str], name: str, kind: str) -> None:
        of[name] = longest(of[name], kind) if name in of else kind

    for r in rules.of(table).values():
        kind = have.get(normal(r.column), varchar(sizing.fallback_length, dialect))
        plain = kind if re.search("char|text|clob|string", kind, re.I) else varchar(length_of(kind, sizing), dialect)
        target = other.setdefault(r.storage_table, {}) if r.separate else main
        if r.separate:
            require(target, r.storage_id_column, varchar(sizing.id_length, dialect))
            require(main, r.column, varchar(sizing.hash_length, dialect))
        require(target, r.storage_column, cipher_type(kind, dialect, sizing))
        if r.hash_column:
            require(target, r.hash_column, varchar(sizing.hash_length, dialect))
        for c in (r.like_column, r.masked_column if r.distinct_masked else None):
            if c:
                require(target, c, plain)
        if (backup or {}).get(r.column):
            require(main, backup[r.column], plain)
    for j in rules.json_of(table).values():
        target = other.setdefault(j.storage_table, {})
        require(target, j.storage_id_column, varchar(sizing.id_length, dialect))
        require(target, j.hash_column, varchar(sizing.hash_length, dialect))
        require(target, j.cipher_column, cipher_type(varchar(sizing.fallback_length, dialect), dialect, sizing))
    out = _alter(table, main, have, dialect)
    for name, wanted in other.items():
        if normal(name) in existing:
            out += _alter(name, wanted, existing[normal(name)], dialect)
        elif dialect == "CLICKHOUSE":
            raise migration_error("DEFINITION_INVALID", f"an engine has to be chosen for {name}")
        else:
            key = next(iter(wanted))
            body = ", ".join(f"{quote(c, dialect)} {k}{' not null' if c == key else ''}" for c, k in wanted.items())
            out.append(f"create table {quote(name, dialect)} ({body}{'' if dialect == 'SPARK' else f', primary key ({quote(key, dialect)})'})")
    return out


def _alter(table: str, wanted: dict[str, str], have: dict[str, str], dialect: str) -> list[str]:
    out = []
    modify = {"DM": "modify", "ORACLE12": "modify", "SPARK": "alter column"}.get(dialect, "modify column")
    for c, kind in wanted.items():
        if normal(c) not in have:
            out.append(f"alter table {quote(table, dialect)} add {'' if dialect in ('DM', 'ORACLE12') else 'column '}{quote(c, dialect)} {kind}")
        elif not is_large(have[normal(c)]) and (is_large(kind) or length_of(kind, Sizing()) > length_of(have[normal(c)], Sizing()) and "char" in have[normal(c)].lower()):
            out.append(f"alter table {quote(table, dialect)} {modify} {quote(c, dialect)} {'type ' if dialect == 'SPARK' else ''}{kind}")
    return out
