"""Rules that describe protected columns."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from typing import Any

from veilframe.errors import misconfigured
from veilframe.names import lookup_code, normal, snake

SAME_TABLE, SEPARATE_TABLE = "SAME_TABLE", "SEPARATE_TABLE"
JSON_PATH = re.compile(r"\$(?:\.[A-Za-z0-9_]+|\[[0-9]+\])+")


@dataclass(frozen=True)
class ColumnRule:
    """One protected column. Statements name ``column``; the physical table has the other columns."""

    table: str
    property: str
    column: str = ""
    mode: str = SAME_TABLE
    storage_column: str = ""
    storage_table: str | None = None
    storage_id_column: str = "id"
    cipher: str = "sm4"
    hash_column: str | None = None
    hash: str = "sm3"
    like_column: str | None = None
    like: str = "normalizedLike"
    masked_column: str | None = None
    masked: str = "normalizedLike"
    sid: str = ""
    pid: str = ""
    business_key: str | None = None

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("column", self.column or snake(self.property))
        put("storage_column", self.storage_column or self.column)
        put("sid", self.sid or lookup_code("sid", self.table))
        put("pid", self.pid or lookup_code("pid", self.table, self.property))

    @property
    def separate(self) -> bool:
        return self.mode == SEPARATE_TABLE

    @property
    def shares_masked(self) -> bool:
        """Like and masked values stand in one column; the like algorithm writes it."""
        return bool(self.like_column and self.masked_column and normal(self.like_column) == normal(self.masked_column))

    @property
    def distinct_masked(self) -> bool:
        return bool(self.masked_column) and not self.shares_masked

    @property
    def key_column(self) -> str | None:
        """The column of the main table that stands for the value in comparisons."""
        return self.column if self.separate else self.hash_column

    def validate(self) -> None:
        if not normal(self.table):
            raise misconfigured("INVALID_TABLE_RULE", "a table name is required")
        if self.mode not in (SAME_TABLE, SEPARATE_TABLE):
            raise misconfigured("INVALID_FIELD_RULE", self.mode)
        if self.separate and not self.storage_table:
            raise misconfigured("MISSING_STORAGE_TABLE", f"{self.table}.{self.property}")
        if self.separate and not self.hash_column:
            raise misconfigured("MISSING_ASSISTED_QUERY_COLUMN", f"{self.table}.{self.property}")
        if self.shares_masked and self.like != self.masked:
            raise misconfigured("SHARED_DERIVED_COLUMN_ALGORITHM_MISMATCH", f"{self.table}.{self.property}")


@dataclass(frozen=True)
class JsonPathRule:
    """One protected value inside a JSON column."""

    path: str
    cipher: str = "sm4"
    hash: str = "sm3"


@dataclass(frozen=True)
class JsonRule:
    """A string column of JSON whose values at some paths are replaced by hashes; ciphertexts stand in ``storage_table``."""

    table: str
    column: str
    paths: tuple[JsonPathRule, ...]
    storage_table: str = ""
    storage_id_column: str = "id"
    hash_column: str = ""
    cipher_column: str = ""

    def validate(self) -> None:
        if not (self.column and self.storage_table and self.hash_column and self.cipher_column):
            raise misconfigured("INVALID_FIELD_RULE", f"JSON rule on {self.table}.{self.column}")
        for p in self.paths:
            if not JSON_PATH.fullmatch(p.path):
                raise misconfigured("INVALID_FIELD_RULE", f"JSON path {p.path}")

    def path(self, path: str) -> JsonPathRule | None:
        return next((p for p in self.paths if p.path == path), None)


@dataclass
class Rules:
    """All rules, by table and column, case-insensitively. The first rule of a column stays; later ones fill gaps."""

    columns: dict[str, dict[str, ColumnRule]] = field(default_factory=dict)
    json: dict[str, dict[str, JsonRule]] = field(default_factory=dict)
    version: int = 0

    def add(self, rule: ColumnRule | JsonRule) -> Rules:
        rule.validate()
        of = (self.columns if isinstance(rule, ColumnRule) else self.json).setdefault(normal(rule.table), {})
        of.setdefault(normal(rule.column), rule)
        self.version += 1
        return self

    def of(self, table: str) -> dict[str, ColumnRule]:
        return self.columns.get(normal(table), {})

    def json_of(self, table: str) -> dict[str, JsonRule]:
        return self.json.get(normal(table), {})

    def find(self, table: str, name: str) -> ColumnRule | None:
        """By column or property."""
        own = self.of(table)
        return own.get(normal(name)) or next((r for r in own.values() if normal(r.property) == normal(name)), None)

    def by_codes(self, sid: str, pid: str) -> ColumnRule | None:
        return next((r for own in self.columns.values() for r in own.values() if (r.sid, r.pid) == (sid, pid)), None)

    def tables(self) -> list[str]:
        return sorted({*self.columns, *self.json})

    @classmethod
    def load(cls, config: list[dict[str, Any]]) -> Rules:
        """From a list of tables: {"table": ..., "fields": [{...}], "json": [{..., "paths": [{...}]}]}; a field may name
        another table."""
        rules, known = cls(), {f.name for f in fields(ColumnRule)}
        for entry in config:
            table = entry.get("table", "")
            for f in entry.get("fields", ()):
                if extra := set(f) - known:
                    raise misconfigured("INVALID_FIELD_RULE", f"unknown attributes {sorted(extra)}")
                rules.add(ColumnRule(**{"table": table} | f))
            for j in entry.get("json", ()):
                rules.add(JsonRule(**{"table": table} | j | {"paths": tuple(p if isinstance(p, JsonPathRule) else JsonPathRule(**p) for p in j["paths"])}))
        return rules

    @classmethod
    def annotated(cls, *classes: type) -> Rules:
        """From dataclasses whose fields carry ``metadata={"protected": {...}}``; a subclass overrides what it inherits."""
        rules = cls()
        for c in classes:
            table = getattr(c, "__table__", None) or snake(c.__name__)
            for f in fields(c):
                if (spec := f.metadata.get("protected")) is not None:
                    rules.add(ColumnRule(**{"table": table, "property": f.name} | spec))
        return rules

    def with_mode(self, table: str, name: str, **changes: Any) -> Rules:
        """A copy with one rule changed."""
        copy = Rules({t: dict(c) for t, c in self.columns.items()}, {t: dict(c) for t, c in self.json.items()}, self.version + 1)
        rule = copy.find(table, name)
        copy.columns[normal(table)][normal(rule.column)] = replace(rule, **changes)
        return copy
