"""Several data sources: an engine, its external tables and a dialect for each."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from fnmatch import fnmatchcase
from typing import Any

from pyspark.sql import DataFrame

from veilframe.engine import Engine
from veilframe.errors import misconfigured, unsupported
from veilframe.operators import ddl


class Sources:
    """Engines by name; the first is the default. ``dialects`` maps patterns of names (as in shells) to dialects, the first that fits
    counts. Every engine has its own store, so external rows go where the table is."""

    def __init__(self, engines: dict[str, Engine], dialects: dict[str, str] | None = None, dialect: str = "MYSQL"):
        if not engines:
            raise misconfigured("GENERAL_FAILURE", "no data source")
        self.engines, self.dialects, self.default_dialect = engines, dialects or {}, dialect
        self._now: ContextVar[str] = ContextVar("source", default=next(iter(engines)))

    @property
    def current(self) -> str:
        return self._now.get()

    @contextmanager
    def use(self, name: str) -> Iterator[Engine]:
        """Inside, statements go to this source."""
        engine = self.engine(name)
        before = self._now.set(name)
        try:
            yield engine
        finally:
            self._now.reset(before)

    def engine(self, name: str | None = None) -> Engine:
        name = name or self.current
        if name not in self.engines:
            raise misconfigured("GENERAL_FAILURE", f"no data source {name}")
        return self.engines[name]

    def dialect(self, name: str | None = None) -> str:
        name = name or self.current
        return next((d for pattern, d in self.dialects.items() if fnmatchcase(name, pattern)), self.default_dialect)

    def sql(self, sql: str, args: Any = None, source: str | None = None, **options: Any) -> DataFrame | None:
        return self.engine(source).sql(sql, args, **options)

    def insert(self, table: str, rows: DataFrame, source: str | None = None) -> None:
        self.engine(source).insert(table, rows)

    def ddl(self, table: str, columns: dict[str, str], source: str | None = None, **options: Any) -> list[str]:
        return ddl.statements(self.engine(source).rules, table, columns, self.dialect(source), **options)

    def lookup(self, meta: dict[str, str], source: str | None = None, **attributes: Any) -> str:
        """The value behind a handle, in the named source or in the one source that has its table."""
        if source is None:
            having = [n for n, e in self.engines.items() if (r := e.rules.by_codes(meta.get("sid"), meta.get("pid"))) and e.read(r.table) is not None]
            if len(having) > 1:
                raise unsupported("GENERAL_FAILURE", f"{len(having)} data sources for a handle")
            source = having[0] if having else None
        return self.engine(source).lookup(meta, **attributes)
