"""Scrubs values and free text for logs: by what a key is called, and by what a value looks like."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that mark a key as sensitive, by kind, in the order in which kinds are tried.
SECRET = ("password", "passwd", "pwd", "token", "secret", "cookie", "authorization")
PHONE = ("phone", "mobile", "tel")
EMAIL = ("email", "mail")
ID_CARD = ("idcard", "id_card", "credential", "cert")
BANK_CARD = ("bankcard", "bank_card", "cardno", "card_no")

_KEY = "(?:" + "|".join((*SECRET, *PHONE, *EMAIL, *ID_CARD, *BANK_CARD)) + ")"
# The patterns of keyed fragments and of bare values.
JSON_VALUE = re.compile(rf'("[^"]*{_KEY}[^"]*"\s*:\s*")([^"\\]*)(")', re.I | re.A)
AUTHORIZATION = re.compile(r"(\bauthorization\b\s*[:=]\s*)([^,;\r\n}\]]+)", re.I | re.A)
KEY_VALUE = re.compile(rf'(\b([A-Za-z0-9_.-]*{_KEY}[A-Za-z0-9_.-]*)\b\s*[:=]\s*)("?)([^\s",;}}\]]+)("?)', re.I | re.A)
BARE = (
    ("email", re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", re.A)),
    ("idCard", re.compile(r"\b(?:\d{15}|\d{17}[0-9Xx])\b", re.A)),
    ("bankCard", re.compile(r"\b\d{12,19}\b", re.A)),
    ("phone", re.compile(r"(?<!\d)(?:\+?\d{1,3}[- ]?)?1[3-9]\d{9}(?!\d)", re.A)),
)


def keep(value: str, first: int, last: int) -> str:
    """Stars in the middle; a value that both ends would cover is masked as a whole."""
    hidden = len(value) - first - last
    return "*" * len(value) if hidden <= 0 else value[:first] + "*" * hidden + value[len(value) - last :]


def phone(value: str) -> str:
    """The last four characters of every run between wildcards stay."""
    return re.sub(r"[^%_]+", lambda m: m[0] if len(m[0]) < 4 else "*" * (len(m[0]) - 4) + m[0][-4:], value)


def mask_value(value: str | None, hint: str | None = None) -> str | None:
    """Masks one value by a hint, or else by its look; a value that looks harmless stays."""
    if value is None or not value.strip():
        return value
    named = lambda words: hint is not None and any(w in hint.lower() for w in words)
    digits = sum(c.isdigit() for c in value)
    at = value.find("@")
    if named(SECRET):
        return "*" * len(value)
    if named(PHONE) or 7 <= digits <= 15:
        return phone(value)
    if named(EMAIL) or 0 < at < len(value) - 1:
        return keep(value, 1, 0) if at <= 0 else keep(value[:at], 1, 0) + value[at:]
    if named(ID_CARD) or re.fullmatch(r"\d{15}|\d{17}[0-9Xx]", value.strip(), re.A):
        return keep(value, 3, 3)
    if named(BANK_CARD) or 12 <= digits <= 19:
        return keep(value, 0, 4)
    return value


# What a match of the patterns can't do without; to look for it costs little.
_WORDS = (*SECRET, *PHONE, *EMAIL, *ID_CARD, *BANK_CARD)
_DIGITS = re.compile(r"[0-9]{11}")


def _keyed(text: str) -> bool:
    if ":" not in text and "=" not in text:
        return False
    low = text.lower()
    return any(w in low for w in _WORDS)


def scrub(text: str | None, hint: str | None = None) -> str | None:
    """Masks keyed fragments, then values that stand out; a text where nothing did is masked by its hint as one value."""
    if text is None or not text.strip():
        return text
    out = text
    if '"' in out and ":" in out:
        out = JSON_VALUE.sub(lambda m: m[1] + mask_value(m[2], m[1].strip().strip('":').strip()) + m[3], out)
    if _keyed(out):
        out = AUTHORIZATION.sub(lambda m: m[1] + (mask_value(m[2].strip(), "authorization") or ""), out)
        out = KEY_VALUE.sub(lambda m: m[1] + m[3] + mask_value(m[4], m[2]) + m[5], out)
    for kind, pattern in BARE:
        if "@" in out if kind == "email" else _DIGITS.search(out):
            out = pattern.sub(lambda m, kind=kind: mask_value(m[0], kind), out)
    return mask_value(text, hint) if out == text and hint is not None else out


def key_value(key: str, value: str | None) -> str:
    return f"{key}={mask_value(value, key)}"


def may_matter(c: Column) -> Column:
    """Whether there may be anything to scrub in a text; the JVM can tell for most that there isn't."""
    return c.contains("@") | c.rlike("[0-9]{11}") | (c.contains(":") | c.contains("=")) & c.rlike(f"(?i){_KEY}")


def scrub_column(c: Column, hint: str | None = None) -> Column:
    """``scrub`` for a column, in Arrow batches."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: scrub(v, hint), na_action="ignore")

    udf = F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)
    return udf(c) if hint is not None else F.coalesce(udf(F.when(may_matter(c), c)), c)


def mask_column(c: Column, hint: str | None = None) -> Column:
    """``mask_value`` for a column."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda v: mask_value(v, hint), na_action="ignore")

    return F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(c)


def mask_annotated(value: str | None, name: str) -> str | None:
    """A field that is marked as sensitive: by what it is called, or as a whole."""
    if value is None or not value.strip():
        return value
    named = lambda *words: any(w in name.lower() for w in words)
    if named("phone", "mobile", "tel"):
        return phone(value)
    if named("email", "mail"):
        return mask_value(value, "email") if "@" in value[1:-1] else keep(value, 1, 0)
    if named("idcard", "id_card", "cert"):
        return keep(value, 3, 3)
    return keep(value, 0, 4) if named("bank", "card") else "*" * len(value)


def mask_object(value: Any, hint: str | None = None, annotated: frozenset[str] = frozenset()) -> Any:
    """A detached copy of nested lists, maps (as pairs or dicts) and records in which strings are masked by the names that hold them."""
    if isinstance(value, str):
        return mask_annotated(value, hint) if hint is not None and hint.lower() in annotated else mask_value(value, hint)
    if isinstance(value, dict):
        return {k: mask_object(v, str(k), annotated) for k, v in value.items()}
    if isinstance(value, list):
        # A map's pairs; what stands in a list goes by the name of the list.
        return [(x[0], mask_object(x[1], str(x[0]), annotated)) if isinstance(x, tuple) else mask_object(x, hint, annotated) for x in value]
    return value


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return _has_strings(kind.valueType)
    return isinstance(kind, (T.StringType, T.VariantType)) or isinstance(kind, T.ArrayType) and _has_strings(kind.elementType)


def safe_frame(df: DataFrame, annotated: tuple[str, ...] = ()) -> DataFrame:
    """A copy for logs: strings masked by the names of their fields and keys, through structs, arrays and maps at any depth; other types
    stay. Fields named in ``annotated`` are masked in any case."""
    marked = frozenset(a.lower() for a in annotated)

    def masked(f: T.StructField) -> Column:
        if not _has_strings(f.dataType):
            return F.col(f"`{f.name}`")

        def run(values: pa.Array) -> pa.Array:
            return pa.array([mask_object(v, f.name, marked) for v in values.to_pylist()], values.type)

        return F.arrow_udf(run, f.dataType)(F.col(f"`{f.name}`"))

    return df.select(*[masked(f).alias(f.name) for f in df.schema.fields])


#: What a record has by itself; anything else was given with it.
_OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class LogFilter(logging.Filter):
    """Scrubs the rendered message, the values given with it and the exception text of log records."""

    def filter(self, record: logging.LogRecord) -> bool:
        record.msg, record.args = scrub(record.getMessage()), ()
        for key, value in vars(record).items():
            if key not in _OWN:
                setattr(record, key, mask_object(value, key))
        if record.exc_info and record.exc_info[1] is not None:
            record.exc_text = scrub(logging.Formatter().formatException(record.exc_info))
            record.exc_info = None
        return True


def install(logger: logging.Logger | None = None) -> int:
    """Puts the filter on every handler of a logger (the root one if none is given) that lacks it; how many there were."""
    lacking = [h for h in (logger or logging.getLogger()).handlers if not any(isinstance(f, LogFilter) for f in h.filters)]
    for h in lacking:
        h.addFilter(LogFilter())
    return len(lacking)


def safe_error(error: BaseException) -> str:
    """Text of an exception and its causes, scrubbed."""
    parts: list[Any] = []
    while error is not None and len(parts) < 16:
        parts.append(f"{type(error).__name__}: {scrub(str(error))}")
        error = error.__cause__ or error.__context__
    return "\n".join(parts)
