"""Submitted JSON or form payloads whose sensitive fields come back as handles: the handles become values again.

``sensitiveSubmitMeta`` maps fields to handles (sid, pid, vid, hash) and is removed. In the older form a field is an object
{state, value, lookupMeta}: ``changed`` gives its value, ``masked`` and ``revealed`` are looked up. Where both name a field the first
counts; a handle that leads nowhere leaves the field as it was submitted. A form says the same in brackets, as in
``sensitiveSubmitMeta[phone][sid]=…`` and ``phone[state]=masked``.
"""

from __future__ import annotations

import json
from typing import Any
from urllib.parse import parse_qsl, urlencode

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.engine import Engine

HELPER = "sensitiveSubmitMeta"
PARTS = ("sid", "pid", "vid", "hash")


def handles(payload: dict) -> dict[str, tuple]:
    """Complete handles of the fields of one payload."""
    out: dict[str, Any] = {}
    for name, value in payload.items():
        if isinstance(value, dict) and value.get("state") in ("masked", "revealed"):
            out[name] = value.get("lookupMeta")
    out |= payload.get(HELPER) or {}
    return {k: tuple(str(m[p]) for p in PARTS) for k, m in out.items() if isinstance(m, dict) and all(m.get(p) for p in PARTS)}


def rebuilt(text: str | None, known: dict[str, str]) -> str | None:
    """A payload with the values found for its handles."""
    try:
        payload = json.loads(text) if text else None
    except ValueError:
        return text
    if not isinstance(payload, dict):
        return text
    found = {k: known.get("\0".join(h)) for k, h in handles(payload).items()}
    out = {}
    for name, value in payload.items():
        if name == HELPER:
            continue
        legacy = isinstance(value, dict) and "state" in value
        if found.get(name) is not None:
            out[name] = found[name]
        else:
            out[name] = value.get("value") if legacy and value["state"] == "changed" else value
    out |= {k: v for k, v in found.items() if v is not None and k not in out}  # fields that only their handles were sent for
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def read_form(text: str) -> tuple[list[tuple[str, str]], dict[str, dict]]:
    """The pairs of a form, and what its bracketed names say of handles and states, as JSON would have it."""
    pairs = parse_qsl(text, keep_blank_values=True)
    heads = {HELPER} | {n.removesuffix("[state]") for n, _ in pairs if n.endswith("[state]")}
    told: dict[str, dict] = {}
    for name, value in pairs:
        head, bracket, rest = name.partition("[")
        if bracket and head in heads and rest.endswith("]"):
            *way, last = rest[:-1].split("][")
            at: Any = told.setdefault(head, {})
            for w in way:
                at = at.setdefault(w, {}) if isinstance(at, dict) else {}
            if isinstance(at, dict):
                at.setdefault(last, value)
    return pairs, told


def rebuilt_form(text: str | None, known: dict[str, str]) -> str | None:
    """A form with the values found for its handles."""
    if not text:
        return text
    pairs, told = read_form(text)
    found = {k: v for k, h in handles(told).items() if (v := known.get("\0".join(h)))}
    found |= {k: x["value"] for k, x in told.items() if k not in found and x.get("state") == "changed" and x.get("value") is not None}
    out, done = [], set()
    for name, value in pairs:
        head = name.partition("[")[0]
        if head in found and (name == head or head in told):
            out += [] if head in done else [(head, found[head])]
            done.add(head)
        elif head != HELPER or name == HELPER:
            out.append((name, value))
    return urlencode(out + [(k, v) for k, v in found.items() if k not in done])


def resolve_payloads(engine: Engine, rows: DataFrame, column: str = "payload", form: bool = False) -> DataFrame:
    """The rows with resolved payloads, of forms or of JSON. Handles of all rows are looked up in one join per protected column."""

    def asked(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list:
            try:
                payload = read_form(text)[1] if form and text else json.loads(text) if text else None
            except ValueError:
                return []
            return [dict(zip(PARTS, h, strict=True)) for h in handles(payload).values()] if isinstance(payload, dict) else []

        return texts.map(one)

    kind = "array<struct<sid:string,pid:string,vid:string,hash:string>>"
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_asked", F.pandas_udf(asked, kind, F.PandasUDFType.SCALAR)(F.col(column)))
    wanted = numbered.select("_row", F.explode("_asked").alias("m")).select("_row", "m.*")
    answered = engine.resolve(wanted.drop("_row").distinct()).where(F.col("plain").isNotNull())
    known = wanted.join(answered, list(PARTS)).groupBy("_row").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.concat_ws("\0", *PARTS), "plain")))).alias("_known"))
    put = F.pandas_udf(lambda t, k: pd.Series([(rebuilt_form if form else rebuilt)(a, {} if b is None else dict(b)) for a, b in zip(t, k, strict=True)], dtype=object), "string", F.PandasUDFType.SCALAR)
    return numbered.join(known, "_row", "left").withColumn(column, put(F.col(column), F.col("_known"))).select(*rows.columns)
