"""Masks for what leaves the engine: values that it revealed, and fields that are declared sensitive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.errors import misconfigured
from veilframe.functions import masks
from veilframe.functions.algorithms import Algorithms
from veilframe.names import normal
from veilframe.operators.reveal import Read
from veilframe.plans.compiler import Out
from veilframe.rules import ColumnRule

RECORDED_ONLY, ANNOTATED_FIELDS, RECORDED_THEN_ANNOTATED = "RECORDED_ONLY", "ANNOTATED_FIELDS", "RECORDED_THEN_ANNOTATED"


@dataclass(frozen=True)
class Sensitive:
    """How a field is masked: by a named masker, else by a LIKE algorithm, else by type."""

    type: str = "AUTO"
    masker: str | None = None
    like: str | None = None
    keep_first: int = -1
    keep_last: int = -1
    char: str = "*"


Maskers = dict[str, Callable[[Column], Column]]


def mask_field(c: Column, name: str, how: Sensitive, algorithms: Algorithms, maskers: Maskers) -> Column:
    if how.masker:
        if how.masker not in maskers:
            raise misconfigured("MISSING_SENSITIVE_FIELD_MASKER", how.masker)
        return F.coalesce(maskers[how.masker](c), c)
    blank = F.trim(c) == ""
    if how.like:
        return F.when(blank, c).otherwise(algorithms.like(how.like).column(c))
    return masks.type_mask(c, masks.mask_type_of(name) if how.type == "AUTO" else how.type, how.keep_first, how.keep_last, how.char)


def stored_masks(df: DataFrame, place: str, rule: ColumnRule, read: Read, algorithms: Algorithms) -> tuple[DataFrame, Column | None]:
    """Joins the stored mask of a revealed column by its hash."""
    column = rule.masked_column or None
    store = read(rule.storage_table if rule.separate else rule.table)
    if column is None or store is None or not rule.hash_column:
        return df, None
    own = store.groupBy(F.col(rule.hash_column).alias(f"_h{place}")).agg(F.any_value(F.col(column)).alias(f"_m{place}"))
    hashed = df.withColumn(f"_k{place}", algorithms.hash(rule.hash).column(F.col(place)))
    return hashed.join(own, F.col(f"_k{place}") == F.col(f"_h{place}"), "left"), F.col(f"_m{place}")


def mask(df: DataFrame, outputs: list[Out], algorithms: Algorithms, read: Read, strategy: str = RECORDED_ONLY, fields: dict[str, Sensitive] | None = None, maskers: Maskers | None = None, stored: bool = True) -> DataFrame:
    """Masks a revealed result. For a revealed column the stored mask comes first, then its rule's mask, then the declaration of
    its field; one without any of them stays."""
    fields, maskers = {normal(k): v for k, v in (fields or {}).items()}, maskers or {}
    labels = df.columns
    inner = [f"c{i}" for i in range(len(labels))]
    df = df.toDF(*inner)
    done: dict[str, Column] = {}
    for place, label, o in zip(inner, labels, outputs, strict=True):
        c, how = F.col(place), fields.get(normal(label))
        if strategy != ANNOTATED_FIELDS and o.shadow:
            rule, found = o.shadow.rule, None
            if stored:
                df, found = stored_masks(df, place, rule, read, algorithms)
            name = rule.like if rule.shares_masked else rule.masked if rule.masked_column else None
            own = algorithms.like(name).column(c) if name else mask_field(c, label, how, algorithms, maskers) if how else None
            if own is not None:
                done[place] = own if found is None else F.coalesce(found, own)
        if place not in done and how is not None and strategy != RECORDED_ONLY:
            done[place] = mask_field(c, label, how, algorithms, maskers)
    return df.select(*[done.get(p, F.col(p)).alias(x) for p, x in zip(inner, labels, strict=True)])


def handles(labels: list[str], outputs: list[Out], algorithms: Algorithms) -> Column:
    """Map from the properties of a revealed row's protected columns to their handles; those whose row's key isn't shown have none."""
    pairs = []
    for label, o in zip(labels, outputs, strict=True):
        rule = o.shadow.rule if o.shadow else None
        key = rule and next((x for x in labels if normal(x) == normal(rule.business_key or "id")), None)
        if key and labels.count(key) == 1 and labels.count(label) == 1:
            value, own = F.col(f"`{label}`"), F.col(f"`{key}`").cast("string")
            handle = F.struct(F.lit(rule.sid).alias("sid"), F.lit(rule.pid).alias("pid"), own.alias("vid"), algorithms.hash(rule.hash).column(value).alias("hash"))
            pairs.append(F.when(value.isNotNull() & own.isNotNull(), F.struct(F.lit(rule.property).alias("key"), handle.alias("value"))))
    kind = "map<string,struct<sid:string,pid:string,vid:string,hash:string>>"
    return F.map_from_entries(F.array_compact(F.array(*pairs))).cast(kind) if pairs else F.create_map().cast(kind)


def mask_nested(df: DataFrame, algorithms: Algorithms, maskers: Maskers | None = None) -> DataFrame:
    """Masks every string field whose metadata has ``sensitive`` (attributes of ``Sensitive``), through structs and arrays."""
    maskers = maskers or {}

    def walk(c: Column, kind: T.DataType, name: str, meta: dict) -> Column:
        if isinstance(kind, T.StringType) and "sensitive" in meta:
            return mask_field(c, name, Sensitive(**meta["sensitive"]), algorithms, maskers)
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c[f.name], f.dataType, f.name, f.metadata).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            return F.transform(c, lambda x: walk(x, kind.elementType, name, {}))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name, f.metadata).alias(f.name) for f in df.schema.fields])
