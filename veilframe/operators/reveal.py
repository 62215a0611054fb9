"""Read side: ciphertext and references of a result become values, once per row of the output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.functions.algorithms import Algorithms
from veilframe.functions.jsonpaths import put_back_column
from veilframe.plans.compiler import ORDER_PREFIX, Out
from veilframe.rules import ColumnRule, JsonRule

Read = Callable[[str], DataFrame | None]


def decrypted(c: Column, rule: ColumnRule, algorithms: Algorithms) -> Column:
    """Blank values stay as they are."""
    there = F.trim(c) != ""
    return F.when(there, algorithms.cipher(rule.cipher).decrypt(F.when(there, c))).otherwise(c)


def hydrate(df: DataFrame, label: str, rule: ColumnRule, read: Read, algorithms: Algorithms) -> DataFrame:
    """References of one column become values; a reference without an external row stays."""
    store = read(rule.storage_table)
    if store is None:
        return df
    # One ciphertext per reference, decrypted after the join so that only what is asked for is.
    wanted = store.groupBy(F.col(rule.hash_column).alias("_ref")).agg(F.any_value(F.col(rule.storage_column)).alias("_cipher"))
    joined = df.join(wanted, F.col(f"`{label}`") == F.col("_ref"), "left")
    return joined.withColumn(label, F.coalesce(decrypted(F.col("_cipher"), rule, algorithms), F.col(f"`{label}`"))).select(*[f"`{c}`" for c in df.columns])


def restore_json(df: DataFrame, label: str, rule: JsonRule, read: Read, algorithms: Algorithms) -> DataFrame:
    """Hashes inside a JSON column become values."""
    store = read(rule.storage_table)
    if store is None:
        return df
    hashes = F.array_compact(F.array(*[F.get_json_object(F.col(f"`{label}`"), p.path) for p in rule.paths]))
    refs = df.select(F.explode(hashes).alias("_ref")).distinct()
    # Paths may use several ciphers; only the one that made a ciphertext opens it.
    names = sorted({p.cipher for p in rule.paths})
    plain = algorithms.cipher(names[0]).decrypt(F.col("_cipher")) if len(names) == 1 else F.coalesce(*[algorithms.cipher(n).try_decrypt(F.col("_cipher")) for n in names])
    known = refs.join(store.groupBy(F.col(rule.hash_column).alias("_ref")).agg(F.any_value(F.col(rule.cipher_column)).alias("_cipher")), "_ref").select("_ref", plain.alias("_plain"))
    rows = df.withColumn("_refs", hashes)
    # A row has a few references, one per path at most: they are looked up one after the other.
    for i in range(len(rule.paths)):
        own = known.select(F.col("_ref").alias(f"_r{i}"), F.col("_plain").alias(f"_p{i}"))
        rows = rows.join(own, F.try_element_at("_refs", F.lit(i + 1)) == F.col(f"_r{i}"), "left")
    pairs = F.filter(F.array(*[F.struct(F.col(f"_r{i}").alias("k"), F.col(f"_p{i}").alias("v")) for i in range(len(rule.paths))]), lambda x: x["k"].isNotNull())
    values = F.map_from_entries(F.array_distinct(pairs))
    return rows.withColumn(label, put_back_column(F.col(f"`{label}`"), values, rule)).select(*[f"`{c}`" for c in df.columns])


def reveal(df: DataFrame, outputs: list[Out], order: list[str], read: Read, algorithms: Algorithms) -> DataFrame:
    """The values of a compiled query's result, in its order."""
    places = [i for i, o in enumerate(outputs) if o.shadow or o.json]
    if not places and not order:
        return df
    # Labels may repeat; inside, columns go by place.
    inner = [f"_c{i}" for i in range(len(outputs))]
    df = df.toDF(*inner, *[f"{ORDER_PREFIX}{i}" for i in range(len(order))]) if len(df.columns) == len(inner) + len(order) else df
    for i in places:
        o, label = outputs[i], inner[i]
        if o.json:
            df = restore_json(df, label, o.json, read, algorithms)
        elif o.shadow.rule.separate:
            df = hydrate(df, label, o.shadow.rule, read, algorithms)
        else:
            df = df.withColumn(label, decrypted(F.col(label), o.shadow.rule, algorithms))
    if order:
        keys = []
        for i, rest in enumerate(order):
            c = F.col(f"{ORDER_PREFIX}{i}")
            down = rest.startswith("DESC")
            last = "NULLS LAST" in rest or (down and "NULLS FIRST" not in rest)
            keys.append((c.desc_nulls_last() if last else c.desc_nulls_first()) if down else (c.asc_nulls_last() if last else c.asc_nulls_first()))
        df = df.orderBy(*keys)
    return df.select(*[F.col(c).alias(o.label) for c, o in zip(inner, outputs, strict=True)])


def decrypt_nested(df: DataFrame, path: str, rule: ColumnRule, algorithms: Algorithms) -> DataFrame:
    """Decrypts a field inside structs and arrays of structs, by its dotted path."""

    def walk(c: Column, kind: T.DataType, rest: list[str]) -> Column:
        if not rest:
            return decrypted(c, rule, algorithms)
        if isinstance(kind, T.ArrayType):
            return F.transform(c, lambda x: walk(x, kind.elementType, rest))
        return F.when(c.isNotNull(), c.withField(rest[0], walk(c[rest[0]], kind[rest[0]].dataType, rest[1:])))

    head, *rest = path.split(".")
    return df.withColumn(head, walk(F.col(head), df.schema[head].dataType, rest))
