"""Write side: logical rows become physical ones, and rows of the external tables that they refer to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.algorithms import Algorithms
from veilframe.functions.jsonpaths import take_out_column
from veilframe.names import normal
from veilframe.rules import ColumnRule, JsonRule, Rules


@dataclass
class Protected:
    """A physical table, and per external table the rows that it needs."""

    main: DataFrame
    external: dict[str, DataFrame] = field(default_factory=dict)


def derived(rule: ColumnRule, value: Column, algorithms: Algorithms) -> dict[str, Column]:
    """Physical columns of one protected value: ciphertext, hash, LIKE form, stored mask."""
    out = {rule.storage_column: algorithms.cipher(rule.cipher).encrypt(value)}
    if rule.hash_column:
        out[rule.hash_column] = algorithms.hash(rule.hash).column(value)
    if rule.like_column:
        out[rule.like_column] = algorithms.like(rule.like).column(value)
    if rule.distinct_masked:
        out[rule.masked_column] = algorithms.like(rule.masked).column(value)
    return out


def named(df: DataFrame, column: str) -> str | None:
    return next((c for c in df.columns if normal(c) == normal(column)), None)


Ids = Callable[[Column], Column]


def sequential(node: int = 0, since: int | None = None) -> Ids:
    """Time-ordered ids of 63 bits, as of a generator on ten bits of node: 41 bits of milliseconds, the node, 12 of a sequence. Rows of a
    task count on; tasks stand for nodes, counted from ``node``, and every 1024 of them for other milliseconds."""
    epoch = 1704067200000  # fixed value: 2024-01-01 in milliseconds

    def of(_: Column) -> Column:
        row = F.monotonically_increasing_id()
        task, k = F.shiftright(row, 33) + node, row.bitwiseAND(F.lit((1 << 33) - 1))
        now = (F.unix_millis(F.current_timestamp()) if since is None else F.lit(since).cast("long")) - epoch
        milliseconds = now + F.shiftright(k, 12) + F.shiftright(task, 10) * (1 << 21)
        return F.shiftleft(milliseconds, 22).bitwiseOR(F.shiftleft(task.bitwiseAND(F.lit(1023).cast("long")), 12)).bitwiseOR(k.bitwiseAND(F.lit(4095).cast("long"))).cast("string")

    return of


def external_rows(values: DataFrame, rule: ColumnRule, algorithms: Algorithms, ids: Ids | None = None) -> DataFrame:
    """One row per distinct value of the column ``plain``: id, ciphertext, hash, LIKE form, stored mask."""
    value = F.col("plain")
    hashed = values.where(value.isNotNull()).select(value, algorithms.hash(rule.hash).column(value).alias("_hash")).dropDuplicates(["_hash"])
    columns = derived(rule, value, algorithms) | {rule.hash_column: F.col("_hash")}
    made = F.col("_hash") if ids is None else ids(F.col("_hash"))
    return hashed.select(made.alias(rule.storage_id_column), *[c.alias(n) for n, c in columns.items()])


def json_external_rows(writes: DataFrame, rule: JsonRule, algorithms: Algorithms) -> DataFrame:
    """One row per distinct hash of the array column ``writes``."""
    rows = writes.select(F.explode("writes").alias("w")).select("w.*").dropDuplicates(["hash"])
    cipher = None
    for p in rule.paths:
        own = F.when(F.col("path") == p.path, algorithms.cipher(p.cipher).encrypt(F.col("plain")))
        cipher = own if cipher is None else F.coalesce(cipher, own)
    return rows.select(F.col("hash").alias(rule.storage_id_column), F.col("hash").alias(rule.hash_column), cipher.alias(rule.cipher_column))


def protect(df: DataFrame, table: str, rules: Rules, algorithms: Algorithms, ids: Ids | None = None) -> Protected:
    """Set-based protection of logical rows. Nulls stay null; other types are protected as text."""
    out, external = df, {}
    for rule in rules.of(table).values():
        label = named(out, rule.column)
        if label is None:
            continue
        value = F.col(f"`{label}`").cast("string")
        if rule.separate:
            rows = external_rows(out.select(value.alias("plain")), rule, algorithms, ids)
            key = normal(rule.storage_table)
            external[key] = external[key].unionByName(rows, allowMissingColumns=True) if key in external else rows
            out = out.withColumn(label, algorithms.hash(rule.hash).column(value))
            continue
        made = {n: c.alias(n) for n, c in derived(rule, value, algorithms).items()}
        keep: list[Column] = []
        for c in out.columns:
            if c == label:
                keep.extend(made.values())
            elif not any(normal(c) == normal(n) for n in made):
                keep.append(F.col(f"`{c}`"))
        out = out.select(*keep)
    for rule in rules.json_of(table).values():
        label = named(out, rule.column)
        if label is None:
            continue
        taken = out.withColumn("_json", take_out_column(F.col(f"`{label}`"), rule, lambda name: algorithms.hash(name).value))
        key = normal(rule.storage_table)
        rows = json_external_rows(taken.select("_json.writes"), rule, algorithms)
        external[key] = external[key].unionByName(rows, allowMissingColumns=True) if key in external else rows
        out = taken.withColumn(label, F.col("_json.json")).drop("_json")
    return Protected(out, external)


def only_new(rows: DataFrame, existing: DataFrame | None, hash_column: str) -> DataFrame:
    """Rows of an external table whose hash it does not have yet; existing rows are never changed."""
    rows = rows.dropDuplicates([hash_column])
    return rows if existing is None else rows.join(existing.select(hash_column), hash_column, "left_anti").select(*rows.columns)
