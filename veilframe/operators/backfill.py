"""Backfill: turns a table with plaintext columns into a protected one, slice by slice, resumable and verified.

A slice is a range of the cursor columns. The ends of all slices are found in one pass over the cursor, sorted by ranges. Then
``together`` slices at a time are one set-based job that derives the protected columns, appends missing external rows, writes the
rows to a staging folder once, and checks them; their ends and counts are saved only then. So the table is scanned once
per job, by a range that its files can be skipped by, and not once per slice. When the last slice is done the staged rows
become the table. A run that stops is taken up after its last saved slice.
"""

from __future__ import annotations

import fcntl
import json
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any, Protocol
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.engine import Engine
from veilframe.errors import MigrationError, VeilError, migration_error
from veilframe.functions.jsonpaths import take_out
from veilframe.names import normal
from veilframe.operators.protect import derived, external_rows, json_external_rows, named, only_new
from veilframe.rules import ColumnRule, JsonRule
from veilframe.sources.shared import shared_folder


@dataclass(frozen=True)
class Definition:
    """What to backfill. ``include`` names columns or properties (all if empty); ``backup`` maps columns to where their plaintext is
    kept before it is overwritten, and ``backup_template`` names that column for the others, from {table}, {property} and {column}. ``source``
    and ``entity`` are names under which the table is known to those who confirm."""

    table: str
    cursor: tuple[str, ...]
    batch: int = 1_000_000
    include: tuple[str, ...] = ()
    backup: dict[str, str] = field(default_factory=dict)
    verify: bool = True
    excluded_tables: tuple[str, ...] = ()
    together: int = 64
    backup_template: str | None = None
    source: str | None = None
    entity: str | None = None


@dataclass
class Report:
    total: int = 0
    scanned: int = 0
    migrated: int = 0
    skipped: int = 0
    verified: int = 0
    range_start: str | None = None
    range_end: str | None = None
    status: str = "READY"

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], "total long, scanned long, migrated long, skipped long, verified long, range_start string, range_end string, status string")


class State(Protocol):
    def load(self, key: str) -> dict | None: ...
    def save(self, key: str, state: dict) -> None: ...
    def lock(self, key: str) -> Any: ...


class MemoryState:
    def __init__(self):
        self.states: dict[str, dict] = {}
        self.locked: set[str] = set()

    def load(self, key: str) -> dict | None:
        return self.states.get(key)

    def save(self, key: str, state: dict) -> None:
        self.states[key] = json.loads(json.dumps(state))

    @contextmanager
    def lock(self, key: str) -> Iterator[None]:
        if key in self.locked:
            raise migration_error("CHECKPOINT_LOCKED", key)
        self.locked.add(key)
        try:
            yield
        finally:
            self.locked.discard(key)


class FileState:
    """One JSON file per table in a folder of the driver, replaced in one step and guarded by a lock file."""

    def __init__(self, folder: str):
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def _file(self, key: str, end: str = "json") -> str:
        return os.path.join(self.folder, f"{''.join(c if c.isalnum() else '_' for c in key)}.{end}")

    def load(self, key: str) -> dict | None:
        try:
            with open(self._file(key)) as f:
                return json.load(f)
        except FileNotFoundError:
            return None
        except ValueError as e:
            raise migration_error("STATE_STORE_DATA_INVALID", str(e)) from e

    def save(self, key: str, state: dict) -> None:
        try:
            with open(self._file(key, "tmp"), "w") as f:
                json.dump(state, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(self._file(key, "tmp"), self._file(key))
        except OSError as e:
            raise migration_error("STATE_STORE_IO_FAILED", str(e)) from e

    @contextmanager
    def lock(self, key: str) -> Iterator[None]:
        with open(self._file(key, "lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise migration_error("CHECKPOINT_LOCKED", key) from e
            yield


# --- confirmation

Confirm = Callable[[Definition, set[str]], None]


def allow_all(what: Definition, risks: set[str]) -> None:
    """Confirms anything."""


def expected(scopes: dict[str, set[str]]) -> Confirm:
    """Confirms a table whose risks are exactly those expected of its scope: "source|entity|table", "entity|table", "source|table" or
    "table", of which the first that is there counts; ``*`` stands for tables without one."""

    def confirm(d: Definition, risks: set[str]) -> None:
        table = normal(d.table)
        names = [(d.source, d.entity, table), (d.entity, table), (d.source, table), (table,), ("*",)]
        own = next((scopes[k] for parts in names if None not in parts and (k := "|".join(parts)) in scopes), None)
        if own is None:
            raise migration_error("CONFIRMATION_REQUIRED", d.table)
        if own != risks:
            raise migration_error("CONFIRMATION_SCOPE_MISMATCH", f"{sorted(own ^ risks)}")

    return confirm


def from_file(folder: str) -> Confirm:
    """Writes the risks to a file on the first run; confirms once somebody has set ``approved`` in it and they still are the same."""

    def confirm(d: Definition, risks: set[str]) -> None:
        path = os.path.join(folder, f"{normal(d.table)}.confirm.json")
        try:
            if not os.path.exists(path):
                with open(path, "w") as f:
                    json.dump({"approved": False, "risks": sorted(risks)}, f, indent=1)
            with open(path) as f:
                own = json.load(f)
        except (OSError, ValueError) as e:
            raise migration_error("CONFIRMATION_IO_FAILED", str(e)) from e
        if not own.get("approved"):
            raise migration_error("CONFIRMATION_REQUIRED", path)
        if set(own.get("risks", ())) != risks:
            raise migration_error("CONFIRMATION_SCOPE_MISMATCH", path)

    return confirm


# --- the plan


@dataclass(frozen=True)
class Plan:
    definition: Definition
    columns: tuple[ColumnRule, ...]
    json: tuple[JsonRule, ...]

    def backup(self, rule: ColumnRule) -> str | None:
        own = next((b for k, b in self.definition.backup.items() if normal(k) in (normal(rule.column), normal(rule.property))), None)
        template = self.definition.backup_template if self.overwrites(rule) else None
        return own or (template and template.format(table=normal(rule.table), property=rule.property, column=rule.column))

    @staticmethod
    def targets(rule: ColumnRule) -> list[str]:
        """Columns of the main table that a rule writes."""
        if rule.separate:
            return [rule.column]
        return [c for c in (rule.storage_column, rule.hash_column, rule.like_column, rule.masked_column) if c]

    def overwrites(self, rule: ColumnRule) -> bool:
        """Whether a rule's own plaintext is lost."""
        return any(normal(c) == normal(rule.column) for c in self.targets(rule))

    def risks(self) -> set[str]:
        out = set()
        for r in self.columns:
            out |= {f"UPDATE|{normal(r.table)}|{normal(c)}" for c in self.targets(r)}
            if r.separate:
                out |= {f"INSERT|{normal(r.storage_table)}|{normal(c)}" for c in (r.storage_column, r.hash_column, r.like_column, r.masked_column) if c}
            if self.overwrites(r) and self.backup(r):
                out.add(f"UPDATE|{normal(r.table)}|{normal(self.backup(r))}")
        for r in self.json:
            out.add(f"UPDATE|{normal(r.table)}|{normal(r.column)}")
            out |= {f"INSERT|{normal(r.storage_table)}|{normal(c)}" for c in (r.hash_column, r.cipher_column)}
        return out

    def signature(self) -> str:
        return json.dumps([sorted(self.risks()), self.definition.cursor, [[r.cipher, r.hash, r.like, r.masked] for r in self.columns], [[p.path, p.cipher, p.hash] for r in self.json for p in r.paths]])


def plan(engine: Engine, d: Definition) -> Plan:
    """Resolves a definition against the rules; refuses what could not be backfilled safely."""
    if not d.cursor or d.batch <= 0 or not normal(d.table):
        raise migration_error("DEFINITION_INVALID", d.table)
    if normal(d.table) in map(normal, d.excluded_tables):
        raise migration_error("TABLE_EXCLUDED", d.table)
    columns, documents = list(engine.rules.of(d.table).values()), list(engine.rules.json_of(d.table).values())
    if not columns and not documents:
        raise migration_error("METADATA_RULE_MISSING", d.table)

    def pick(name: str) -> ColumnRule | JsonRule:
        found = [r for r in columns if normal(name) in (normal(r.column), normal(r.property))] or [r for r in documents if normal(name) == normal(r.column)]
        if not found:
            raise migration_error("FIELD_SELECTOR_UNRESOLVED", name)
        return found[0]

    if d.include:
        chosen = [pick(n) for n in d.include]
        columns, documents = [r for r in columns if r in chosen], [r for r in documents if r in chosen]
    for n in d.backup:
        pick(n)
    out = Plan(d, tuple(columns), tuple(documents))
    # Rules that write the same columns from the same column are one.
    single: dict[tuple, ColumnRule] = {}
    for r in columns:
        first = single.setdefault((normal(r.column), *map(normal, out.targets(r)), normal(r.storage_table or "")), r)
        if normal(out.backup(first) or "") != normal(out.backup(r) or ""):
            raise migration_error("DEFINITION_INVALID", f"{first.property} and {r.property} keep backups in different columns")
    out = Plan(d, tuple(single.values()), tuple(documents))
    if any(normal(r.table) != normal(d.table) for r in columns):
        raise migration_error("DEFINITION_INVALID", "rules of several tables")
    backups = {b for r in out.columns if (b := out.backup(r))} | set(d.backup.values())
    written = {normal(c) for r in columns for c in out.targets(r)} | {normal(r.column) for r in documents}
    own = {normal(c) for r in columns for c in (r.column, r.storage_column, r.hash_column, r.like_column, r.masked_column) if c}
    if any(normal(b) in written | own or normal(b) in map(normal, d.cursor) for b in backups):
        raise migration_error("BACKUP_COLUMN_CONFLICT", str(d.backup))
    if any(normal(c) in written for c in d.cursor):
        raise migration_error("CURSOR_COLUMN_MUTABLE", str(d.cursor))
    return out


# --- the task


def filled(c: Column) -> Column:
    """Null for blank."""
    return F.when(F.trim(c) != "", c)


def encode(value: Any) -> Any:
    return value if isinstance(value, (int, float, str)) or value is None else str(value)


class Task:
    def __init__(self, engine: Engine, definition: Definition, state: State | None = None, confirm: Confirm = allow_all):
        self.engine, self.definition, self.state, self.confirm = engine, definition, state or MemoryState(), confirm
        self.plan = plan(engine, definition)

    def cursor(self, df: DataFrame) -> Column:
        return F.struct(*[F.col(f"`{named(df, c)}`").alias(f"c{i}") for i, c in enumerate(self.definition.cursor)])

    def bound(self, df: DataFrame, values: list) -> Column:
        return F.struct(*[F.lit(v).cast(df.schema[named(df, c)].dataType).alias(f"c{i}") for i, (c, v) in enumerate(zip(self.definition.cursor, values, strict=True))])

    def span(self, df: DataFrame) -> tuple[int, list | None, list | None]:
        at = self.cursor(df)
        missing = reduce(lambda a, b: a | b, [F.col(f"`{named(df, c)}`").isNull() for c in self.definition.cursor])
        r = df.agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b"), F.count_if(missing).alias("m")).first()
        if r["m"]:
            raise migration_error("CURSOR_VALUE_MISSING", f"{r['m']} rows")
        return r["n"], r["a"] and [encode(x) for x in r["a"]], r["b"] and [encode(x) for x in r["b"]]

    def run(self, most_slices: int | None = None) -> Report:
        d, key = self.definition, normal(self.definition.table)
        with self.state.lock(key):
            self.confirm(d, self.plan.risks())
            df = self.engine.read(d.table)
            if df is None:
                raise migration_error("RANGE_READ_FAILED", d.table)
            old, signature, place = self.state.load(key), self.plan.signature(), self.engine.store.fingerprint()
            if old and (old["signature"] != signature or old.get("place", place) != place):
                raise migration_error("STATE_INCOMPATIBLE", d.table)
            total, start, end = self.span(df)
            if old and old["report"]["status"] == "COMPLETED" and [old["total"], old["start"], old["end"]] == [total, start, end]:
                return Report(**old["report"])
            if old and old["report"]["status"] == "COMPLETED":
                old = None  # rows came since: what is already protected is recognised and skipped
            if old is None:
                folder = f"{shared_folder(self.engine.spark)}/backfill-{uuid4().hex}"
                s = {"signature": signature, "place": place, "total": total, "start": start, "end": end, "last": None, "folder": folder, "ends": self.ends(df, total, folder), "jobs": 0, "report": asdict(Report(total, range_start=self.show(start), range_end=self.show(end)))}
            else:
                s = old
            left = len(s["ends"]) if most_slices is None else most_slices
            try:
                while s["ends"] and left > 0:
                    now = s["ends"][: min(left, d.together)]
                    self.job(df, s, now)
                    left -= len(now)
                    s["ends"], s["last"] = s["ends"][len(now) :], now[-1]
                    s["jobs"] += 1
                    s["report"]["status"] = "RUNNING" if s["ends"] else "COMPLETED"
                    if not s["ends"]:
                        staged = self.engine.spark.read.option("mergeSchema", "true").parquet(*[f"{s['folder']}/{i}" for i in range(s["jobs"])])
                        self.engine.store.replace(d.table, staged.drop("_changed"))
                    self.state.save(key, s)
                if not s["ends"]:
                    s["report"]["status"] = "COMPLETED"
                    self.state.save(key, s)
            except Exception as e:
                s["report"]["status"] = "FAILED"
                self.state.save(key, s)
                if isinstance(e, VeilError):
                    raise
                raise migration_error("EXECUTION_FAILED", str(e)[:300]) from e
            return Report(**s["report"])

    @staticmethod
    def show(values: list | None) -> str | None:
        return None if values is None else ",".join(map(str, values))

    def ends(self, df: DataFrame, total: int, folder: str) -> list[list]:
        """The last cursor of every slice, in order: every ``batch``-th one, and the last. The sorted cursors are written, so that places
        and counts are taken of the same order; one row per task and one per slice reach the driver."""
        if not total:
            return []
        spark = self.engine.spark
        parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ordered = df.select(self.cursor(df).alias("c")).repartitionByRange(parts, "c").sortWithinPartitions("c")
        ordered.select("c", F.monotonically_increasing_id().alias("i")).write.mode("overwrite").parquet(f"{folder}/cursors")
        kept = spark.read.parquet(f"{folder}/cursors").select("c", F.shiftright("i", 33).alias("task"), F.col("i").bitwiseAND(F.lit((1 << 33) - 1)).alias("k"))
        before, offsets = 0, []
        for r in kept.groupBy("task").agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect():
            offsets.append((r["task"], before))
            before += r["n"]
        placed = kept.join(F.broadcast(spark.createDataFrame(offsets, "task long, before long")), "task").withColumn("place", F.col("before") + F.col("k") + 1)
        chosen = placed.where((F.col("place") % self.definition.batch == 0) | (F.col("place") == total)).orderBy("place").select("c").collect()
        out: list[list] = []
        for r in chosen:
            end = [encode(x) for x in r["c"]]
            if not out or out[-1] != end:  # equal cursors lie in one slice
                out.append(end)
        return out

    def job(self, df: DataFrame, s: dict, ends: list[list]) -> None:
        """Derives, stages and checks the rows after the last saved slice up to the last of ``ends``."""
        self.folder = s["folder"]
        at, first = self.cursor(df), named(df, self.definition.cursor[0])
        column, kind = F.col(f"`{first}`"), df.schema[first].dataType
        # The range of the first column is what files can be skipped by.
        rows = df.where((column <= F.lit(ends[-1][0]).cast(kind)) & (at <= self.bound(df, ends[-1])))
        if s["last"] is not None:
            rows = rows.where((column >= F.lit(s["last"][0]).cast(kind)) & (at > self.bound(df, s["last"])))
        path = f"{s['folder']}/{s['jobs']}"
        self.derive(rows).write.mode("overwrite").parquet(path)
        staged = self.engine.spark.read.parquet(path)
        counts = staged.agg(F.count(F.lit(1)).alias("n"), F.count_if("_changed").alias("m")).first()
        if self.definition.verify:
            self.verify(staged)
            s["report"]["verified"] += counts["n"]
        s["report"]["scanned"] += counts["n"]
        s["report"]["migrated"] += counts["m"]
        s["report"]["skipped"] += counts["n"] - counts["m"]

    def plain(self, rows: DataFrame, rule: ColumnRule) -> tuple[DataFrame, Column, Column]:
        """Rows, the plaintext of a column where it is to be protected, and whether the row is already done."""
        algorithms, name = self.engine.algorithms, named(rows, rule.column)
        source = F.col(f"`{name}`").cast("string")
        kept = self.plan.backup(rule)
        backup = filled(F.col(f"`{named(rows, kept)}`").cast("string")) if kept and named(rows, kept) else F.lit(None).cast("string")
        if rule.separate:
            store = self.engine.read(rule.storage_table)
            if store is None:
                there = F.lit(False)
            else:
                known = store.select(F.col(rule.hash_column).alias("_known")).distinct()
                rows = rows.join(known, source == F.col("_known"), "left").withColumn("_there", F.col("_known").isNotNull()).drop("_known")
                there = F.col("_there")
            lost = ~there & source.rlike("^[0-9a-f]{64}$") & backup.isNull()
        elif self.plan.overwrites(rule):
            # Done where all that is derived is there and opens; something of it without the rest means that the plaintext is gone.
            has = lambda c: filled(F.col(f"`{named(rows, c)}`").cast("string")).isNotNull() if named(rows, c) else F.lit(False)
            stored = named(rows, rule.storage_column)
            opens = algorithms.cipher(rule.cipher).try_decrypt(F.col(f"`{stored}`").cast("string")).isNotNull() if stored else F.lit(False)
            others = [c for c in self.plan.targets(rule) if normal(c) != normal(rule.column)]
            there = reduce(lambda a, b: a & b, map(has, others), opens) & backup.isNull()
            lost = ~there & backup.isNull() & reduce(lambda a, b: a | b, map(has, others), F.lit(False))
        else:
            there = F.lit(False)
            lost = F.lit(False)
        # Beside a backup stands its own value, or what the column was overwritten with.
        opened = algorithms.cipher(rule.cipher).try_decrypt(source)
        forms = [backup, algorithms.hash(rule.hash).column(backup), opened]
        forms += [algorithms.like(name).column(backup) for column, name in ((rule.like_column, rule.like), (rule.masked_column if rule.distinct_masked else None, rule.masked)) if column and normal(column) == normal(rule.column)]
        fits = reduce(lambda a, b: a | b, [source.eqNullSafe(f) if f is not opened else f.eqNullSafe(backup) for f in forms])
        bad = rows.where(F.trim(source) != "").agg(F.count_if(lost).alias("lost"), F.count_if(backup.isNotNull() & ~there & ~fits).alias("odd")).first()
        if bad["lost"]:
            raise migration_error("PLAINTEXT_UNRECOVERABLE", f"{rule.table}.{rule.column}: {bad['lost']} rows")
        if bad["odd"] and self.plan.overwrites(rule):
            raise migration_error("BACKUP_VALUE_INCONSISTENT", f"{rule.table}.{rule.column}: {bad['odd']} rows")
        return rows, F.when(~there, F.coalesce(backup, filled(source)) if self.plan.overwrites(rule) else filled(source)), there

    def derive(self, rows: DataFrame) -> DataFrame:
        """The rows in target state, with _changed."""
        algorithms = self.engine.algorithms
        rows = rows.withColumn("_changed", F.lit(False))
        for rule in self.plan.columns:
            if named(rows, rule.column) is None:
                raise migration_error("FIELD_SELECTOR_UNRESOLVED", rule.column)
            rows, plain, _ = self.plain(rows, rule)
            rows = rows.withColumn("_plain", plain).drop("_there")
            kept, value = self.plan.backup(rule), F.col("_plain")
            if kept and self.plan.overwrites(rule):
                label = named(rows, kept)
                before = filled(F.col(f"`{label}`")) if label else F.lit(None).cast("string")
                rows = rows.withColumn(label or kept, F.coalesce(before, value))
            if rule.separate:
                new = only_new(external_rows(rows.select(F.col("_plain").alias("plain")), rule, algorithms), self.engine.read(rule.storage_table), rule.hash_column)
                self.add_external(rule.storage_table, new)
                label = named(rows, rule.column)
                rows = rows.withColumns({"_changed": F.col("_changed") | value.isNotNull(), label: F.when(value.isNotNull(), algorithms.hash(rule.hash).column(value)).otherwise(F.col(f"`{label}`").cast("string"))})
            else:
                columns = derived(rule, value, algorithms)
                # Ciphertext that already decrypts to the value stays; so nothing changes when a run repeats.
                changed = F.lit(False)
                new = {}
                for name, c in columns.items():
                    label = named(rows, name)
                    before = F.col(f"`{label}`").cast("string") if label else F.lit(None).cast("string")
                    same = algorithms.cipher(rule.cipher).try_decrypt(before).eqNullSafe(value) if name == rule.storage_column else before.eqNullSafe(c)
                    differs = value.isNotNull() & ~same
                    changed = changed | differs
                    new[label or name] = F.when(differs, c).otherwise(before)
                rows = rows.withColumns({"_changed": F.col("_changed") | changed, **new})
            rows = rows.drop("_plain")
        for rule in self.plan.json:
            rows = self.derive_json(rows, rule)
        return rows

    def add_external(self, table: str, new: DataFrame) -> None:
        """Appends external rows as written files, so that later slices read them and don't derive them anew."""
        path = f"{self.folder}/external-{normal(table)}-{uuid4().hex}"
        new.write.parquet(path)
        self.engine.store.append(table, self.engine.spark.read.parquet(path))

    def derive_json(self, rows: DataFrame, rule: JsonRule) -> DataFrame:
        """Values at the paths become hashes; hashes that the external table knows are left alone."""
        import pandas as pd

        algorithms, label = self.engine.algorithms, named(rows, rule.column)
        hashes = {p.path: algorithms.hash(p.hash).value for p in rule.paths}
        store, refs = self.engine.read(rule.storage_table), []
        for i, p in enumerate(rule.paths):
            at = F.get_json_object(F.col(f"`{label}`"), p.path)
            if store is not None:
                known = store.select(F.col(rule.hash_column).alias(f"_k{i}")).distinct()
                rows = rows.join(known, at == F.col(f"_k{i}"), "left")
                refs.append(F.col(f"_k{i}"))
        known = F.array_compact(F.array(*refs)) if refs else F.array().cast("array<string>")

        def run(texts: pd.Series, seen: pd.Series) -> pd.DataFrame:
            found = [take_out(t, hashes, frozenset(k)) for t, k in zip(texts.astype(object).where(texts.notna(), None), seen, strict=True)]
            return pd.DataFrame({"json": [x for x, _ in found], "writes": [[{"path": p, "hash": h, "plain": v} for p, h, v in w] for _, w in found]})

        udf = F.pandas_udf(run, "json string, writes array<struct<path:string,hash:string,plain:string>>", F.PandasUDFType.SCALAR)
        rows = rows.withColumn("_json", udf(F.col(f"`{label}`"), known)).drop(*[f"_k{i}" for i in range(len(refs))])
        self.add_external(rule.storage_table, only_new(json_external_rows(rows.select("_json.writes"), rule, algorithms), store, rule.hash_column))
        return rows.withColumns({"_changed": F.col("_changed") | (F.size("_json.writes") > 0), label: F.when(F.size("_json.writes") > 0, F.col("_json.json")).otherwise(F.col(f"`{label}`"))}).drop("_json")

    def verify(self, staged: DataFrame) -> None:
        """Every protected value must decrypt to what its hash, LIKE form and mask come from; references must have rows."""
        algorithms = self.engine.algorithms
        for rule in self.plan.columns:
            kept = self.plan.backup(rule)
            if rule.separate:
                ref = F.col(f"`{named(staged, rule.column)}`")
                store = self.engine.read(rule.storage_table).groupBy(F.col(rule.hash_column).alias("_h")).agg(F.any_value(rule.storage_column).alias("_c"))
                seen = staged.where(F.trim(ref) != "").join(store, ref == F.col("_h"), "left")
                plain = algorithms.cipher(rule.cipher).try_decrypt(F.col("_c"))
                wrong = ~algorithms.hash(rule.hash).column(plain).eqNullSafe(ref)
                if kept and named(staged, kept):
                    wrong = wrong | ~plain.eqNullSafe(F.col(f"`{named(staged, kept)}`"))
                r = seen.agg(F.count_if(F.col("_h").isNull()).alias("missing"), F.count_if(wrong).alias("wrong")).first()
                if r["missing"]:
                    raise migration_error("VERIFICATION_EXTERNAL_ROW_MISSING", f"{rule.column}: {r['missing']}")
            else:
                source = F.col(f"`{named(staged, rule.column)}`").cast("string")
                plain = algorithms.cipher(rule.cipher).try_decrypt(F.col(f"`{rule.storage_column}`"))
                wrong = plain.isNull() if self.plan.overwrites(rule) else ~plain.eqNullSafe(source)
                for name, transform in ((rule.hash_column, algorithms.hash(rule.hash)), (rule.like_column, algorithms.like(rule.like)), (rule.masked_column if rule.distinct_masked else None, algorithms.like(rule.masked) if rule.distinct_masked else None)):
                    if name:
                        wrong = wrong | ~F.col(f"`{name}`").eqNullSafe(transform.column(plain))
                r = staged.where(F.trim(source) != "").agg(F.lit(0).alias("missing"), F.count_if(wrong).alias("wrong")).first()
            if r["wrong"]:
                raise migration_error("VERIFICATION_VALUE_MISMATCH", f"{rule.column}: {r['wrong']} rows")


def migrate_all(engine: Engine, definitions: dict[str, Definition] | None = None, cursor: tuple[str, ...] = ("id",), excluded: tuple[str, ...] = (), state: State | None = None, confirm: Confirm = allow_all) -> dict[str, Report]:
    """Backfills every table that has rules and is there."""
    out = {}
    for table in engine.rules.tables():
        if table in map(normal, excluded) or engine.read(table) is None:
            continue
        out[table] = Task(engine, (definitions or {}).get(table) or Definition(table, cursor), state, confirm).run()
    return out


__all__ = ["Definition", "FileState", "MemoryState", "MigrationError", "Plan", "Report", "Task", "allow_all", "expected", "from_file", "migrate_all", "plan"]
