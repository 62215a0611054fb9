"""The engine: tables with protected columns, queried and written by their logical names."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import suppress
from dataclasses import dataclass
from functools import cached_property
from itertools import count
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.errors import ErrorCode, VeilError, unsupported
from veilframe.functions.algorithms import Algorithms
from veilframe.names import alias_token, normal
from veilframe.operators import masking
from veilframe.operators.protect import Protected, named, only_new, protect
from veilframe.operators.reveal import reveal
from veilframe.plans import ast as A
from veilframe.plans.compiler import Compiled, Compiler, Out, Scope, Shadow, Source, bare
from veilframe.rules import Rules
from veilframe.sources.store import SessionStore, TableStore

_views = count()
#: The column that holds the handles of a masked row.
META = "sensitiveLookupMeta"
#: What a key looks like in a plan; anything of this form is hidden there.
KEYS_IN_PLANS = r"(?i)\b(0x|X')?[0-9a-f]{32}\b"


@dataclass
class Frame:
    """A compiled query: its physical result, what is protected in it, and how to show it."""

    engine: Engine
    compiled: Compiled

    @cached_property
    def physical(self) -> DataFrame:
        """The result as stored: ciphertext and references."""
        return self.engine.spark.sql(self.compiled.sql, args=self.compiled.args or None)

    @property
    def outputs(self) -> list[Out]:
        return self.compiled.outputs

    @property
    def warnings(self) -> list[str]:
        return self.compiled.warnings

    @property
    def log_line(self) -> str:
        """The statement for logs: hashes of parameters are shown, anything else is hidden."""
        shown = [f"{k}={v if isinstance(v, str) and len(v) == 64 and set(v) <= set('0123456789abcdef') else '***'}" for k, v in dict(self.compiled.args).items()]
        return f"{self.compiled.sql} /* params: {'|'.join(shown)} */" if shown else self.compiled.sql

    def reveal(self) -> DataFrame:
        return reveal(self.physical, self.outputs, self.compiled.order, self.engine.read, self.engine.algorithms)

    def mask(self, strategy: str = masking.RECORDED_ONLY, fields: dict[str, masking.Sensitive] | None = None, stored: bool = True, meta: bool = False) -> DataFrame:
        """``meta`` adds a map from properties to the handles by which their values can be looked up."""
        df, outputs = self.reveal(), self.outputs
        if meta:
            df, outputs = df.withColumn(META, masking.handles(df.columns, outputs, self.engine.algorithms)), [*outputs, Out(META)]
        return masking.mask(df, outputs, self.engine.algorithms, self.engine.read, strategy, fields, self.engine.maskers, stored)


class Engine:
    """``tables`` are physical DataFrames, or ``store`` keeps them. ``preprocessors`` change logical rows before they are written."""

    def __init__(self, spark: SparkSession, rules: Rules, algorithms: Algorithms | None = None, tables: dict[str, DataFrame] | None = None, store: TableStore | None = None, preprocessors: Iterable[Callable[[str, DataFrame], DataFrame]] = (), audit: Callable[[dict], None] | None = None, maskers: masking.Maskers | None = None, insert_select: bool = False, fail_on_missing_rule: bool = True, ids: Callable[[Column], Column] | None = None):
        """``ids`` makes the ids of external rows from their hashes; without it the hash is the id."""
        self.spark, self.rules, self.algorithms, self.ids = spark, rules, algorithms or Algorithms.standard(), ids
        for name in {r.cipher for t in rules.tables() for r in rules.of(t).values()}:
            self.algorithms.cipher(name)  # an engine without the keys that its rules need doesn't start
        for conf in ("spark.sql.redaction.string.regex", "spark.redaction.string.regex"):
            if not spark.conf.get(conf, None):
                with suppress(AnalysisException):  # the second one belongs to the context and may be fixed
                    spark.conf.set(conf, KEYS_IN_PLANS)
        self.store = store or SessionStore(tables)
        self.preprocessors, self.audit, self.maskers = list(preprocessors), audit or (lambda event: None), maskers or {}
        self.insert_select, self.fail_on_missing_rule = insert_select, fail_on_missing_rule
        self._seen: dict[str, tuple[DataFrame, str]] = {}

    # --- tables

    def read(self, name: str) -> DataFrame | None:
        return self.store.read(name)

    def columns_of(self, name: str) -> list[str] | None:
        df = self.read(name)
        if df is not None:
            return df.columns
        return self.spark.table(name).columns if self.spark.catalog.tableExists(name) else None

    def view_of(self, name: str) -> str:
        """The view under which a table of ours stands in Spark SQL; other tables keep their names."""
        df = self.read(name)
        if df is None:
            return name
        known = self._seen.get(normal(name))
        if known is None or known[0] is not df:
            view = f"veil_{alias_token(name)}_{next(_views)}"
            df.createOrReplaceTempView(view)
            self._seen[normal(name)] = known = (df, view)
        return known[1]

    # --- queries

    def compiler(self, args: list | tuple | dict | None) -> Compiler:
        values = dict(args) if isinstance(args, dict) else dict(enumerate(args or ()))
        return Compiler(self.rules, self.algorithms, self.columns_of, self.view_of, values)

    def query(self, sql: str, args: list | tuple | dict | None = None) -> Frame:
        try:
            return Frame(self, self.compiler(args).compile(A.parse(sql)))
        except VeilError as e:
            # What can't be read may still run as it is, if it touches nothing protected.
            if e.code is not ErrorCode.SQL_REWRITE_FAILED or any(t in normal(sql) for t in self.rules.tables()) or self.fail_on_missing_rule and not self.is_plain(sql):
                raise
            return Frame(self, Compiled(sql, list(args or ()), [], [], [], False))

    def is_plain(self, sql: str) -> bool:
        low = sql.lower()
        return not any(t in low for t in self.rules.tables())

    def sql(self, sql: str, args: list | tuple | dict | None = None, mask: str | None = None, fields: dict[str, masking.Sensitive] | None = None, hint: dict[str, str] | None = None) -> DataFrame | None:
        """Runs a statement. A query gives its revealed result, or a masked one; writes change the tables. ``hint`` names rules
        ("table.column") for output labels whose protection can't be told from the statement."""
        head = sql.lstrip().split(None, 1)[0].upper()
        if head in ("INSERT", "UPDATE", "DELETE"):
            self.execute(A.parse(sql), args)
            return None
        frame = self.query(sql, args)
        for label, name in (hint or {}).items():
            table, _, column = name.rpartition(".")
            rule = self.rules.find(table, column)
            frame.compiled.outputs = [Out(o.label, Shadow(rule, o.label, None, None)) if normal(o.label) == normal(label) and rule and not o.shadow else o for o in frame.outputs]
        return frame.mask(mask, fields) if mask else frame.reveal()

    def raw(self, sql: str, args: list | tuple | dict | None = None) -> DataFrame:
        """Runs a query as written over the physical tables, without rewriting or revealing anything."""
        compiler = self.compiler(args)
        printer = A.Printer(compiler.values)
        text = printer.query(compiler.rename_tables(A.parse(sql), set()))
        return self.spark.sql(text, args=printer.args or None)

    def table(self, name: str) -> Relation:
        return Relation(self, A.Select((A.Item(A.Star()),), source=A.Table(name)))

    # --- writes

    def protect(self, df: DataFrame, table: str) -> Protected:
        return protect(df, table, self.rules, self.algorithms, self.ids)

    def insert(self, table: str, rows: DataFrame, token: str | None = None) -> None:
        """Appends logical rows: external rows of columns first, then the table, so that no reference ever lacks its row. What has been
        inserted under a ``token`` is not inserted again."""
        for change in self.preprocessors:
            rows = change(table, rows)
        made = self.protect(rows, table)
        self.add_external(table, made, token)
        before = self.read(table)
        main = made.main
        if before is not None:
            main = main.select(*[F.col(f"`{named(main, c)}`").cast(before.schema[c].dataType).alias(c) if named(main, c) else F.lit(None).cast(before.schema[c].dataType).alias(c) for c in before.columns])
        self.store.append(table, main, token)

    def add_external(self, table: str, made: Protected, token: str | None = None) -> None:
        keys = {normal(r.storage_table): r.hash_column for r in self.rules.of(table).values() if r.separate} | {normal(r.storage_table): r.hash_column for r in self.rules.json_of(table).values()}
        for name, rows in made.external.items():
            self.store.append(name, only_new(rows, self.read(name), keys[name]), token)

    def execute(self, statement: Any, args: list | tuple | dict | None = None) -> None:
        compiler = self.compiler(args)
        match statement:
            case A.Insert():
                self._insert(statement, compiler, args)
            case A.Update():
                self._update(statement, compiler)
            case A.Delete():
                hit = self._hits(statement.table, statement.alias, statement.where, {}, compiler)
                self.store.replace(statement.table, hit.where(~F.col("__hit")).drop("__hit"))

    def _insert(self, s: A.Insert, compiler: Compiler, args: Any) -> None:
        protected = self.rules.of(s.table) or self.rules.json_of(s.table)
        if s.query is not None:
            if protected and not self.insert_select:
                raise unsupported("UNSUPPORTED_ENCRYPTED_INSERT", s.table)
            frame = Frame(self, compiler.compile(s.query))
            rows = frame.reveal()
            self.insert(s.table, rows.toDF(*s.columns) if s.columns else rows)
            return
        values = []
        for row in s.rows:
            own = []
            for name, e in zip(s.columns, row, strict=True):
                own.append(self._write_value(e, compiler, bool(self.rules.find(s.table, name)) or normal(name) in self.rules.json_of(s.table)))
            values.append(own)
        printer = A.Printer(compiler.values)
        # Branches of a union find common types where an inline table would not.
        rows = " UNION ALL ".join("SELECT " + ", ".join(f"{printer.expr(x)} AS {A.name(c)}" for c, x in zip(s.columns, r, strict=True)) for r in values)
        self.insert(s.table, self.spark.sql(rows, args=printer.args or None))

    @staticmethod
    def _write_value(e: Any, compiler: Compiler, protected: bool) -> Any:
        """A protected column takes parameters, strings, whole numbers and NULL."""
        if not protected:
            return e
        e = bare(e)
        if isinstance(e, A.Param):
            e = A.Lit(compiler.values.get(e.index))
        if not isinstance(e, A.Lit) or isinstance(e.value, (float, bool)) and e.text is not None:
            raise unsupported("INVALID_ENCRYPTED_WRITE_OPERAND")
        return A.Lit(None if e.value is None else str(e.value))

    def _hits(self, table: str, alias: str | None, where: Any, sets: dict[str, Any], compiler: Compiler) -> DataFrame:
        """The physical table with __hit, true where the condition holds, and columns of new values."""
        own, found = self.rules.of(table), []
        source = compiler.sources(A.Table(table, alias), None, {}, found, [])
        scope = Scope(found)
        test = A.Lit(True, "TRUE") if where is None else A.Call("coalesce", (compiler.condition(where, scope, {}), A.Lit(False, "FALSE")))
        items = [A.Item(A.Star(found[0].alias)), A.Item(test, "__hit"), *(A.Item(compiler.value(e, scope, {}), f"__set_{k}") for k, e in sets.items())]
        printer = A.Printer(compiler.values)
        text = printer.query(A.Select(tuple(items), source=source))
        assert own is not None
        return self.spark.sql(text, args=printer.args or None)

    def _update(self, s: A.Update, compiler: Compiler) -> None:
        plain, values = {}, {}
        for name, e in s.sets:
            rule, json = self.rules.find(s.table, name), self.rules.json_of(s.table).get(normal(name))
            if rule or json:
                values[rule.column if rule else json.column] = self._write_value(e, compiler, True).value
            else:
                plain[name] = e
        hit = self._hits(s.table, s.alias, s.where, plain, compiler)
        for change in self.preprocessors:
            given = change(s.table, self.spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])) if values else None
            if given is not None:
                values = given.first().asDict()
        if values:
            made = self.protect(self.spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]), s.table)
            self.add_external(s.table, made)
            # One value for all rows that the condition meets: derived once, not per row.
            new = made.main.first().asDict()
            hit = hit.withColumns({named(hit, k) or k: F.when(F.col("__hit"), F.lit(v)).otherwise(F.col(f"`{k}`")) for k, v in new.items()})
        for name in plain:
            label = named(hit, name) or name
            hit = hit.withColumn(label, F.when(F.col("__hit"), F.col(f"`__set_{name}`")).otherwise(F.col(f"`{label}`")))
        self.store.replace(s.table, hit.drop("__hit", *[f"__set_{k}" for k in plain]))

    # --- lookups

    def lookup_meta(self, table: str) -> DataFrame:
        """Per row of a table its business key and, per protected column, the handle (sid, pid, vid, hash) to look it up by."""
        df = self.read(table)
        out: list[Column] = []
        for rule in self.rules.of(table).values():
            key = named(df, rule.business_key or "id")
            hashed = rule.key_column
            ok = F.col(f"`{key}`").isNotNull() & F.col(f"`{hashed}`").isNotNull() if key and hashed else F.lit(False)
            handle = F.struct(F.lit(rule.sid).alias("sid"), F.lit(rule.pid).alias("pid"), (F.col(f"`{key}`") if key else F.lit(None)).cast("string").alias("vid"), (F.col(f"`{hashed}`") if hashed else F.lit(None)).cast("string").alias("hash"))
            out.append(F.when(ok, handle).alias(rule.property))
        keys = sorted({named(df, r.business_key or "id") for r in self.rules.of(table).values()} - {None})
        return df.select(*[f"`{k}`" for k in keys], *out)

    def lookup(self, meta: dict[str, str], **attributes: Any) -> str:
        """The value behind one handle. Every call, whether it succeeds or not, is reported to the audit hook."""
        event = {"table": None, "property": None, "meta": dict(meta), "attributes": attributes}
        try:
            if any(not str(meta.get(k) or "").strip() for k in ("sid", "pid", "vid", "hash")):
                raise unsupported("GENERAL_FAILURE", "incomplete handle")
            rule = self.rules.by_codes(meta["sid"], meta["pid"])
            if rule is None:
                raise unsupported("INVALID_FIELD_RULE", "no such field")
            event |= {"table": rule.table, "property": rule.property}
            df = self.read(rule.table)
            key = named(df, rule.business_key or "id")
            rows = df.where((F.col(f"`{key}`").cast("string") == meta["vid"]) & (F.col(f"`{rule.key_column}`") == meta["hash"]))
            if rule.separate:
                rows = rows.select(F.col(f"`{rule.column}`").alias("_ref")).join(self.read(rule.storage_table).groupBy(F.col(rule.hash_column).alias("_ref")).agg(F.any_value(rule.storage_column).alias("_c")), "_ref")
            else:
                rows = rows.select(F.col(f"`{rule.storage_column}`").alias("_c"))
            found = rows.select(self.algorithms.cipher(rule.cipher).decrypt(F.col("_c")).alias("v")).limit(2).collect()
            if len(found) != 1:
                raise unsupported("GENERAL_FAILURE", f"{len(found)} rows for a handle")
        except VeilError as e:
            self.audit(event | {"success": False, "code": e.code.name})
            raise
        self.audit(event | {"success": True, "code": None})
        return found[0]["v"]

    def resolve(self, requests: DataFrame) -> DataFrame:
        """Values behind a table of handles (sid, pid, vid, hash): the same with a column ``plain``, null where none is found. A handle
        that leads to several rows fails the job, as a single lookup does."""
        parts = []
        for table in self.rules.tables():
            for rule in self.rules.of(table).values():
                df = self.read(table)
                if df is None or not rule.key_column:
                    continue
                key = named(df, rule.business_key or "id")
                if key is None:
                    continue
                own = df.select(F.lit(rule.sid).alias("sid"), F.lit(rule.pid).alias("pid"), F.col(f"`{key}`").cast("string").alias("vid"), F.col(f"`{rule.key_column}`").alias("hash"), F.col(f"`{rule.column if rule.separate else rule.storage_column}`").alias("_c"))
                if rule.separate:
                    own = own.join(self.read(rule.storage_table).groupBy(F.col(rule.hash_column).alias("hash")).agg(F.any_value(rule.storage_column).alias("_c2")), "hash").withColumn("_c", F.col("_c2")).drop("_c2")
                wanted = requests.select("sid", "pid", "vid", "hash").distinct().join(own, ["sid", "pid", "vid", "hash"])
                single = wanted.groupBy("sid", "pid", "vid", "hash").agg(F.count(F.lit(1)).alias("_n"), F.any_value("_c").alias("_c"))
                one = F.when(F.col("_n") == 1, F.col("_c")).otherwise(F.raise_error(F.concat(F.lit("GENERAL_FAILURE: "), F.col("_n"), F.lit(" rows for a handle"))).cast("string"))
                parts.append(single.select("sid", "pid", "vid", "hash", self.algorithms.cipher(rule.cipher).decrypt(one).alias("plain")))
        if not parts:
            return requests.withColumn("plain", F.lit(None).cast("string"))
        known = parts[0]
        for p in parts[1:]:
            known = known.unionByName(p)
        return requests.join(known, ["sid", "pid", "vid", "hash"], "left")


@dataclass(frozen=True)
class Relation:
    """A query built step by step from SQL fragments over logical names; every step nests the one before."""

    engine: Engine
    tree: Any
    args: tuple = ()

    def _next(self, select: A.Select, args: Iterable[Any]) -> Relation:
        return Relation(self.engine, select, (*self.args, *args))

    @property
    def _source(self) -> Any:
        """A plain table stays one, so that its shadow columns remain in reach."""
        t = self.tree
        if isinstance(t, A.Select) and isinstance(t.source, A.Table) and t == A.Select((A.Item(A.Star()),), source=t.source):
            return t.source
        return A.Derived(t, "t")

    def _parse(self, fragment: str) -> Any:
        """Parameters of a fragment follow those of the steps before."""
        made = A.Parser(fragment)
        made.params = len(self.args)
        return made

    def where(self, condition: str, *args: Any) -> Relation:
        return self._next(A.Select((A.Item(A.Star()),), source=self._source, where=self._parse(condition).expr()), args)

    def select(self, *items: str, args: Iterable[Any] = ()) -> Relation:
        return self._next(A.Select(tuple(self._parse(", ".join(items)).listed_items()), source=self._source), args)

    def group_by(self, *keys: str) -> Grouped:
        return Grouped(self, keys)

    def join(self, other: str | Relation, on: str, how: str = "INNER", left: str = "l", right: str = "r", args: Iterable[Any] = ()) -> Relation:
        a = self._source
        b = A.Table(other) if isinstance(other, str) else other._source
        tables = [A.Table(x.name, n) if isinstance(x, A.Table) else A.Derived(x.query, n) for x, n in ((a, left), (b, right))]
        items = [A.Item(A.Star(left))] + ([] if how.upper() in ("LEFT SEMI", "LEFT ANTI") else [A.Item(A.Star(right))])
        return self._next(A.Select(tuple(items), source=A.Join(*tables, f"{how.upper()} JOIN", self._parse(on).expr())), args)

    def order_by(self, *keys: str) -> Relation:
        return self._next(A.Select((A.Item(A.Star()),), source=self._source, order=tuple(self._parse(", ".join(keys)).listed_orders())), ())

    def limit(self, n: int) -> Relation:
        return self._next(A.Select((A.Item(A.Star()),), source=self._source, limit=A.Lit(n, str(n))), ())

    def _set(self, op: str, every: bool, other: Relation) -> Relation:
        shifted = A.transform_all(other.tree, lambda n: A.Param(n.index + len(self.args)) if isinstance(n, A.Param) else n)
        return Relation(self.engine, A.SetOp(op, every, self.tree, shifted), (*self.args, *other.args))

    def union_all(self, other: Relation) -> Relation:
        return self._set("UNION", True, other)

    def union(self, other: Relation) -> Relation:
        return self._set("UNION", False, other)

    def intersect(self, other: Relation) -> Relation:
        return self._set("INTERSECT", False, other)

    def except_(self, other: Relation) -> Relation:
        return self._set("EXCEPT", False, other)

    def distinct(self) -> Relation:
        return self._next(A.Select((A.Item(A.Star()),), distinct=True, source=self._source), ())

    @property
    def frame(self) -> Frame:
        return Frame(self.engine, self.engine.compiler(self.args).compile(self.tree))

    def reveal(self) -> DataFrame:
        return self.frame.reveal()

    def mask(self, **options: Any) -> DataFrame:
        return self.frame.mask(**options)


@dataclass(frozen=True)
class Grouped:
    of: Relation
    keys: tuple[str, ...]

    def agg(self, *items: str, having: str | None = None, args: Iterable[Any] = ()) -> Relation:
        r = self.of
        parsed = r._parse(", ".join(items))
        chosen = tuple(parsed.listed_items())
        keys = tuple(A.Parser(", ".join(self.keys)).listed_exprs())
        return r._next(A.Select(chosen, source=r._source, group=keys, having=None if having is None else r._parse(having).expr()), args)
