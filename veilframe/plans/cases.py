"""Registered queries of single features: value functions by fixed vectors, and what statements alone don't show."""

from __future__ import annotations

from collections.abc import Callable
from tempfile import TemporaryDirectory

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import names
from veilframe.engine import META, Engine
from veilframe.errors import VeilError
from veilframe.functions import masks, textmask
from veilframe.functions.algorithms import Algorithms
from veilframe.operators import backfill, ddl, masking
from veilframe.operators.payload import resolve_payloads
from veilframe.operators.protect import sequential
from veilframe.operators.reveal import decrypt_nested
from veilframe.plans import catalogue as C
from veilframe.rules import Rules
from veilframe.sources.routing import Sources
from veilframe.sources.store import SessionStore

# Inputs and what the functions make of them.
NAMES = {"张三": "张*", "王小明": "王*明", "欧阳娜娜": "欧**娜", "%李三%": "%李*%", "北京市字节跳动有限公司": "北京市字节****公司", "杭州未来科技公司": "杭州未来**公司"}
SEGMENTS = {"13800138000": "138****8000", "%13800138000%": "%138****8000%", "abc": "abc", "13_00138000": "13_001*8000"}
SCRUBBED = {
    "password=P@ssw0rd!": "password=*********", "phone=13800138000": "phone=*******8000", "mail alice@example.com now": "mail a****@example.com now", "id 110101199003071234.": "id 110************234.",
    "card 6222020202020202": "card ************0202", '{"authorization":"Bearer abc.def"}': '{"authorization":"**************"}', "status=SUCCESS": "status=SUCCESS",
}
KEYED = {("pwd", "abc"): "pwd=***", ("userPhone", "13800138000"): "userPhone=*******8000", ("status", "OK"): "status=OK", ("id_card", "110101199003071234"): "id_card=110************234", ("mail", "alice@example.com"): "mail=a****@example.com"}


def sql_values(rows: list[tuple], *columns: str) -> str:
    """The rows as DuckDB SQL."""
    one = lambda v: "null" if v is None else str(v) if isinstance(v, (int, bool)) else "'" + v.replace("'", "''") + "'"
    return "select * from (values " + ", ".join(f"({', '.join(map(one, r))})" for r in rows) + f") t({', '.join(columns)})"


def vectors(pairs: dict[str, str], column: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame([(k,) for k in pairs], "given string").select("given", column(F.col("given")).alias("made"))

    return run


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, v, textmask.key_value(k, v)) for k, v in KEYED], "k string, v string, made string")


IDENTIFIERS = {"userName": ("user_name", "userName"), "userIdCard": ("user_id_card", "userIdCard"), "user_id": ("user_id", "userId")}


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, names.snake(n), names.camel(names.snake(n)), names.alias_token(f"`{n}`.x y")) for n in IDENTIFIERS], "n string, snake string, camel string, token string")


def skip_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.engine(spark, sf_dir, tables=("user_account",)).raw("select id, phone_hash, id_card from user_account where id < 40")


def hinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that copies ciphertext; a hint says what it is."""
    e = C.engine(spark, sf_dir, tables=("user_account",))
    e.store.replace("copied", e.raw("select id, phone_cipher as m from user_account where id < 40"))
    return e.sql("select id, m from copied", hint={"m": "user_account.phone"})


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.engine(spark, sf_dir, tables=("user_account",))
    fields = {"email": masking.Sensitive("EMAIL"), "phone": masking.Sensitive(keep_first=3, keep_last=2), "id_card": masking.Sensitive(like="idCardMaskLike"), "name": masking.Sensitive(masker="hidden")}
    e.maskers["hidden"] = lambda c: F.when(c.endswith("1"), F.lit("hidden"))
    return e.sql("select id, name, phone, id_card, email from user_account where id < 60", mask=masking.ANNOTATED_FIELDS, fields=fields)


ANNOTATED_SQL = f"select id, case when name like '%1' then 'hidden' else name end as name, left(phone, 3) || repeat('*', length(phone) - 5) || right(phone, 2) as phone, left(id_card, 3) || repeat('*', 12) || right(id_card, 3) as id_card, left(email, 1) || repeat('*', strpos(email, '@') - 2) || substr(email, strpos(email, '@')) as email from {C.U} u where id < 60"


def masked_with_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.engine(spark, sf_dir, tables=("user_account",))
    rows = e.query("select id, phone, id_card from user_account where id < 60").mask(meta=True)
    return rows.select("id", "phone", F.col(META)["phone"]["vid"].alias("vid"), F.col(META)["phone"]["hash"].alias("hash"), F.col(META)["idCard"]["hash"].alias("card"))


HANDLES_SQL = f"select id, repeat('*', 7) || right(phone, 4) as phone, case when phone is not null then id::varchar end as vid, sha256(phone) as hash, sha256(id_card) as card from {C.U} u where id < 60"


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields inside arrays of structs, decrypted by their path."""
    e = C.engine(spark, sf_dir, tables=("user_account",))
    stored = e.raw("select nation, phone_cipher from user_account where id < 200")
    people = stored.groupBy("nation").agg(F.collect_list(F.struct(F.col("phone_cipher").alias("phone"))).alias("people"))
    shown = decrypt_nested(people, "people.phone", e.rules.find("user_account", "phone"), e.algorithms)
    return shown.select("nation", F.array_join(F.array_sort(F.col("people.phone")), ",").alias("phones"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.engine(spark, sf_dir, tables=("user_account",))
    meta = e.lookup_meta("user_account").where("id between 3 and 30 and phone is not null")
    asked = meta.select("id", F.to_json(F.struct(F.lit("*").alias("phone"), F.struct("phone").alias("sensitiveSubmitMeta"))).alias("payload"))
    older = meta.select("id", F.to_json(F.struct(F.struct(F.lit("masked").alias("state"), F.lit("x").alias("value"), F.col("idCard").alias("lookupMeta")).alias("idCard"))).alias("payload"))
    return resolve_payloads(e, asked.unionByName(older))


PAYLOAD_SQL = f"""select id, '{{"phone":"' || phone || '"}}' as payload from {C.U} u where id between 3 and 30 and phone is not null union all select id, '{{"idCard":"' || id_card || '"}}' from {C.U} u where id between 3 and 30 and phone is not null"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.engine(spark, sf_dir, tables=("user_account",))
    meta = e.lookup_meta("user_account").where("id between 3 and 30 and phone is not null")
    parts = lambda head, c: [F.concat(F.lit(f"&{head}[{p}]="), F.col(f"{c}.{p}")) for p in ("sid", "pid", "vid", "hash")]
    asked = F.concat(F.lit("a=1&phone=x"), *parts("sensitiveSubmitMeta[phone]", "phone"), F.lit("&idCard[state]=masked"), *parts("idCard[lookupMeta]", "idCard"), F.lit("&email[state]=changed&email[value]=new"))
    return resolve_payloads(e, meta.select("id", asked.alias("payload")), form=True)


FORMS_SQL = f"select id, 'a=1&phone=' || phone || '&idCard=' || id_card || '&email=new' as payload from {C.U} u where id between 3 and 30 and phone is not null"


def audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single lookups, good and bad, as the audit hook hears of them."""
    seen: list[dict] = []
    e = C.engine(spark, sf_dir, tables=("user_account",), audit=seen.append)
    good = e.lookup_meta("user_account").where("id = 3").first()
    found = []
    for meta in (good.phone.asDict(), good.idCard.asDict(), good.phone.asDict() | {"vid": "0"}, good.phone.asDict() | {"sid": "x"}, {"sid": ""}):
        try:
            found.append(e.lookup(meta))
        except VeilError:
            found.append(None)
    return spark.createDataFrame([(i, v, s["success"], s["code"], s["property"]) for i, (v, s) in enumerate(zip(found, seen, strict=True))], "i int, plain string, success boolean, code string, property string")


AUDIT_SQL = sql_values([(0, "13800000003", True, None, "phone"), (1, "110101000000000003", True, None, "idCard"), (2, None, False, "GENERAL_FAILURE", "phone"), (3, None, False, "INVALID_FIELD_RULE", None), (4, None, False, "GENERAL_FAILURE", None)], "i", "plain", "success", "code", "property")


def preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy = lambda table, df: df.withColumn("phone", F.trim("phone")) if "phone" in df.columns else df
    e = Engine(spark, C.rules(), C.algorithms(), preprocessors=[tidy])
    e.insert("user_account", C.logical(spark, sf_dir, C.USERS, "customer").withColumn("phone", F.concat(F.lit("  "), "phone", F.lit(" "))))
    return e.sql("select id, phone from user_account where phone in ('13800000003', '13800000004', '13800000005')")


def replayed_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is inserted twice under one token, as after a failure, is there once."""
    e = Engine(spark, C.rules(), C.algorithms(), store=SessionStore())
    rows = C.logical(spark, sf_dir, C.USERS, "customer").where("id < 100")
    for token in ("a-1", "a-1", "a-2"):
        e.insert("user_account", rows if token == "a-1" else rows.withColumn("id", F.col("id") + 1000), token=token)
    return e.sql("select id, phone, id_card from user_account")


REPLAYED_SQL = f"select id, phone, id_card from {C.U} u where id < 100 union all select id + 1000, phone, id_card from {C.U} u where id < 100"


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two data sources with a table of one name, each with its external rows and dialect."""
    half = lambda k: C.logical(spark, sf_dir, C.USERS, "customer").where(f"id % 2 = {k} and id < 60")
    both = Sources({n: Engine(spark, C.rules(), C.algorithms()) for n in ("main", "audit_1")}, {"audit_*": "ORACLE12"})
    both.insert("user_account", half(0))
    with both.use("audit_1"):
        both.insert("user_account", half(1))
    parts = [both.sql("select id, id_card from user_account", source=n).select(F.lit(n).alias("source"), F.lit(both.dialect(n)).alias("dialect"), "*") for n in both.engines]
    return parts[0].unionByName(parts[1])


ROUTED_SQL = f"select case when id % 2 = 0 then 'main' else 'audit_1' end as source, case when id % 2 = 0 then 'MYSQL' else 'ORACLE12' end as dialect, id, id_card from {C.U} u where id < 60"


def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark, C.rules(), C.algorithms(), ids=sequential(since=1735689600000))
    e.insert("user_account", C.logical(spark, sf_dir, C.USERS, "customer"))
    e.store.replace("card_store", e.read("card_store").checkpoint() if spark.sparkContext.getCheckpointDir() else e.read("card_store"))
    key = C.rules().find("user_account", "id_card").storage_id_column
    n = F.col(f"`{key}`").cast("long")
    # The moment in an id is the one that was given, or a little later.
    return e.read("card_store").agg(F.count_distinct(n).alias("n"), F.min(F.shiftright(n, 22) >= 1735689600000 - 1704067200000).alias("later"))


def safe_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets inside arrays of structs, maps of structs and arrays of arrays."""
    u = C.logical(spark, sf_dir, C.USERS, "customer").where("phone is not null and id < 90")
    deep = u.select(
        "id", F.array(F.struct(F.col("phone").alias("password"), F.lit("OK").alias("status"))).alias("list"), F.create_map(F.lit("one"), F.struct(F.col("email").alias("token"))).alias("m"),
        F.array(F.array("phone")).alias("phones"), F.struct(F.create_map(F.lit("mobile"), "phone").alias("inner")).alias("s"), F.col("name").alias("holder"),
    )
    safe = textmask.safe_frame(deep, annotated=("holder",))
    return safe.select("id", F.col("list")[0]["password"].alias("password"), F.col("list")[0]["status"].alias("status"), F.col("m")["one"]["token"].alias("token"), F.col("phones")[0][0].alias("phone"), F.col("s.inner")["mobile"].alias("mobile"), "holder")


SAFE_SQL = f"select id, repeat('*', length(phone)) as password, 'OK' as status, repeat('*', length(email)) as token, repeat('*', 7) || right(phone, 4) as phone, repeat('*', 7) || right(phone, 4) as mobile, repeat('*', length(name)) as holder from {C.U} u where phone is not null and id < 90"


# --- backfill

REUSED = [{"table": "t", "fields": [{"property": "phone", "cipher": "aes", "hash": "sha256", "storage_column": "phone_cipher", "hash_column": "phone", "like_column": "phone_like"}]}]


def repeated_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that becomes its own hash: a second run with a fresh state recognises what is done."""
    e = Engine(spark, Rules.load(REUSED), C.algorithms(), tables={"t": C.plain_table(spark, sf_dir).select("id", "phone")})
    batch = C.third(spark, sf_dir)
    reports = [backfill.Task(e, backfill.Definition("t", ("id",), batch=batch, together=2), backfill.MemoryState()).run() for _ in range(2)]
    return reports[0].frame(spark).unionByName(reports[1].frame(spark)).select("scanned", "migrated", "skipped", "status").withColumn("found", F.lit(e.sql("select id from t where phone = '13800000042'").count()))


REPEATED_SQL = f"with u as {C.U}, f as (select count(*) as found from u where phone = '13800000042') select count(*) as scanned, count(phone) as migrated, count(*) - count(phone) as skipped, 'COMPLETED' as status, any_value(found) as found from u, f union all select count(*), 0, count(*), 'COMPLETED', any_value(found) from u, f"


def backups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is overwritten is kept first, in a column that a template names; slices in several jobs."""
    e = Engine(spark, C.rules(), C.algorithms(), tables={"user_account": C.plain_table(spark, sf_dir)})
    backfill.Task(e, backfill.Definition("user_account", ("id",), batch=max(1, C.third(spark, sf_dir) // 3), together=2, include=("idCard",), backup_template="{column}_kept")).run()
    return e.read("user_account").select("id", "id_card", "id_card_kept", "phone")


def code_of(run: Callable[[], object]) -> str:
    try:
        run()
    except VeilError as e:
        return e.code.name
    return "ACCEPTED"


def backfill_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "id long, phone string, id_card string, email string"
    make = lambda rows=((1, "1", "2", "3"),), more="": Engine(spark, C.rules(), C.algorithms(), tables={"user_account": spark.createDataFrame(list(rows), schema + more)})
    d = lambda **o: backfill.Definition("user_account", ("id",), **o)
    task = lambda e, what, *o: backfill.Task(e, what, *o).run()
    found = []

    def case(name: str, run: Callable[[], object]) -> None:
        found.append((name, code_of(run)))

    case("no_cursor", lambda: backfill.plan(make(), backfill.Definition("user_account", ())))
    case("no_rules", lambda: backfill.plan(make(), backfill.Definition("nothing", ("id",))))
    case("selector", lambda: backfill.plan(make(), d(include=("nope",))))
    case("cursor_changes", lambda: backfill.plan(make(), backfill.Definition("user_account", ("id_card",))))
    case("backup_conflict", lambda: backfill.plan(make(), d(backup={"id_card": "phone_hash"})))
    case("backup_template_conflict", lambda: backfill.plan(make(), d(backup_template="{column}_hash")))
    case("excluded", lambda: backfill.plan(make(), d(excluded_tables=("USER_ACCOUNT",))))
    case("cursor_null", lambda: task(make(((None, "1", "2", "3"),)), d()))
    case("lost", lambda: task(make(((1, "1", "ab" * 32, "3"),)), d()))
    case("odd_backup", lambda: task(make(((1, "1", "one", "3", "two"),), ", b string"), d(backup={"id_card": "b"})))
    same = Engine(spark, Rules.load(REUSED), C.algorithms(), tables={"t": spark.createDataFrame([(1, "ab" * 32, None, "138")], "id long, phone string, phone_cipher string, phone_like string")})
    case("lost_in_same_table", lambda: task(same, backfill.Definition("t", ("id",))))
    with TemporaryDirectory() as folder:
        state = backfill.FileState(folder)
        with state.lock("user_account"):
            case("locked", lambda: task(make(), d(), backfill.FileState(folder)))
        case("unconfirmed", lambda: task(make(), d(), state, backfill.from_file(folder)))
        case("unexpected", lambda: task(make(), d(), state, backfill.expected({"user_account": {"x"}})))
        case("other_scope", lambda: task(make(), d(source="a"), state, backfill.expected({"b|user_account": {"x"}})))
        risks = backfill.plan(make(), d()).risks()
        case("most_specific_scope", lambda: task(make(), d(source="a", entity="User"), state, backfill.expected({"*": {"x"}, "user_account": {"x"}, "a|User|user_account": risks})))
        case("other_plan", lambda: task(make(), d(include=("phone",)), state))
        with open(f"{folder}/user_account.json", "w") as f:
            f.write("{")
        case("broken_state", lambda: task(make(), d(), state))
    return spark.createDataFrame(found, "name string, code string")


REFUSALS = {
    "no_cursor": "DEFINITION_INVALID", "no_rules": "METADATA_RULE_MISSING", "selector": "FIELD_SELECTOR_UNRESOLVED", "cursor_changes": "CURSOR_COLUMN_MUTABLE", "backup_conflict": "BACKUP_COLUMN_CONFLICT", "backup_template_conflict": "BACKUP_COLUMN_CONFLICT",
    "excluded": "TABLE_EXCLUDED", "cursor_null": "CURSOR_VALUE_MISSING", "lost": "PLAINTEXT_UNRECOVERABLE", "odd_backup": "BACKUP_VALUE_INCONSISTENT", "lost_in_same_table": "PLAINTEXT_UNRECOVERABLE", "locked": "CHECKPOINT_LOCKED",
    "unconfirmed": "CONFIRMATION_REQUIRED", "unexpected": "CONFIRMATION_SCOPE_MISMATCH", "other_scope": "CONFIRMATION_REQUIRED", "most_specific_scope": "ACCEPTED", "other_plan": "STATE_INCOMPATIBLE", "broken_state": "STATE_STORE_DATA_INVALID",
}


def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that statements for a table add, by dialect."""
    columns = {"id": "bigint", "phone": "varchar(64)", "id_card": "varchar(80)", "email": "varchar(18)"}
    wanted = {"MYSQL": ["alter table `user_account` add column `phone_cipher` varchar(380)", "alter table `user_account` add column `email_cipher` varchar(136)", "alter table `user_account` add column `id_card_backup` varchar(80)"], "ORACLE12": ["add \"phone_hash\" varchar2(64)"], "CLICKHOUSE": []}
    rows = []
    for dialect, own in wanted.items():
        try:
            found = ddl.statements(C.rules(), "user_account", columns, dialect, backup={"id_card": "id_card_backup"})
            rows += [(dialect, w, any(w in s for s in found)) for w in own]
        except VeilError as e:
            rows.append((dialect, e.code.name, True))
    return spark.createDataFrame(rows, "dialect string, statement string, there boolean")


DDL_SQL = sql_values([("MYSQL", "alter table `user_account` add column `phone_cipher` varchar(380)", True), ("MYSQL", "alter table `user_account` add column `email_cipher` varchar(136)", True), ("MYSQL", "alter table `user_account` add column `id_card_backup` varchar(80)", True), ("ORACLE12", "add \"phone_hash\" varchar2(64)", True), ("CLICKHOUSE", "DEFINITION_INVALID", True)], "dialect", "statement", "there")


def unprotected_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine without the keys of its rules doesn't start; keys don't show in plans."""
    started = code_of(lambda: Engine(spark, C.rules(), Algorithms.standard()))
    e = C.engine(spark, sf_dir, tables=("user_account",))
    plan = e.query("select phone from user_account where id = 3").reveal()._jdf.queryExecution().toString()
    import hashlib

    key = hashlib.sha256(b"catalogue-aes-key").hexdigest()[:32]
    shown = any(x in plan.lower() for x in (key, " ".join(key[i : i + 2] for i in range(0, 32, 2))))
    return spark.createDataFrame([(started, shown)], T.StructType([T.StructField("started", T.StringType()), T.StructField("key_shown", T.BooleanType())]))


CASES: dict[str, tuple[C.Query, str | None]] = {
    "name_mask_vectors": (vectors(NAMES, masks.name_mask), sql_values(list(NAMES.items()), "given", "made")),
    "literal_segments": (vectors(SEGMENTS, masks.keep_first_last(3, 4)), sql_values(list(SEGMENTS.items()), "given", "made")),
    "text_scrub_vectors": (vectors(SCRUBBED, textmask.scrub_column), sql_values(list(SCRUBBED.items()), "given", "made")),
    "key_value_vectors": (keyed, sql_values([(*k, v) for k, v in KEYED.items()], "k", "v", "made")),
    "identifiers": (identifiers, sql_values([(n, *x, f"{n}_x_y") for n, x in IDENTIFIERS.items()], "n", "snake", "camel", "token")),
    "skip_rewrite": (skip_rewrite, f"select id, sha256(phone) as phone_hash, sha256(id_card) as id_card from {C.U} u where id < 40"),
    "result_hint": (hinted, f"select id, phone as m from {C.U} u where id < 40"),
    "annotated_fields": (annotated, ANNOTATED_SQL),
    "masked_with_handles": (masked_with_handles, HANDLES_SQL),
    "nested_decrypt": (nested, f"select nation, coalesce(string_agg(phone, ',' order by phone), '') as phones from {C.U} u where id < 200 group by nation"),
    "payloads": (payloads, PAYLOAD_SQL),
    "form_payloads": (forms, FORMS_SQL),
    "audited_lookups": (audited, AUDIT_SQL),
    "preprocessed": (preprocessed, f"select id, phone from {C.U} u where phone in ('13800000003', '13800000004', '13800000005')"),
    "replayed_insert": (replayed_insert, REPLAYED_SQL),
    "routed_sources": (routed, ROUTED_SQL),
    "sequential_ids": (sequential_ids, f"select count(distinct id_card) as n, true as later from {C.U} u"),
    "safe_log_nested": (safe_nested, SAFE_SQL),
    "repeated_backfill": (repeated_backfill, REPEATED_SQL),
    "backfill_backups": (backups, f"select id, sha256(id_card) as id_card, id_card as id_card_kept, phone from {C.U} u"),
    "backfill_refusals": (backfill_refusals, sql_values(list(REFUSALS.items()), "name", "code")),
    "ddl_columns": (ddl_columns, DDL_SQL),
    "keys_stay_hidden": (unprotected_engine, "select 'MISSING_CIPHER_ALGORITHM' as started, false as key_shown"),
}
