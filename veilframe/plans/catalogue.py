"""The registered queries over protected tables, and what they equal on plaintext.

The given tables hold no personal data, so protected ones are derived from them by expressions that Spark and DuckDB read alike:
``user_account`` from customer, ``user_archive`` from supplier, ``order_account`` from orders, ``profile`` from events.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.engine import Engine
from veilframe.errors import VeilError
from veilframe.functions import masks, textmask
from veilframe.functions.algorithms import Algorithms
from veilframe.operators import backfill, ddl, masking
from veilframe.rules import Rules
from veilframe.sources.shared import shared_folder
from veilframe.sources.store import SnapshotStore

Query = Callable[[SparkSession, str], DataFrame]

USERS = """
  select c_custkey as id, c_name as name, c_nationkey as nation, c_acctbal as balance,
    case when c_custkey % 17 = 0 then null else '138' || lpad(cast(c_custkey as varchar(20)), 8, '0') end as phone,
    '110101' || lpad(cast(c_custkey % 500 as varchar(20)), 12, '0') as id_card,
    'U' || cast(c_custkey % 700 as varchar(20)) || '@Example.com' as email
  from customer"""
ARCHIVE = "select s_suppkey as id, s_name as name, '138' || lpad(cast(s_suppkey * 3 as varchar(20)), 8, '0') as phone, '110101' || lpad(cast(s_suppkey as varchar(20)), 12, '0') as id_card from supplier"
ORDERS = "select o_orderkey as id, o_custkey as user_id, o_totalprice as price, o_orderstatus as status from orders"
PROFILES = "select event_id as id, user_id, '{\"phone\":\"138' || lpad(cast(user_id as varchar(20)), 8, '0') || '\",\"n\":' || cast(event_id as varchar(20)) || ',\"tags\":[\"' || event_type || '\",{\"card\":\"6222' || lpad(cast(user_id as varchar(20)), 12, '0') || '\"}]}' as profile_json from events"


def rules(cipher: str = "aes", digest: str = "sha256") -> Rules:
    """Phones in the same table, id cards in an external one, mails without a LIKE form."""
    own = {"cipher": cipher, "hash": digest}
    phone = own | {"property": "phone", "storage_column": "phone_cipher", "hash_column": "phone_hash", "like_column": "phone_like", "masked_column": "phone_masked", "masked": "phoneMaskLike", "business_key": "id"}
    card = own | {"property": "idCard", "mode": "SEPARATE_TABLE", "storage_table": "card_store", "storage_column": "id_card_cipher", "hash_column": "id_card_hash", "like_column": "id_card_like", "masked_column": "id_card_masked", "masked": "idCardMaskLike", "business_key": "id"}
    mail = own | {"property": "email", "storage_column": "email_cipher", "hash_column": "email_hash"}
    json = {"column": "profile_json", "storage_table": "json_store", "hash_column": "value_hash", "cipher_column": "value_cipher", "paths": [{"path": "$.phone", **own}, {"path": "$.tags[1].card", **own}]}
    return Rules.load([
        {"table": "user_account", "fields": [phone, card, mail]},
        {"table": "user_archive", "fields": [phone, card]},
        {"table": "profile", "json": [json]},
    ])


def logical(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(sql.replace(f"from {table}", "from {src}"), src=source) if "{" not in sql else _formatted(spark, sql, table, source)


def _formatted(spark: SparkSession, sql: str, table: str, source: DataFrame) -> DataFrame:
    view = f"src_{table}_{uuid4().hex[:8]}"
    source.createOrReplaceTempView(view)
    return spark.sql(sql.replace(f"from {table}", f"from {view}"))


SOURCES = {"user_account": (USERS, "customer"), "user_archive": (ARCHIVE, "supplier"), "order_account": (ORDERS, "orders"), "profile": (PROFILES, "events")}
TABLES = tuple(SOURCES)


def algorithms() -> Algorithms:
    return Algorithms.standard({"aes": "catalogue-aes-key", "sm4": "catalogue-sm4-key"})


def fresh(spark: SparkSession, sf_dir: str, cipher: str = "aes", digest: str = "sha256", tables: tuple[str, ...] = TABLES, **options) -> Engine:
    """An engine that has just inserted the derived tables: what it reads is derived on the way."""
    made = Engine(spark, rules(cipher, digest), algorithms(), **options)
    for name in tables:
        made.insert(name, logical(spark, sf_dir, *SOURCES[name]))
    return made


#: Protected tables that this session has stored, by application, folder and algorithms.
_stored: dict[tuple, tuple[SnapshotStore, dict[str, DataFrame]]] = {}


def stored(spark: SparkSession, sf_dir: str, cipher: str, digest: str, tables: tuple[str, ...]) -> dict[str, DataFrame]:
    """Protected Parquet of the derived tables and their external ones, written once in a session and read by all its statements."""
    key = (spark.sparkContext.applicationId, sf_dir, cipher, digest)
    if key not in _stored:
        _stored[key] = SnapshotStore(spark, f"{shared_folder(spark)}/catalogue-{uuid4().hex}"), {}
    store, found = _stored[key]
    lacking = [t for t in tables if t not in found]
    writer = Engine(spark, rules(cipher, digest), algorithms(), store=store)
    for name in lacking:
        writer.insert(name, logical(spark, sf_dir, *SOURCES[name]))
    if lacking:
        found.clear()
        found.update((t, store.read(t)) for t in store.names())
    return dict(found)


def engine(spark: SparkSession, sf_dir: str, cipher: str = "aes", digest: str = "sha256", tables: tuple[str, ...] = TABLES, **options) -> Engine:
    """An engine over stored protected copies of the derived tables. What it writes stays in the session."""
    return Engine(spark, rules(cipher, digest), algorithms(), tables=stored(spark, sf_dir, cipher, digest, tables), **options)


#: name: (statement over logical columns, arguments, statement over plaintext if it isn't the same)
U, R, O, P = f"({USERS})", f"({ARCHIVE})", f"({ORDERS})", f"({PROFILES})"
STATEMENTS: dict[str, tuple[str, list, str | None]] = {
    "eq_lookup": ("select id, phone, name from user_account where phone = ?", ["13800000042"], None),
    "eq_reversed_concat": ("select id, phone from user_account where concat('138', ?) = phone", ["00000042"], None),
    "neq": ("select id, phone from user_account where phone != ? and id < 40", ["13800000002"], None),
    "in_list": ("select id, phone from user_account where phone in (?, '13800000007', concat('1380000', '0011'))", ["13800000005"], None),
    "not_in": ("select id, email from user_account where phone not in ('13800000001', ?) and id <= 30", ["13800000002"], None),
    "like_fuzzy": ("select id, phone from user_account where phone like ?", ["%00012%"], None),
    "like_prefix": ("select id, phone from user_account where phone like '138000000%'", [], None),
    "not_like": ("select id, phone from user_account where phone not like ?", ["%1%2%"], None),
    "like_exact_fallback": ("select id, email from user_account where email like ?", ["U77@Example.com"], None),
    "is_null": ("select id, name from user_account where phone is null", [], None),
    "is_not_null": ("select count(*) as n from user_account where id_card is not null and phone is not null", [], None),
    "range_technical": ("select id, phone from user_account where phone > ? and id < 200", ["13800000042"], "select id, phone from user_account where sha256(phone) > sha256('13800000042') and id < 200"),
    "find_in_set": ("select id, phone from user_account where find_in_set(phone, ?)", ["13800000003, 13800000004,x"], "select id, phone from user_account where phone in ('13800000003', '13800000004')"),
    "case_when": ("select id, case when phone = ? then 'hit' when id_card in ('110101000000000001') then 'card' else 'no' end as what from user_account where id < 600", ["13800000009"], None),
    "not_nested": ("select id from user_account where not ((phone = ? or id_card = ?) and balance > 0) and id < 50", ["13800000009", "110101000000000010"], None),
    "json_eq": ("select id, user_id from profile where json_extract(profile_json, '$.phone') = ?", ["13800000003"], "select id, user_id from profile where json_extract_string(profile_json, '$.phone') = '13800000003'"),
    "json_in": ("select id from profile where json_extract(profile_json, '$.tags[1].card') in (?, '6222000000000004')", ["6222000000000003"], "select id from profile where json_extract_string(profile_json, '$.tags[1].card') in ('6222000000000003', '6222000000000004')"),
    "json_restore": ("select id, profile_json from profile where user_id < 20", [], None),
    "col_eq_col": ("select u.id, a.id as other from user_account u, user_archive a where u.phone = a.phone", [], None),
    "join_protected": ("select u.id, u.phone, a.name from user_account u join user_archive a on u.phone = a.phone and a.phone <> ?", ["13800000003"], None),
    "join_separate": ("select u.id, a.id as archived, u.id_card from user_account u left join user_archive a on u.id_card = a.id_card where u.id <= 120", [], None),
    "join_self_alias": ("select x.id as a, y.id as b from user_account x join user_account y on x.email = y.email and x.id < y.id", [], None),
    "join_unprotected": ("select u.id, u.phone, o.price from order_account o join user_account u on o.user_id = u.id where u.phone in ('13800000001', '13800000002')", [], None),
    "semi_in_subquery": ("select id, phone from user_account where phone in (select phone from user_archive where id > ?)", [3], None),
    "plain_in_subquery": ("select id, status from order_account where user_id in (select id from user_account where phone like '%0007%')", [], None),
    "anti_not_exists": ("select u.id from user_account u where u.id < 100 and not exists (select 1 from user_archive a where a.phone = u.phone)", [], None),
    "exists_correlated": ("select u.id, u.phone from user_account u where exists (select 1 from order_account o where o.user_id = u.id and u.phone like '%0001%')", [], None),
    "not_in_nulls": ("select id from user_archive where id < 30 and phone not in (select phone from user_account where id = 17 or id = 3)", [], None),
    "cte_derived": ("with u as (select id, phone as mobile from user_account where phone = ?) select u.id, u.mobile from u where u.mobile = ?", ["13800000042", "13800000042"], None),
    "cte_columns": ("with u(k, p) as (select id, phone from user_account where id < 20) select k, p from u where p is not null", [], None),
    "derived_like": ("select t.p from (select phone as p, id from user_account) t where t.p like ?", ["%0003%"], None),
    "derived_twice": ("select s.q from (select t.p as q from (select phone as p from user_account) t where t.p <> '13800000001') s where s.q in ('13800000002', '13800000003')", [], None),
    "recursive_plain": ("with recursive n(k) as (select 1 union all select k + 1 from n where k < 5) select u.id, u.phone from user_account u join n on n.k = u.id", [], None),
    "union_all": ("select phone from user_account where id < 9 union all select phone from user_archive where id < 4", [], None),
    "union_distinct": ("select phone, id_card from user_account where id < 60 union select phone, id_card from user_archive where id < 30", [], None),
    "intersect": ("select phone from user_account intersect select phone from user_archive", [], None),
    "except_": ("select phone from user_archive except select phone from user_account where id < 100", [], None),
    "count_protected": ("select count(phone) as n, count(*) as every from user_account", [], None),
    "count_distinct_protected": ("select count(distinct email) as mails, count(distinct id_card) as cards from user_account", [], None),
    "group_by_protected": ("select email, count(*) as n, round(sum(balance), 2) as total from user_account group by email", [], None),
    "group_by_separate": ("select id_card, count(*) as n from user_account group by id_card", [], None),
    "group_by_ordinal": ("select nation, email, count(*) as n from user_account group by 1, 2", [], None),
    "having_protected": ("select phone, count(*) as n from user_account group by phone having phone = ? and count(phone) > 0", ["13800000042"], None),
    "having_in": ("select email, count(*) as n from user_account group by email having email in (?, 'U8@Example.com')", ["U7@Example.com"], None),
    "having_like": ("select phone, count(*) as n from user_account group by phone having phone like ?", ["%0012%"], None),
    "conditional_sum": ("select nation, sum(if(phone = ?, 1, 0)) as hits from user_account group by nation", ["13800000042"], "select nation, sum(case when phone = '13800000042' then 1 else 0 end) as hits from user_account group by nation"),
    "max_separate": ("select max(id_card) as m from user_account", [], "select arg_max(id_card, sha256(id_card)) as m from user_account"),
    "group_by_two": ("select email, nation, count(*) as n from user_account where id < 50 group by nation, email", [], None),
    "rollup_protected": ("select nation, email, count(*) as n, cast(grouping(email) as int) as g from user_account where id < 200 group by rollup(nation, email)", [], None),
    "cube_protected": ("select id_card, phone, count(*) as n from user_account where id < 40 group by cube(id_card, phone)", [], None),
    "grouping_sets": ("select email, nation, count(distinct phone) as n from user_account group by grouping sets ((email), (nation), (), (email, nation))", [], None),
    "grouping_sets_after": ("select email, nation, count(*) as n from user_account group by email, nation grouping sets ((email), ())", [], "select email, null::int as nation, count(*) as n from user_account group by grouping sets ((email), ())"),
    "with_rollup": ("select email, count(phone) as n from user_account group by email with rollup", [], "select email, count(phone) as n from user_account group by rollup(email)"),
    "intersect_all": ("select email from user_account where id < 1500 intersect all select email from user_account where id > 600", [], None),
    "except_all": ("select email, id_card from user_account where id < 1500 except all select email, id_card from user_account where id > 900", [], None),
    "lateral_view": ("select u.id, u.phone, x.w from user_account u lateral view explode(split(u.name, '#')) x as w where u.phone like ?", ["%0001%"], "select id, phone, unnest(string_split(name, '#')) as w from user_account where phone like '%0001%'"),
    "lateral_subquery": ("select u.id, u.phone, z.n from user_account u join lateral (select count(*) as n from order_account o where o.user_id = u.id) z on true where u.id < 60", [], None),
    "pivot_plain": ("select * from (select status, price, user_id from order_account where user_id < 40) t pivot (count(price) for status in ('F' as f, 'O' as o))", [], "select user_id, nullif(count(*) filter (where status = 'F'), 0) as f, nullif(count(*) filter (where status = 'O'), 0) as o from order_account where user_id < 40 group by user_id"),
    "sampled": ("select count(*) as n, count(phone) as phones from user_account tablesample (100 percent) u", [], "select count(*) as n, count(phone) as phones from user_account"),
    "max_same_table": ("select id, max(phone) as p, first(email) as m from user_account where id < 90 group by id", [], "select id, phone as p, email as m from user_account where id < 90"),
    "parenthesised": ("(select id, phone from user_account where id < 9) union all (select id, phone from user_archive where id < 5) order by id limit 6", [], None),
    "duplicate_column": ("select u.*, u.phone from user_account u where u.id < 9", [], "select * from user_account where id < 9"),
    "json_null": ("select id from profile where json_extract(profile_json, '$.phone') is null or id < 5", [], "select id from profile where json_extract_string(profile_json, '$.phone') is null or id < 5"),
    "json_group_plain": ("select json_extract(profile_json, '$.tags[0]') as t, count(*) as n from profile group by json_extract(profile_json, '$.tags[0]')", [], "select json_extract_string(profile_json, '$.tags[0]') as t, count(*) as n from profile group by 1"),
    "window_partition": ("select id, email, row_number() over (partition by email order by id) as k from user_account", [], None),
    "window_named": ("select id, sum(balance) over w as s, count(phone) over w as n from user_account window w as (partition by id_card order by id rows between unbounded preceding and current row)", [], None),
    "window_lag": ("select id, lag(id) over (partition by id_card order by id) as before from user_account", [], None),
    "qualify_row": ("select id, email from user_account qualify row_number() over (partition by email order by id) = 1", [], None),
    "qualify_like": ("select id, phone, rank() over (partition by id_card order by id desc) as k from user_account where id < 900 qualify k = 1 and phone like '%00%'", [], "select id, phone, rank() over (partition by id_card order by id desc) as k from user_account where id < 900 qualify k = 1 and phone like '%00%'"),
    "order_by_technical": ("select id, phone from user_account where phone is not null order by phone limit 10", [], "select id, phone from user_account where phone is not null order by sha256(phone) limit 10"),
    "order_by_separate": ("select id, id_card from user_account order by id_card, id desc limit 7", [], "select id, id_card from user_account order by sha256(id_card), id desc limit 7"),
    "limit_offset": ("select id, phone from user_account order by id limit 5 offset 10", [], None),
    "wildcard_select": ("select * from user_account where id < 20", [], None),
    "wildcard_alias": ("select u.*, o.price from user_account u join order_account o on o.user_id = u.id where u.id < 5", [], None),
    "separate_hydration": ("select id, id_card from user_account where id_card in ('110101000000000007', ?)", ["110101000000000008"], None),
    "separate_like_exists": ("select id, id_card from user_account where id_card like ?", ["%00000012%"], None),
    "separate_not_like": ("select id, id_card from user_account where id_card not like '%1' and id < 90", [], None),
    "separate_like_exact": ("select id, id_card from user_account where id_card like '110101000000000012'", [], None),
    "scalar_subquery": ("select o.id, (select u.phone from user_account u where u.id = o.user_id) as phone from order_account o where o.id < 40", [], None),
    "same_name_elsewhere": ("select o.id, o.status as phone from order_account o where o.status = 'F' and o.id < 100", [], None),
    "plain_aggregate_join": ("select a.status, count(distinct u.phone) as people, round(sum(a.price), 2) as total from order_account a join user_account u on u.id = a.user_id group by a.status", [], None),
}


def plaintext(sql: str) -> str:
    """DuckDB SQL over the derived tables in plain."""
    return f"with user_account as {U}, user_archive as {R}, order_account as {O}, profile as {P} select * from ({sql}) q" if not sql.lstrip().startswith("with") else f"with recursive user_account as {U}, user_archive as {R}, order_account as {O}, profile as {P}, " + sql.replace("with recursive ", "", 1).replace("with ", "", 1)


def bound(sql: str, args: list) -> str:
    """The statement with its arguments written in."""
    for a in args:
        sql = sql.replace("?", str(a) if isinstance(a, int) else "'" + a.replace("'", "''") + "'", 1)
    return sql


def statement(name: str) -> Query:
    sql, args, _ = STATEMENTS[name]
    used = tuple(t for t in ("user_account", "user_archive", "order_account", "profile") if t in sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return engine(spark, sf_dir, tables=used).sql(sql, args)

    return run


# --- value functions


def masks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = logical(spark, sf_dir, USERS, "customer")
    c = F.col
    return u.select("id", masks.keep_first_last(0, 4)(c("phone")).alias("phone"), masks.keep_first_last(3, 3)(c("id_card")).alias("card"), masks.keep_from_to(3, 6)(c("id_card")).alias("from_to"), masks.mask_first_last(3, 4)(c("id_card")).alias("ends"), masks.mask_from_to(3, 6)(c("id_card")).alias("middle"), masks.type_mask(c("email"), "EMAIL").alias("email"), masks.type_mask(c("id_card"), "BANK_CARD").alias("bank"), masks.type_mask(c("name"), "NAME").alias("name"), masks.normalized_like(c("email")).alias("normal"))


MASKS_SQL = f"""select id, repeat('*', length(phone) - 4) || right(phone, 4) as phone, left(id_card, 3) || repeat('*', length(id_card) - 6) || right(id_card, 3) as card,
 '***' || substr(id_card, 4, 4) || repeat('*', length(id_card) - 7) as from_to, '***' || substr(id_card, 4, length(id_card) - 7) || '****' as ends,
 left(id_card, 3) || '****' || substr(id_card, 8) as middle, left(email, 1) || repeat('*', strpos(email, '@') - 2) || substr(email, strpos(email, '@')) as email,
 left(id_card, 6) || repeat('*', length(id_card) - 10) || right(id_card, 4) as bank, left(name, 1) || repeat('*', length(name) - 1) as name, lower(email) as normal from {U} u"""


def shadow_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh(spark, sf_dir, tables=("user_account",))
    return e.read("user_account").select("id", "phone_hash", "phone_like", "phone_masked", F.col("id_card").alias("card_ref"), F.length("phone_cipher").alias("cipher_length"))


SHADOW_SQL = f"select id, sha256(phone) as phone_hash, lower(phone) as phone_like, repeat('*', 7) || right(phone, 4) as phone_masked, sha256(id_card) as card_ref, ((length(phone) + 28 + 2) // 3 * 4)::int as cipher_length from {U} u"


def separate_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh(spark, sf_dir, tables=("user_account", "user_archive"))
    return e.read("card_store").select("id_card_hash", "id_card_like", "id_card_masked")


DEDUPE_SQL = f"select sha256(c) as id_card_hash, c as id_card_like, left(c, 3) || repeat('*', 12) || right(c, 3) as id_card_masked from (select id_card as c from {U} union select id_card from {R})"


def national_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM4 ciphertext and SM3 hashes end to end."""
    return fresh(spark, sf_dir, "sm4", "sm3", tables=("user_account",)).sql("select id, phone, id_card, email from user_account where phone in (?, ?) or id_card like ?", ["13800000003", "13800000004", "%0000001%"])


def masked_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account",))
    return e.sql("select id, name, phone, id_card, email from user_account where id < 300", mask=masking.RECORDED_THEN_ANNOTATED, fields={"email": masking.Sensitive(), "name": masking.Sensitive("NAME")})


MASKED_SQL = f"select id, left(name, 1) || repeat('*', length(name) - 1) as name, repeat('*', 7) || right(phone, 4) as phone, left(id_card, 3) || repeat('*', 12) || right(id_card, 3) as id_card, left(email, 1) || repeat('*', strpos(email, '@') - 2) || substr(email, strpos(email, '@')) as email from {U} u where id < 300"


def updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account",))
    e.sql("update user_account set phone = ?, id_card = ?, balance = balance + 1 where phone = ? or id_card = ?", ["13900000000", "220000000000000000", "13800000042", "110101000000000010"])
    return e.sql("select id, phone, id_card, balance from user_account where phone = ? or id_card = ? or id < 30", ["13900000000", "220000000000000000"])


UPDATED_SQL = f"select * from (select id, case when hit then '13900000000' else phone end as phone, case when hit then '220000000000000000' else id_card end as id_card, balance + case when hit then 1 else 0 end as balance from (select *, coalesce(phone = '13800000042', false) or id_card = '110101000000000010' as hit from {U})) where phone = '13900000000' or id_card = '220000000000000000' or id < 30"


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account",))
    e.sql("delete from user_account where phone like ? or id_card = ?", ["%0001%", "110101000000000010"])
    return e.sql("select id, phone from user_account")


def inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account",))
    e.sql("insert into user_account (id, name, phone, id_card, email) values (?, 'new', ?, '110101000000000003', null), (900002, 'other', null, ?, 'x@y.z')", [900001, "13700000000", "330101000000000003"])
    return e.sql("select id, name, phone, id_card, email from user_account where id > 900000 or phone = ?", ["13800000005"])


INSERTED_SQL = f"select id, name, phone, id_card, email from {U} u where phone = '13800000005' union all values (900001, 'new', '13700000000', '110101000000000003', null), (900002, 'other', null, '330101000000000003', 'x@y.z')"


def json_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fresh(spark, sf_dir, tables=("profile",))
    return e.read("profile").select("id", F.get_json_object("profile_json", "$.phone").alias("phone_ref"), F.get_json_object("profile_json", "$.tags[1].card").alias("card_ref"), F.get_json_object("profile_json", "$.n").alias("n"))


JSON_SQL = f"select id, sha256(json_extract_string(profile_json, '$.phone')) as phone_ref, sha256(json_extract_string(profile_json, '$.tags[1].card')) as card_ref, json_extract_string(profile_json, '$.n') as n from {P} p"


def lookup_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account",))
    return e.lookup_meta("user_account").select("id", F.col("phone.vid").alias("vid"), F.col("phone.hash").alias("hash"), F.col("idCard.hash").alias("card"))


META_SQL = f"select id, case when phone is not null then id::varchar end as vid, sha256(phone) as hash, sha256(id_card) as card from {U} u"


def lookup_plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account",))
    metas = e.lookup_meta("user_account")
    asked = metas.select("id", "phone.*").unionByName(metas.select("id", "idCard.*")).where("sid is not null")
    return e.resolve(asked).select("id", "plain")


LOOKUP_SQL = f"select id, phone as plain from {U} u where phone is not null union all select id, id_card from {U} u"


def relation_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account", "order_account"))
    users = e.table("user_account").where("phone like ?", "%000%").select("id as uid", "phone", "email")
    joined = users.join("order_account", "l.uid = r.user_id")
    return joined.group_by("email").agg("email", "count(*) as n", "count(distinct phone) as phones", having="count(*) > 5").reveal()


RELATION_SQL = f"select email, count(*) as n, count(distinct phone) as phones from {U} u join {O} o on u.id = o.user_id where phone like '%000%' group by email having count(*) > 5"


# --- text


def text_scrub_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", textmask.scrub_column(F.col("text")).alias("text"))


def text_scrub_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select("conv_id", "turn", "role", textmask.scrub_column(F.col("text")).alias("text"))


def safe_log_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = logical(spark, sf_dir, USERS, "customer")
    entries = F.create_map(F.lit("phone"), "phone", F.lit("token"), "id_card", F.lit("status"), F.lit("SUCCESS"))
    return textmask.safe_frame(u.select("id", entries.alias("m"))).select("id", F.col("m")["phone"].alias("phone"), F.col("m")["token"].alias("token"), F.col("m")["status"].alias("status"))


SAFE_SQL = f"select id, repeat('*', 7) || right(phone, 4) as phone, repeat('*', length(id_card)) as token, 'SUCCESS' as status from {U} u"


# --- backfill


def plain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logical(spark, sf_dir, USERS, "customer").select("id", "name", "phone", "id_card", "email")


def migrated(spark: SparkSession, sf_dir: str, **options) -> tuple[Engine, backfill.Report]:
    e = Engine(spark, rules(), Algorithms.standard({"aes": "catalogue-aes-key"}), tables={"user_account": plain_table(spark, sf_dir)})
    return e, backfill.Task(e, backfill.Definition("user_account", ("id",), backup={"id_card": "id_card_backup"}, **options), backfill.MemoryState()).run()


def third(spark: SparkSession, sf_dir: str) -> int:
    """Slices of a third of the table, so that every size has some."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").count() // 3 + 1


def migrate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, _ = migrated(spark, sf_dir, batch=third(spark, sf_dir))
    return e.sql("select id, phone, id_card, email, id_card_backup from user_account")


def migrate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = migrated(spark, sf_dir, batch=third(spark, sf_dir))
    return report.frame(spark)


def migrate_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stops after its first slice, and one that goes on from there."""
    e = Engine(spark, rules(), Algorithms.standard({"aes": "catalogue-aes-key"}), tables={"user_account": plain_table(spark, sf_dir)})
    state, what = backfill.MemoryState(), backfill.Definition("user_account", ("id",), batch=third(spark, sf_dir), backup={"id_card": "id_card_backup"})
    first = backfill.Task(e, what, state).run(most_slices=1)
    second = backfill.Task(e, what, state).run()
    return first.frame(spark).unionByName(second.frame(spark)).select("scanned", "migrated", "status")


def ddl_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {"id": "bigint", "phone": "varchar(64)", "id_card": "varchar(80)", "email": "varchar(18)"}
    found = ddl.statements(rules(), "user_account", columns, "MYSQL")
    return spark.createDataFrame([(i, s) for i, s in enumerate(found)], "k int, statement string")


# --- what is refused

REFUSED: dict[str, tuple[str, list]] = {
    "between": ("select id from user_account where phone between '1' and '2'", []),
    "between_protected_bound": ("select id from user_account where '1' between phone and '2'", []),
    "distinct": ("select distinct phone from user_account", []),
    "sum": ("select sum(phone) as s from user_account", []),
    "min_having": ("select nation from user_account group by nation having max(phone) > '1'", []),
    "window_order": ("select row_number() over (order by phone) as k from user_account", []),
    "group_expression": ("select count(*) as n from user_account group by substr(phone, 1, 3)", []),
    "order_expression": ("select id from user_account order by upper(phone)", []),
    "no_hash": ("select id from no_hash_table where phone = '1'", []),
    "no_like": ("select id from user_account where email not like 'a%'", []),
    "operand": ("select id from user_account where phone = upper('a')", []),
    "star_join": ("select * from user_account u join user_archive a on u.id = a.id", []),
    "in_star": ("select id from user_account where phone in (select * from user_archive)", []),
    "in_separate": ("select id from user_account where id_card in (select id_card from user_archive)", []),
    "ambiguous": ("select phone from user_account u join user_archive a on u.id = a.id", []),
    "function": ("select substr(phone, 1, 3) as p from user_account", []),
    "recursive": ("with recursive r as (select phone from user_account union all select phone from r) select * from r", []),
    "two_ranges": ("select u.id from user_account u join user_archive a on u.phone < a.phone", []),
    "insert_select": ("insert into user_account (id, phone) select id, phone from user_archive", []),
    "write_operand": ("update user_account set phone = upper(name) where id = 1", []),
    "find_in_set_reversed": ("select id from user_account where find_in_set('x', phone) > 0", []),
    "json_like": ("select id from profile where json_extract(profile_json, '$.phone') like '138%'", []),
    "json_projected": ("select json_extract(profile_json, '$.phone') as p from profile", []),
    "json_grouped": ("select count(*) as n from profile group by json_extract(profile_json, '$.phone')", []),
    "json_in_query": ("select id from profile where json_extract(profile_json, '$.phone') in (select phone from user_account)", []),
    "json_range": ("select id from profile where json_extract(profile_json, '$.phone') > '1'", []),
    "json_mutation": ("update profile set profile_json = json_set(profile_json, '$.phone', 'x') where id = 1", []),
    "pivot": ("select * from user_account pivot (count(id) for nation in (1, 2))", []),
    "rollup_expression": ("select count(*) as n from user_account group by rollup(substr(phone, 1, 3))", []),
    "lateral_protected": ("select x.w from user_account u lateral view explode(split(u.phone, '0')) x as w", []),
    "natural_join": ("select u.id from user_account u natural join user_archive a", []),
    "using_join": ("select u.id from user_account u join user_archive a using (phone)", []),
}


def reject_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, tables=("user_account", "user_archive", "profile"))
    e.rules.add(Rules.load([{"table": "no_hash_table", "fields": [{"property": "phone", "storage_column": "phone_cipher"}]}]).find("no_hash_table", "phone"))
    e.store.replace("no_hash_table", spark.createDataFrame([(1, "x")], "id int, phone_cipher string"))
    found = []
    for name, (sql, args) in REFUSED.items():
        try:
            e.sql(sql, args)
            found.append((name, "ACCEPTED"))
        except VeilError as err:
            found.append((name, err.code.name))
    return spark.createDataFrame(found, "name string, code string")


REFUSAL_CODES = {
    "between": "UNSUPPORTED_ENCRYPTED_RANGE", "between_protected_bound": "UNSUPPORTED_ENCRYPTED_RANGE", "distinct": "UNSUPPORTED_ENCRYPTED_DISTINCT", "sum": "UNSUPPORTED_ENCRYPTED_AGGREGATION",
    "min_having": "UNSUPPORTED_ENCRYPTED_AGGREGATION", "window_order": "UNSUPPORTED_ENCRYPTED_WINDOW", "group_expression": "UNSUPPORTED_ENCRYPTED_GROUP_BY", "order_expression": "UNSUPPORTED_ENCRYPTED_ORDER_BY",
    "no_hash": "MISSING_ASSISTED_QUERY_COLUMN", "no_like": "MISSING_LIKE_QUERY_COLUMN", "operand": "INVALID_ENCRYPTED_QUERY_OPERAND", "star_join": "UNSUPPORTED_ENCRYPTED_SELECT",
    "in_star": "UNSUPPORTED_ENCRYPTED_IN_QUERY", "in_separate": "UNSUPPORTED_ENCRYPTED_IN_QUERY", "ambiguous": "AMBIGUOUS_ENCRYPTED_REFERENCE", "function": "UNSUPPORTED_ENCRYPTED_OPERATION",
    "recursive": "UNSUPPORTED_ENCRYPTED_SELECT", "two_ranges": "UNSUPPORTED_ENCRYPTED_RANGE", "insert_select": "UNSUPPORTED_ENCRYPTED_INSERT", "write_operand": "INVALID_ENCRYPTED_WRITE_OPERAND",
    "find_in_set_reversed": "INVALID_ENCRYPTED_QUERY_OPERAND", "json_like": "UNSUPPORTED_ENCRYPTED_OPERATION", "json_projected": "UNSUPPORTED_ENCRYPTED_OPERATION", "json_grouped": "UNSUPPORTED_ENCRYPTED_GROUP_BY",
    "json_in_query": "UNSUPPORTED_ENCRYPTED_IN_QUERY", "json_range": "UNSUPPORTED_ENCRYPTED_RANGE", "json_mutation": "INVALID_ENCRYPTED_WRITE_OPERAND", "pivot": "UNSUPPORTED_ENCRYPTED_SELECT",
    "rollup_expression": "UNSUPPORTED_ENCRYPTED_GROUP_BY", "lateral_protected": "UNSUPPORTED_ENCRYPTED_OPERATION", "natural_join": "UNSUPPORTED_ENCRYPTED_OPERATION", "using_join": "UNSUPPORTED_ENCRYPTED_OPERATION",
}


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows protected as they stream in, then read back through the engine."""
    from veilframe.streaming.ingest import protect_stream

    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    e = Engine(spark, rules(), Algorithms.standard({"aes": "catalogue-aes-key"}), store=SnapshotStore(spark, f"{folder}/tables"))
    logical(spark, sf_dir, USERS, "customer").write.parquet(f"{folder}/in")
    schema = spark.read.parquet(f"{folder}/in").schema
    protect_stream(e, spark.readStream.schema(schema).parquet(f"{folder}/in"), "user_account", f"{folder}/checkpoint").awaitTermination()
    return e.sql("select id, phone, id_card from user_account where phone is not null")


# --- the registry

FLAGSHIP = """select u.phone, u.id_card, count(*) as n from order_account o join user_account u on o.user_id = u.id
 where u.phone in ('13800000001', '13800000002', '13800000003') or u.id_card like '%0000000001%' group by u.phone, u.id_card"""

SPECIAL: dict[str, tuple[Query, str | None]] = {
    "mask_functions": (masks_query, MASKS_SQL),
    "insert_shadow": (shadow_columns, SHADOW_SQL),
    "separate_dedupe_insert": (separate_dedupe, DEDUPE_SQL),
    "national_algorithms": (national_round_trip, f"select id, phone, id_card, email from {U} u where phone in ('13800000003', '13800000004') or id_card like '%0000001%'"),
    "stored_mask_join": (masked_output, MASKED_SQL),
    "update_protected": (updated, UPDATED_SQL),
    "delete_protected": (deleted, f"select id, phone from {U} u where not coalesce(phone like '%0001%' or id_card = '110101000000000010', false)"),
    "insert_values": (inserted, INSERTED_SQL),
    "json_protect": (json_protected, JSON_SQL),
    "lookup_meta": (lookup_meta, META_SQL),
    "lookup_plaintext": (lookup_plaintext, LOOKUP_SQL),
    "relation_api": (relation_api, RELATION_SQL),
    "text_scrub_documents": (text_scrub_documents, None),
    "text_scrub_conversations": (text_scrub_conversations, None),
    "safe_log_map": (safe_log_map, SAFE_SQL),
    "migrate_values": (migrate_values, f"select id, phone, id_card, email, id_card as id_card_backup from {U} u"),
    "migrate_report": (migrate_report, "select count(*)::bigint as total, count(*)::bigint as scanned, count(*)::bigint as migrated, 0::bigint as skipped, count(*)::bigint as verified, min(c_custkey)::varchar as range_start, max(c_custkey)::varchar as range_end, 'COMPLETED' as status from customer"),
    "migrate_resume": (migrate_resume, "select (count(*) // 3 + 1)::bigint as scanned, (count(*) // 3 + 1)::bigint as migrated, 'RUNNING' as status from customer union all select count(*)::bigint, count(*)::bigint, 'COMPLETED' from customer"),
    "ddl_generate": (ddl_statements, None),
    "reject_matrix": (reject_matrix, "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in REFUSAL_CODES.items()) + ") t(name, code)"),
    "stream_protect": (streamed, f"select id, phone, id_card from {U} u where phone is not null"),
    "flagship": (lambda spark, sf_dir: flagship(spark, sf_dir), plaintext(FLAGSHIP)),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, tables=("user_account", "order_account")).sql(FLAGSHIP)


def special() -> dict[str, tuple[Query, str | None]]:
    from veilframe.plans.cases import CASES

    return SPECIAL | CASES


def queries() -> dict[str, Query]:
    return {name: statement(name) for name in STATEMENTS} | {name: q for name, (q, _) in special().items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (sql, args, other) in STATEMENTS.items():
        out[name] = plaintext(other or bound(sql, args))
    return out | {name: sql for name, (_, sql) in special().items() if sql}
