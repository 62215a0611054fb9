"""Statements against the same over plaintext, what is refused, writes, lookups, masks."""

import pytest
from pyspark.sql import functions as F

from tests.compare import compare
from veilframe.engine import Engine
from veilframe.errors import VeilError
from veilframe.functions.algorithms import Algorithms
from veilframe.operators import masking
from veilframe.operators.reveal import decrypt_nested
from veilframe.plans import catalogue
from veilframe.rules import Rules
from veilframe.sources.store import SnapshotStore


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_plaintext(spark, small_dir, name):
    assert compare(spark, name, catalogue.queries()[name], catalogue.oracle_sql()[name], small_dir) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, small_dir, name):
    assert catalogue.queries()[name](spark, small_dir).count() > 0


def keys():
    return Algorithms.standard({"aes": "a key for tests", "sm4": "another one"})


@pytest.fixture(scope="module")
def rules():
    own = {"cipher": "aes", "hash": "sha256"}
    return Rules.load([{"table": "u", "fields": [own | {"property": "phone", "storage_column": "phone_c", "hash_column": "phone_h", "like_column": "phone_l"}, own | {"property": "mail"}]}, {"table": "v", "fields": [own | {"property": "phone", "hash_column": "phone_h", "hash": "sm3"}]}])


@pytest.fixture
def engine(spark, rules):
    e = Engine(spark, rules, keys())
    e.insert("u", spark.createDataFrame([(1, "13800000001", "a@b.c", "x"), (2, "13800000002", None, "y"), (3, "", "m", "z"), (4, None, " ", "w"), (5, "50%_x", "q", "13800000001")], "id int, phone string, mail string, note string"))
    e.insert("v", spark.createDataFrame([(1, "13800000001")], "id int, phone string"))
    return e


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_values_and_blanks(engine):
    assert rows(engine.sql("select id, phone from u where phone = ''")) == [(3, "")]
    assert rows(engine.sql("select id from u where phone != ''")) == [(1,), (2,), (5,)]
    assert rows(engine.sql("select id, mail from u where id > 2")) == [(3, "m"), (4, " "), (5, "q")]
    assert rows(engine.sql("select id, phone from u where phone like ?", ["50\\%\\_x"])) == [(5, "50%_x")]
    assert rows(engine.sql("select id from u where phone = :p or note = :p", {"p": "13800000001"})) == [(1,), (5,)]
    assert rows(engine.sql("select id from u where phone = null")) == [] and rows(engine.sql("select id from u where phone in (null, '13800000002')")) == [(2,)]


def test_storage_is_the_logical_column(engine):
    assert "mail" in engine.read("u").columns and rows(engine.raw("select id from u where mail = 'q'")) == []
    for sql in ("select id from u where mail = 'q'", "select id from u where mail like '%q'", "select count(mail) as n from u"):
        with pytest.raises(VeilError) as e:
            engine.sql(sql)
        assert e.value.code.name == "MISSING_ASSISTED_QUERY_COLUMN"


def test_different_hashes_do_not_compare(engine):
    with pytest.raises(VeilError) as e:
        engine.sql("select u.id from u join v on u.phone = v.phone")
    assert e.value.code.name == "UNSUPPORTED_ENCRYPTED_OPERATION"


def test_shadow_columns_by_name_stay_as_stored(engine):
    got = engine.sql("select phone_h from u where id = 1").first()[0]
    assert len(got) == 64
    assert "phone_h" not in engine.sql("select * from u").columns


def test_warnings_and_skip(engine):
    assert engine.query("select id from u order by phone").warnings and not engine.query("select id from u order by id").warnings
    assert engine.raw("select phone_c from u where id = 1").first()[0] != "13800000001"


def test_hint(engine):
    stored = engine.raw("select mail as m from u where id = 1").first()["m"]
    engine.store.replace("copy", engine.spark.createDataFrame([(stored,)], "m string"))
    assert engine.sql("select m from copy", hint={"m": "u.mail"}).first()[0] == "a@b.c"


def test_same_name_in_another_table(engine, spark):
    engine.store.replace("w", spark.createDataFrame([("13800000001",)], "phone string"))
    assert rows(engine.sql("select w.phone from w where w.phone = '13800000001'")) == [("13800000001",)]
    assert rows(engine.sql("select u.id, w.phone from w join u on u.id = 1 where w.phone = '13800000001'")) == [(1, "13800000001")]


def test_update_and_delete_match_three_valued_logic(engine):
    engine.sql("update u set note = 'hit', phone = ? where phone <> '13800000001'", ["7"])
    assert rows(engine.sql("select id, phone, note from u where note = 'hit'")) == [(2, "7", "hit"), (3, "7", "hit"), (5, "7", "hit")]
    engine.sql("delete from u where phone <> '13800000001'")
    assert rows(engine.sql("select id from u")) == [(1,), (4,)]
    engine.sql("update u set phone = null where id = 1")
    assert rows(engine.sql("select id from u where phone is null")) == [(1,), (4,)]


def test_insert_select_on_request(spark, rules):
    e = Engine(spark, rules, keys(), insert_select=True)
    e.insert("u", spark.createDataFrame([(1, "13800000001", "m", "x")], "id int, phone string, mail string, note string"))
    e.sql("insert into u (id, phone) select id + 1, phone from u")
    assert rows(e.sql("select id, phone from u")) == [(1, "13800000001"), (2, "13800000001")]


def test_preprocessors(spark, rules):
    e = Engine(spark, rules, keys(), preprocessors=[lambda t, df: df.withColumn("phone", F.trim("phone")) if "phone" in df.columns else df])
    e.insert("u", spark.createDataFrame([(1, " 5 ", None, None)], "id int, phone string, mail string, note string"))
    assert rows(e.sql("select id from u where phone = '5'")) == [(1,)]


def test_snapshots(spark, rules, tmp_path):
    e = Engine(spark, rules, keys(), store=SnapshotStore(spark, str(tmp_path)))
    e.insert("u", spark.createDataFrame([(1, "a", "m", "x"), (2, "b", "n", "y")], "id int, phone string, mail string, note string"))
    e.sql("insert into u (id, phone) values (3, 'c')")
    e.sql("delete from u where phone = 'a'")
    again = Engine(spark, rules, keys(), store=SnapshotStore(spark, str(tmp_path)))
    assert rows(again.sql("select id, phone from u")) == [(2, "b"), (3, "c")] and again.store.names() == ["u"]


def test_lookup_and_audit(spark, small_dir):
    seen = []
    e = catalogue.engine(spark, small_dir, tables=("user_account",), audit=seen.append)
    meta = e.lookup_meta("user_account").where("id = 3").first()
    assert e.lookup(meta.phone.asDict()) == "13800000003" and e.lookup(meta.idCard.asDict()) == "110101000000000003"
    for bad, code in (({"sid": "x", "pid": "y", "vid": "1", "hash": "z"}, "INVALID_FIELD_RULE"), (meta.phone.asDict() | {"vid": "999999"}, "GENERAL_FAILURE"), ({"sid": ""}, "GENERAL_FAILURE")):
        with pytest.raises(VeilError) as err:
            e.lookup(bad)
        assert err.value.code.name == code
    assert [x["success"] for x in seen] == [True, True, False, False, False]


def test_masking_strategies(spark, small_dir):
    e = catalogue.engine(spark, small_dir, tables=("user_account",))
    sql = "select name, phone from user_account where id = 3"
    fields = {"name": masking.Sensitive("NAME")}
    name = e.sql(sql).first()["name"]
    assert e.sql(sql, mask=masking.RECORDED_ONLY, fields=fields).first()[:] == (name, "*******0003")
    assert e.sql(sql, mask=masking.ANNOTATED_FIELDS, fields=fields).first()["phone"] == "13800000003"
    e.maskers["fixed"] = lambda c: F.lit("M")
    assert e.sql(sql, mask=masking.ANNOTATED_FIELDS, fields={"name": masking.Sensitive(masker="fixed")}).first()["name"] == "M"
    with pytest.raises(VeilError):
        e.sql(sql, mask=masking.ANNOTATED_FIELDS, fields={"name": masking.Sensitive(masker="none")})


def test_nested_fields(spark, rules):
    a = keys()
    rule = rules.find("u", "phone")
    df = spark.createDataFrame([("13800000001",), (None,)], "p string").select(F.struct(F.array(F.struct(a.cipher("aes").encrypt(F.col("p")).alias("phone"))).alias("people")).alias("o"))
    assert [r[0] for r in decrypt_nested(df, "o.people.phone", rule, a).select("o.people.phone").collect()] == [["13800000001"], [None]]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("s", T.ArrayType(T.StructType([T.StructField("mail", T.StringType(), True, {"sensitive": {"type": "EMAIL"}}), T.StructField("x", T.StringType())])))])
    assert masking.mask_nested(spark.createDataFrame([([("ab@c.d", "k")],)], schema), a).first().s[0][:] == ("a*@c.d", "k")


def test_relations(spark, small_dir):
    e = catalogue.engine(spark, small_dir, tables=("user_account", "user_archive"))
    a, b = (e.table(t).select("phone").where("phone like ?", "%00%") for t in ("user_account", "user_archive"))
    plain = lambda r: {x[0] for x in r.reveal().collect()}
    assert plain(a.intersect(b)) == plain(a) & plain(b) and plain(b.except_(a)) == plain(b) - plain(a) and plain(a.union(b)) == plain(a) | plain(b)
    assert a.union_all(b).reveal().count() == a.reveal().count() + b.reveal().count()
    assert [r.id for r in e.table("user_account").select("id", "phone").order_by("id desc").limit(2).reveal().collect()] == sorted((r.id for r in e.table("user_account").select("id").reveal().collect()), reverse=True)[:2]


def test_filters_reach_the_scan(spark, rules, tmp_path):
    e = Engine(spark, rules, keys(), store=SnapshotStore(spark, str(tmp_path)))
    e.insert("u", spark.createDataFrame([(1, "a", "m", "x")], "id int, phone string, mail string, note string"))
    plan = e.query("select id from u where phone = 'a'").physical._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(phone_h" in plan and "ReadSchema: struct<id:int,phone_h:string>" in plan


def test_log_line(engine):
    line = engine.query("select id from u where phone = ? and note = ?", ["13800000001", "secret"]).log_line
    assert "13800000001" not in line and "secret" not in line and "=***" in line and engine.algorithms.hash_value("sha256", "13800000001") in line


def test_payloads(spark, small_dir):
    import json

    from veilframe.operators.payload import resolve_payloads

    e = catalogue.engine(spark, small_dir, tables=("user_account",))
    m = e.lookup_meta("user_account").where("id = 3").first()
    phone, card = m.phone.asDict(), m.idCard.asDict()
    payloads = [
        {"a": 1, "phone": "138****", "sensitiveSubmitMeta": {"phone": phone}},
        {"idCard": {"state": "masked", "value": "x", "lookupMeta": card}, "phone": {"state": "changed", "value": "139"}},
        {"phone": "kept", "sensitiveSubmitMeta": {"phone": phone | {"hash": "0"}}},
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(payloads)] + [(3, None), (4, "no json"), (5, "[1]")], "i int, payload string")
    got = {r.i: r.payload for r in resolve_payloads(e, df).collect()}
    assert json.loads(got[0]) == {"a": 1, "phone": "13800000003"} and json.loads(got[1]) == {"idCard": "110101000000000003", "phone": "139"}
    assert json.loads(got[2]) == {"phone": "kept"} and (got[3], got[4], got[5]) == (None, "no json", "[1]")


def test_stream_replays_append_once(spark, rules, tmp_path):
    """A micro-batch whose commit is lost is run again by the next start: its rows are there once."""
    import shutil

    from veilframe.streaming.ingest import protect_stream

    schema = "id int, phone string, mail string, note string"
    spark.createDataFrame([(i, f"138{i:08d}", "m", "x") for i in range(40)], schema).write.parquet(f"{tmp_path}/in")
    e = Engine(spark, rules, keys(), store=SnapshotStore(spark, f"{tmp_path}/tables"))
    run = lambda: protect_stream(e, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "u", f"{tmp_path}/check").awaitTermination()
    run()
    shutil.rmtree(tmp_path / "check" / "commits")
    run()
    assert e.read("u").count() == 40
    spark.createDataFrame([(99, "1", "m", "x")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    assert e.read("u").count() == 41


def test_readers_see_whole_appends(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    store.append("t", spark.range(3))
    before = store.read("t")
    store.append("t", spark.range(4), token="x")
    store.append("t", spark.range(4), token="x")
    assert before.count() == 3 and store.read("t").count() == 7
    store.replace("t", store.read("t").limit(1))
    assert store.read("t").count() == 1


def test_several_rows_for_a_handle(engine, spark):
    meta = engine.lookup_meta("u").where("id = 1").select("phone.*").where("sid is not null")
    assert [r.plain for r in engine.resolve(meta).collect()] == ["13800000001"]
    engine.insert("u", spark.createDataFrame([(1, "13800000001", "a@b.c", "x")], "id int, phone string, mail string, note string"))
    with pytest.raises(Exception, match="2 rows for a handle"):
        engine.resolve(meta).collect()
    bare = Engine(spark, Rules.load([]), keys())
    assert [r.plain for r in bare.resolve(meta).collect()] == [None]


def test_sources(spark, rules):
    from veilframe.sources.routing import Sources

    a, b = Engine(spark, rules, keys()), Engine(spark, rules, keys())
    both = Sources({"a": a, "b_1": b}, {"b_*": "DM"})
    row = lambda i: spark.createDataFrame([(i, "13800000001", "m", "x")], "id int, phone string, mail string, note string")
    both.insert("u", row(1))
    meta = a.lookup_meta("u").first().phone.asDict()
    assert both.lookup(meta) == "13800000001"
    with both.use("b_1"):
        both.insert("u", row(2))
        assert both.current == "b_1" and both.dialect() == "DM" and rows(both.sql("select id, phone from u")) == [(2, "13800000001")]
    assert both.dialect() == "MYSQL" and rows(both.sql("select id from u")) == [(1,)]
    with pytest.raises(VeilError):
        both.lookup(meta)  # both have the table
    with pytest.raises(VeilError):
        both.engine("c")


def test_stored_tables_are_read_by_hash(spark, small_dir):
    e = catalogue.engine(spark, small_dir, tables=("user_account",))
    frame = e.query("select id, phone, name from user_account where phone = ?", ["13800000042"])
    plan = frame.physical._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(phone_hash" in plan and "sha2" not in plan and "email_cipher" not in plan


def test_trace_context(spark):
    from veilframe.functions.trace import TraceContext, carried

    with TraceContext(traceId="t1", userId="u", clientIp="1.2.3.4") as context:
        assert TraceContext.current()["traceId"] == "t1"
        run = carried(lambda: dict(TraceContext.current()))
        context.tag(spark)
        assert spark.sparkContext.getLocalProperty("veil.traceId") == "t1"
    assert TraceContext.current() == {} and run()["userId"] == "u"
    with pytest.raises(VeilError):
        TraceContext(other="x")


def test_form_payloads():
    from veilframe.operators.payload import handles, read_form, rebuilt, rebuilt_form

    meta = "&".join(f"sensitiveSubmitMeta%5Bphone%5D%5B{p}%5D={v}" for p, v in (("sid", "s"), ("pid", "p"), ("vid", "1"), ("hash", "h")))
    key = "\0".join("sp1h")
    assert handles(read_form(f"x=1&{meta}")[1]) == {"phone": tuple("sp1h")}
    assert rebuilt_form(f"x=1&x=2&{meta}", {key: "138 1"}) == "x=1&x=2&phone=138+1" and rebuilt_form(f"phone=y&{meta}", {}) == "phone=y"
    assert rebuilt_form("m[state]=masked&m[value]=v", {}) == "m%5Bstate%5D=masked&m%5Bvalue%5D=v" and rebuilt_form("m[state]=changed&m[value]=v&n=", {}) == "m=v&n="
    assert rebuilt_form(None, {}) is None and rebuilt_form("", {}) == "" and read_form("a[b]=1")[1] == {}
    assert rebuilt('{"sensitiveSubmitMeta":{"phone":{"sid":"s","pid":"p","vid":"1","hash":"h"}}}', {key: "138"}) == '{"phone":"138"}'
