"""Golden vectors of the value functions."""

import hashlib
import logging

import pytest
from pyspark.sql import functions as F

from veilframe.errors import ConfigurationError, ErrorCode
from veilframe.functions import jsonpaths, masks, sm4, textmask
from veilframe.functions.algorithms import Algorithms
from veilframe.rules import JsonPathRule, JsonRule
from veilframe.sources.shared import shared_folder


def apply(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("f", "pairs"),
    [
        (masks.keep_first_last(3, 4), {"13800138000": "138****8000", "%13800138000%": "%138****8000%", "abc": "abc", "": "", None: None}),
        (masks.keep_from_to(3, 6), {"13800138000": "***0013****", "abc12": "***12"}),
        (masks.mask_first_last(3, 4), {"13800138000": "***0013****", "abc": "***"}),
        (masks.mask_from_to(3, 6), {"13800138000": "138****8000", "abc12": "abc**"}),
        (masks.keep_first_last(3, 4, "#"), {"13800138000": "138####8000"}),
        (masks.keep_first_last(3, 3), {"110101199001011234": "110************234", "abc123": "abc123"}),
        (masks.keep_first_last(0, 4), {"13800138000": "*******8000", "01012345678_": "*******5678_", "1234": "1234", "6222021234567890123": "*" * 15 + "0123"}),
        (masks.name_mask, {"张三": "张*", "王小明": "王*明", "欧阳娜娜": "欧**娜", "%李三%": "%李*%", "北京市字节跳动有限公司": "北京市字节****公司", "杭州未来科技公司": "杭州未来**公司"}),
        (masks.normalized_like, {" \tAbC\n ": "abc", "x y": "x y", None: None}),
        (lambda c: masks.type_mask(c, "EMAIL"), {"alice@example.com": "a****@example.com", "x": "*", "  ": "  "}),
        (lambda c: masks.type_mask(c, "ID_CARD"), {"110101199001011234": "110************234", "123456": "******"}),
        (lambda c: masks.type_mask(c, "BANK_CARD"), {"6222021234567890": "622202******7890"}),
        (lambda c: masks.type_mask(c, "ALL"), {"secret": "******"}),
    ],
)
def test_masks(spark, f, pairs):
    assert apply(spark, f, list(pairs)) == list(pairs.values())


def test_driver_forms_agree(spark):
    values = ["13800138000", "%138_0%", "王小明", "北京市字节跳动有限公司", "", "a", "  Mixed Case ", "杭州未来科技公司", "ab%cdefgh"]
    a = Algorithms.standard()
    for name, t in a.likes.items():
        assert apply(spark, t.column, values) == [t.value(v) for v in values], name


@pytest.mark.parametrize("args", [(5, 3), (-1, 3)])
def test_mask_arguments(args):
    with pytest.raises(ConfigurationError) as e:
        masks.mask_from_to(*args)
    assert e.value.code is ErrorCode.INVALID_FIELD_RULE
    with pytest.raises(ConfigurationError):
        masks.keep_first_last(-1, 1)


def test_mask_types():
    assert [masks.mask_type_of(n) for n in ("userPhone", "idCard", "bankNo", "eMail", "realName", "x")] == ["PHONE", "ID_CARD", "BANK_CARD", "EMAIL", "NAME", "DEFAULT"]
    assert masks.parse_options("type=PHONE, keepLast=4") == {"type": "PHONE", "keepLast": "4"}
    with pytest.raises(ConfigurationError):
        masks.parse_options("a=1,a=2")


def test_hashes(spark):
    a = Algorithms.standard()
    assert a.hash_value("sm3", "abc") == "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"
    for name in ("sm3", "sha256"):
        assert apply(spark, a.hash(name).column, ["abc", "", "é", None]) == [a.hash_value(name, v) for v in ("abc", "", "é", None)]
    assert Algorithms.standard(sm3_salt="00ff").hash_value("sm3", "x") == hashlib.new("sm3", b"\x00\xffx").hexdigest()


@pytest.mark.parametrize("name", ["aes", "sm4"])
def test_ciphers(spark, name):
    c = Algorithms.standard({"aes": "k", "sm4": "k"}).cipher(name)
    values = ["13800138000", "", "é漢字 " * 50, None, "x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    shared_folder(spark)
    sealed = df.withColumn("c", c.encrypt(F.col("v"))).checkpoint()
    assert [r.v for r in sealed.orderBy("i").select(c.decrypt(F.col("c")).alias("v")).collect()] == values
    texts = [r.c for r in sealed.collect() if r.c]
    assert len(set(texts)) == 4
    bad = spark.createDataFrame([("nonsense",), (texts[0][:-4] + "AAAA",), ("",), (None,)], "c string")
    assert [r[0] for r in bad.select(c.try_decrypt(F.col("c"))).collect()] == [None] * 4
    with pytest.raises(Exception, match=r"CIPHER|AES|decrypt"):
        bad.where("c is not null and c <> ''").select(c.decrypt(F.col("c"))).collect()


def test_sm4_vectors():
    import numpy as np

    key = bytes.fromhex("0123456789abcdeffedcba9876543210")
    block = np.frombuffer(key, ">u4").reshape(1, 4)
    assert sm4.encrypt_blocks(sm4.round_keys(key), block).astype(">u4").tobytes().hex() == "681edf34d206965e86b3e94f536e4246"
    plain = bytes.fromhex("aaaaaaaaaaaaaaaabbbbbbbbbbbbbbbbccccccccccccccccddddddddddddddddeeeeeeeeeeeeeeeeffffffffffffffffeeeeeeeeeeeeeeeeaaaaaaaaaaaaaaaa")
    aad = bytes.fromhex("feedfacedeadbeeffeedfacedeadbeefabaddad2")
    sealed = sm4.Gcm(key).seal([bytes.fromhex("00001234567800000000abcd")], [plain], aad)[0]
    assert sealed[-16:].hex() == "83de3541e4c2b58177e065a9bf7b62ec" and sealed[12:28].hex() == "17f399f08c67d5ee19d0dc9969c4bb7d"
    assert sm4.Gcm(key).open([sealed, sealed[:-1] + b"\0", b""], aad) == [plain, None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("password=P@ssw0rd!", "password=*********"), ("phone=13800138000", "phone=*******8000"), ("mail alice@example.com now", "mail a****@example.com now"),
        ("id 110101199003071234.", "id 110************234."), ("card 6222020202020202", "card ************0202"), ('{"authorization":"Bearer abc.def"}', '{"authorization":"' + "*" * 14 + '"}'),
        ("status=SUCCESS", "status=SUCCESS"), ("", ""), (None, None),
    ],
)
def test_scrub(text, want):
    assert textmask.scrub(text) == want


def test_scrub_columns(spark):
    values = ["password=abc", "nothing here", None, "tel 13800138000", "Token: x1"]
    assert apply(spark, textmask.scrub_column, values) == [textmask.scrub(v) for v in values]
    df = spark.createDataFrame([({"token": "abc", "status": "OK"}, ("13800138000", [1]), ["a@b.c"])], "m map<string,string>, s struct<phone:string,n:array<int>>, email array<string>")
    row = textmask.safe_frame(df).first()
    assert row.m == {"token": "***", "status": "OK"} and row.s.phone == "*******8000" and row.s.n == [1] and row.email == ["*@b.c"]
    assert textmask.key_value("pwd", "abc") == "pwd=***" and textmask.mask_value("110101199003071", None) == "*" * 11 + "3071"


def test_safe_logs_at_any_depth(spark):
    schema = "l array<struct<password:string,ok:string>>, m map<string,struct<token:string>>, a array<array<string>>, s struct<p:array<map<string,string>>>, holder string, n int"
    df = spark.createDataFrame([([("abc", "fine")], {"k": ("xyz",)}, [["13800138000"]], ([{"pwd": "q", "x": "y"}],), "Somebody", 3), (None, None, None, None, None, None)], schema)
    row, empty = textmask.safe_frame(df, annotated=("holder",)).collect()
    assert row.l[0][:] == ("***", "fine") and row.m["k"].token == "***" and row.a == [["*******8000"]] and row.s.p == [{"pwd": "*", "x": "y"}]
    assert row.holder == "********" and row.n == 3 and all(x is None for x in empty)
    assert textmask.safe_frame(df).schema == df.schema


def test_log_values_and_install():
    record = logging.makeLogRecord({"msg": "x", "phone": "13800138000", "deep": {"token": "abc"}, "n": 3})
    assert textmask.LogFilter().filter(record) and record.phone == "*******8000" and record.deep == {"token": "***"} and record.n == 3
    logger = logging.Logger("own")
    logger.addHandler(logging.NullHandler())
    assert (textmask.install(logger), textmask.install(logger)) == (1, 0)


def test_log_filter():
    record = logging.LogRecord("x", logging.INFO, "f", 1, "user %s phone=%s", ("a", "13800138000"), None)
    assert textmask.LogFilter().filter(record) and record.getMessage() == "user a phone=*******8000"
    try:
        try:
            raise ValueError("token=abc")
        except ValueError as e:
            raise RuntimeError("phone=13800138000") from e
    except RuntimeError as e:
        assert textmask.safe_error(e) == "RuntimeError: phone=*******8000\nValueError: token=***"


def test_json_paths():
    rule = JsonRule("t", "j", (JsonPathRule("$.a"), JsonPathRule("$.b[1].c"), JsonPathRule("$.n"), JsonPathRule("$.x.y")), "s", "id", "h", "c")
    upper = {p.path: str.upper for p in rule.paths}
    text = '{"a":"x","b":[1,{"c":true}],"n":1.50e2,"z":1.10}'
    out, writes = jsonpaths.take_out(text, upper)
    assert out == '{"a":"X","b":[1,{"c":"TRUE"}],"n":"150","z":1.10}' and [(p, v) for p, _, v in writes] == [("$.a", "x"), ("$.b[1].c", "true"), ("$.n", "150")]
    assert jsonpaths.put_back(out, list(upper), {"X": "x", "TRUE": "true"}) == '{"a":"x","b":[1,{"c":"true"}],"n":"150","z":1.10}'
    assert jsonpaths.take_out(out, upper, frozenset({"X", "TRUE", "150"}))[1] == []
    assert jsonpaths.take_out('{"a":"  "}', upper) == ('{"a":"  "}', []) and jsonpaths.take_out(" ", upper) == (" ", [])
    with pytest.raises(Exception, match="INVALID_ENCRYPTED_WRITE_OPERAND"):
        jsonpaths.take_out('{"a":{}}', upper)
