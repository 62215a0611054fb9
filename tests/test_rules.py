import dataclasses

import pytest

from veilframe import names
from veilframe.errors import ConfigurationError
from veilframe.rules import ColumnRule, JsonPathRule, JsonRule, Rules


def test_defaults():
    r = ColumnRule("user_account", "idCard")
    assert (r.column, r.storage_column, r.cipher, r.hash, r.like) == ("id_card", "id_card", "sm4", "sm3", "normalizedLike")
    assert r.sid.startswith("sid_") and r.pid.startswith("pid_") and r.pid != r.sid


@pytest.mark.parametrize(
    ("rule", "code"),
    [
        (ColumnRule("", "x"), "INVALID_TABLE_RULE"),
        (ColumnRule("t", "x", mode="SEPARATE_TABLE", hash_column="h"), "MISSING_STORAGE_TABLE"),
        (ColumnRule("t", "x", mode="SEPARATE_TABLE", storage_table="s"), "MISSING_ASSISTED_QUERY_COLUMN"),
        (ColumnRule("t", "x", like_column="l", masked_column="L", masked="phoneMaskLike"), "SHARED_DERIVED_COLUMN_ALGORITHM_MISMATCH"),
        (JsonRule("t", "j", ()), "INVALID_FIELD_RULE"),
        (JsonRule("t", "j", (JsonPathRule("$..a"),), "s", "id", "h", "c"), "INVALID_FIELD_RULE"),
    ],
)
def test_validation(rule, code):
    with pytest.raises(ConfigurationError) as e:
        Rules().add(rule)
    assert e.value.code.name == code


def test_load_and_find():
    rules = Rules.load([{"table": "`User_Account`", "fields": [{"property": "phoneNumber"}, {"property": "code", "table": "other"}]}])
    assert rules.find("user_account", "PHONE_NUMBER") is rules.find('"user_account"', "phoneNumber") is not None
    assert rules.find("other", "code") and rules.tables() == ["other", "user_account"]
    r = rules.find("other", "code")
    assert rules.by_codes(r.sid, r.pid) is r and rules.by_codes("x", "y") is None
    with pytest.raises(ConfigurationError):
        Rules.load([{"table": "t", "fields": [{"property": "a", "nonsense": 1}]}])


def test_annotated_classes():
    @dataclasses.dataclass
    class Base:
        phone: str = dataclasses.field(default="", metadata={"protected": {"hash_column": "phone_hash"}})

    @dataclasses.dataclass
    class UserAccount(Base):
        idCard: str = dataclasses.field(default="", metadata={"protected": {"cipher": "aes"}})

    rules = Rules.annotated(UserAccount)
    assert rules.find("user_account", "id_card").cipher == "aes" and rules.find("user_account", "phone").hash_column == "phone_hash"


def test_names():
    assert names.snake("idCardNo") == "id_card_no" and names.camel("id_card_no") == "idCardNo"
    assert names.quote("a`b") == "`a``b`" and names.quote('a"b', "DM") == '"a""b"' and names.quote("`a`") == "`a`" and names.alias_token("a b.c") == "a_b_c"
    assert names.normal("`Db`.[T]") == "t"
