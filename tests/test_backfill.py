"""Backfill: values, backups, resuming, refusals, and the statements for tables."""

import json

import pytest

from veilframe.engine import Engine
from veilframe.errors import VeilError
from veilframe.functions.algorithms import Algorithms
from veilframe.names import normal
from veilframe.operators import backfill, ddl
from veilframe.plans import catalogue
from veilframe.rules import Rules

SCHEMA = "id long, phone string, id_card string, email string"
ROWS = [(i, f"138{i:08d}" if i % 5 else None, f"1101{i % 4:08d}" if i % 7 else " ", f"u{i}@x.y") for i in range(1, 21)]


def code(f):
    with pytest.raises(VeilError) as e:
        f()
    return e.value.code.name


@pytest.fixture
def engine(spark):
    return Engine(spark, catalogue.rules(), Algorithms.standard({"aes": "a key for tests", "sm4": "another one"}), tables={"user_account": spark.createDataFrame(ROWS, SCHEMA)})


def define(**options):
    return backfill.Definition("user_account", ("id",), **options)


def test_run_twice(engine):
    state = backfill.MemoryState()
    report = backfill.Task(engine, define(batch=7, backup={"id_card": "card_backup"}), state).run()
    assert (report.total, report.scanned, report.verified, report.status, report.range_start, report.range_end) == (20, 20, 20, "COMPLETED", "1", "20")
    assert sorted(tuple(r) for r in engine.sql("select id, phone, id_card, email from user_account").collect()) == ROWS
    assert engine.read("card_store").count() == 4
    ids = {r.id: r for r in engine.read("user_account").collect()}
    assert ids[1].card_backup == ROWS[0][2] and len(ids[1].id_card) == 64 and ids[7].id_card == " "
    assert backfill.Task(engine, define(batch=7, backup={"id_card": "card_backup"}), state).run() == report
    again = backfill.Task(engine, define(backup={"id_card": "card_backup"}), backfill.MemoryState()).run()
    assert (again.migrated, again.skipped) == (0, 20) and engine.read("card_store").count() == 4


def test_resume_and_incompatible(engine):
    state = backfill.MemoryState()
    first = backfill.Task(engine, define(batch=8), state).run(most_slices=1)
    assert (first.status, first.scanned) == ("RUNNING", 8) and "phone_cipher" not in engine.read("user_account").columns
    assert code(lambda: backfill.Task(engine, define(batch=8, include=("phone",)), state).run()) == "STATE_INCOMPATIBLE"
    assert backfill.Task(engine, define(batch=8), state).run().scanned == 20


def test_slices_share_jobs(engine):
    """Twenty rows in slices of three, four of them to a job: the table is staged in two jobs, and counts are those of rows."""
    state = backfill.MemoryState()
    report = backfill.Task(engine, define(batch=3, together=4), state).run()
    assert (report.scanned, report.verified, state.load("user_account")["jobs"]) == (20, 20, 2)
    assert sorted(tuple(r) for r in engine.sql("select id, phone, id_card, email from user_account").collect()) == ROWS


def test_equal_cursors_lie_in_one_slice(spark):
    rules = Rules.load([{"table": "t", "fields": [{"property": "phone", "cipher": "aes", "hash": "sha256", "storage_column": "phone_c", "hash_column": "phone_h"}]}])
    rows = [(i // 4, f"p{i}") for i in range(22)]
    e = Engine(spark, rules, Algorithms.standard({"aes": "a key for tests"}), tables={"t": spark.createDataFrame(rows, "no int, phone string")})
    assert backfill.Task(e, backfill.Definition("t", ("no",), batch=3)).run(most_slices=2).scanned == 8
    assert backfill.Task(e, backfill.Definition("t", ("no",), batch=3, together=2)).run().scanned == 22
    assert sorted(r.phone for r in e.sql("select phone from t").collect()) == sorted(p for _, p in rows)


def test_fingerprint_of_the_store(engine, tmp_path, spark):
    from veilframe.sources.store import SnapshotStore

    state = backfill.MemoryState()
    backfill.Task(engine, define(batch=8), state).run(most_slices=1)
    other = Engine(spark, engine.rules, engine.algorithms, store=SnapshotStore(spark, str(tmp_path)))
    other.store.replace("user_account", spark.createDataFrame(ROWS, SCHEMA))
    assert code(lambda: backfill.Task(other, define(batch=8), state).run()) == "STATE_INCOMPATIBLE"


def test_composite_cursor(spark):
    rows = [(t, i, f"{t}{i}") for t in "ab" for i in range(5)]
    rules = Rules.load([{"table": "t", "fields": [{"property": "phone", "cipher": "aes", "hash": "sha256", "storage_column": "phone_c", "hash_column": "phone_h"}]}])
    e = Engine(spark, rules, Algorithms.standard({"aes": "a key for tests"}), tables={"t": spark.createDataFrame(rows, "tenant string, no int, phone string")})
    report = backfill.Task(e, backfill.Definition("t", ("tenant", "no"), batch=3)).run()
    assert (report.scanned, report.range_end) == (10, "b,4")
    assert {r.phone for r in e.sql("select phone from t").collect()} == {r[2] for r in rows}


def test_refusals(engine, spark):
    assert code(lambda: backfill.plan(engine, backfill.Definition("user_account", ()))) == "DEFINITION_INVALID"
    assert code(lambda: backfill.plan(engine, backfill.Definition("nothing", ("id",)))) == "METADATA_RULE_MISSING"
    assert code(lambda: backfill.plan(engine, define(include=("nope",)))) == "FIELD_SELECTOR_UNRESOLVED"
    assert code(lambda: backfill.plan(engine, backfill.Definition("user_account", ("id_card",)))) == "CURSOR_COLUMN_MUTABLE"
    assert code(lambda: backfill.plan(engine, define(backup={"id_card": "phone_hash"}))) == "BACKUP_COLUMN_CONFLICT"
    assert code(lambda: backfill.plan(engine, define(excluded_tables=("USER_ACCOUNT",)))) == "TABLE_EXCLUDED"
    engine.store.replace("user_account", spark.createDataFrame([(None, "1", "2", "3")], SCHEMA))
    assert code(lambda: backfill.Task(engine, define()).run()) == "CURSOR_VALUE_MISSING"
    engine.store.replace("user_account", spark.createDataFrame([(1, "1", "ab" * 32, "3")], SCHEMA))
    assert code(lambda: backfill.Task(engine, define()).run()) == "PLAINTEXT_UNRECOVERABLE"
    engine.store.replace("user_account", spark.createDataFrame([(1, "1", "one", "3", "two")], SCHEMA + ", b string"))
    assert code(lambda: backfill.Task(engine, define(backup={"id_card": "b"})).run()) == "BACKUP_VALUE_INCONSISTENT"


def test_json(spark):
    e = Engine(spark, catalogue.rules(), Algorithms.standard({"aes": "a key for tests", "sm4": "another one"}), tables={"profile": spark.createDataFrame([(1, '{"phone":"13800000001","n":1}'), (2, None), (3, '{"n":2}')], "id long, profile_json string")})
    what = backfill.Definition("profile", ("id",))
    assert backfill.Task(e, what).run().migrated == 1
    assert backfill.Task(e, what).run().migrated == 0
    assert sorted(tuple(r) for r in e.sql("select id, profile_json from profile").collect())[0] == (1, '{"phone":"13800000001","n":1}')


def test_states_and_confirmation(engine, tmp_path):
    state = backfill.FileState(str(tmp_path / "state"))
    with state.lock("user_account"):
        assert code(lambda: backfill.Task(engine, define(), state).run()) == "CHECKPOINT_LOCKED"
    confirm = backfill.from_file(str(tmp_path))
    assert code(lambda: backfill.Task(engine, define(), state, confirm).run()) == "CONFIRMATION_REQUIRED"
    path = tmp_path / "user_account.confirm.json"
    own = json.loads(path.read_text())
    path.write_text(json.dumps(own | {"approved": True, "risks": own["risks"][1:]}))
    assert code(lambda: backfill.Task(engine, define(), state, confirm).run()) == "CONFIRMATION_SCOPE_MISMATCH"
    path.write_text(json.dumps(own | {"approved": True}))
    assert code(lambda: backfill.Task(engine, define(), state, backfill.expected({"*": {"x"}})).run()) == "CONFIRMATION_SCOPE_MISMATCH"
    assert backfill.Task(engine, define(), state, confirm).run().status == "COMPLETED" == backfill.FileState(str(tmp_path / "state")).load("user_account")["report"]["status"]
    (tmp_path / "state" / "user_account.json").write_text("{")
    assert code(lambda: state.load("user_account")) == "STATE_STORE_DATA_INVALID"
    assert "INSERT|card_store|id_card_cipher" in backfill.plan(engine, define()).risks()


def test_all_tables(engine, spark):
    engine.store.replace("user_archive", spark.createDataFrame([(1, "13800000001", "110100000001")], "id long, phone string, id_card string"))
    assert set(backfill.migrate_all(engine)) == {"user_account", "user_archive"}


def test_ddl():
    rules = catalogue.rules()
    columns = {"id": "bigint", "phone": "varchar(64)", "id_card": "varchar(80)", "email": "varchar(18)"}
    found = ddl.statements(rules, "user_account", columns, "MYSQL", backup={"id_card": "id_card_backup"})
    assert "alter table `user_account` add column `phone_cipher` varchar(380)" in found and "alter table `user_account` add column `email_cipher` varchar(136)" in found
    assert "alter table `user_account` add column `id_card_backup` varchar(80)" in found
    assert any(s.startswith("create table `card_store`") and "`id_card_cipher` varchar(464)" in s for s in found)
    assert any('add "phone_hash" varchar2(64)' in s for s in ddl.statements(rules, "user_account", columns, "ORACLE12"))
    assert code(lambda: ddl.statements(rules, "user_account", columns, "CLICKHOUSE")) == "DEFINITION_INVALID"
    small = ddl.statements(rules, "user_account", columns, "MYSQL", existing={"card_store": {"id": "varchar(64)", "id_card_cipher": "varchar(8)", "id_card_hash": "varchar(64)", "id_card_like": "varchar(80)", "id_card_masked": "varchar(80)"}})
    assert "alter table `card_store` modify column `id_card_cipher` varchar(464)" in small
    assert ddl.cipher_type("varchar(5000)", "MYSQL", ddl.Sizing()) == "text" and normal("`A`") == "a"
