"""Ledger versions: apply, read current, roll back, interrupted and competing writers; J1 with null ledgers."""

import datetime as dt
from decimal import Decimal as D

import pytest

from ledgerline.operators.dedupe import fresh_movements, new_movements
from ledgerline.session import scratch_path
from ledgerline.sources import files
from ledgerline.sources.versions import Versions


def values(df):
    return sorted(r["v"] for r in df.collect())


def test_publish_read_and_roll_back(spark):
    v = Versions(spark, scratch_path(spark, "versions"))
    with pytest.raises(ValueError):
        v.read()
    v.publish(spark.range(3).selectExpr("id v"), "one")
    v.publish(v.read().selectExpr("v + 10 v"), "two")             # reads the version it replaces
    v.publish(v.read().selectExpr("v * 2 v"), "three")
    assert values(v.read()) == [20, 22, 24] and values(v.read("one")) == [0, 1, 2]
    assert v.roll_back() == "two" and values(v.read()) == [10, 11, 12]
    assert v.roll_back("one") == "one" and v.history() == ["one", "two", "three", "two", "one"]
    for bad in (lambda: v.publish(v.read(), "two"), lambda: v.roll_back("none")):
        with pytest.raises(ValueError):
            bad()


def test_lost_and_competing_writers(spark, monkeypatch):
    v = Versions(spark, scratch_path(spark, "versions"))
    v.publish(spark.range(1).selectExpr("id v"), "one")
    with monkeypatch.context() as m:                               # lost between the rows and the switch
        m.setattr(files, "create_new", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            v.publish(spark.range(5).selectExpr("id v"), "two")
    assert v.current() == "one" and values(v.read()) == [0]
    v.publish(spark.range(2).selectExpr("id v"), "two")
    assert values(v.read()) == [0, 1]
    with pytest.raises(FileExistsError):                           # a writer that saw one version only
        v._switch("late", 1)
    assert v.current() == "two"


def test_rows_without_a_ledger_are_known(spark):
    schema = "ledger_id string, date date, concept string, debit decimal(18,2), credit decimal(18,2), file_no int"
    day = dt.date(2024, 5, 1)
    old = spark.createDataFrame([(None, day, "a", D(1), None, 0), ("x", day, "b", D(2), None, 0)], schema)
    rows = [(None, day, " A ", D(1), None, 1), ("x", day, "a", D(1), None, 1), (None, day, "b", D(2), None, 1), (None, None, "a", D(1), None, 1)]
    inc = spark.createDataFrame(rows, schema)
    want = sorted(map(repr, [("x", "a"), (None, "b"), (None, "a")]))
    for got in (new_movements(inc, old), fresh_movements(inc, old)):
        assert sorted(repr((r["ledger_id"], r["concept"])) for r in got.collect()) == want
    path = scratch_path(spark, "ledger")
    old.write.parquet(path)
    from ledgerline.operators.dedupe import _known_keys, with_key
    plan = _known_keys(spark.read.parquet(path), with_key(inc))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date" in plan
