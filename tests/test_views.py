"""Stored month views: refreshed state = full recompute, on backdated, empty and repeated batches and after crashes."""

import datetime as dt
import random

import pytest

from ledgerline.plans.outputs import view_rows
from ledgerline.session import scratch_path
from ledgerline.sources import files
from ledgerline.streaming.views import MonthViews

SCHEMA = ("ledger_id string, row_id string, kind string, origin string, category string, subcategory string, date date, concept string, "
          "debit decimal(18,2), credit decimal(18,2), bank_balance decimal(18,2)")


def batch(rnd, n, years, start):
    from decimal import Decimal
    out = []
    for i in range(start, start + n):
        money = Decimal(rnd.randrange(1, 10**6)) / 100
        income = rnd.random() < 0.3
        out.append((rnd.choice(["a", "b", "c", None]), f"{i:06d}", rnd.choice(["Ingresos", "Gastos", ""]), rnd.choice(["x", "y"]),
                    rnd.choice(["Salud", "No va", "", "Otros ingresos"]), rnd.choice(["", "s1", "s2"]),
                    dt.date(rnd.choice(years), rnd.randrange(1, 13), rnd.randrange(1, 28)) if rnd.random() < 0.97 else None,
                    rnd.choice(["uno", "dos", "tres"]), None if income else money, money if income else None,
                    Decimal(rnd.randrange(-500, 500)) if rnd.random() < 0.3 else None))
    return out


@pytest.fixture(scope="module")
def state(spark):
    rnd = random.Random(6)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    opening = spark.createDataFrame([("a", 100), (None, 7)], "ledger_id string, opening int").selectExpr("ledger_id", "cast(opening as decimal(18,2)) opening")
    batches = [batch(rnd, 60, [2020, 2022], 0), batch(rnd, 15, [2021], 100), [], batch(rnd, 12, [2019, 2023], 200), batch(rnd, 4, [2018, 2022], 300)]
    return frame, opening, batches


def rows(views):
    return sorted((tuple(r) for r in view_rows(views).collect()), key=repr)


def full(spark, state, batches):
    frame, opening, _ = state
    views = MonthViews(spark, scratch_path(spark, "views"), opening, 2019, buckets=1)
    views.rebuild(frame([r for b in batches for r in b]))
    return rows(views)


def test_refreshes_equal_a_full_recompute(spark, state):
    frame, opening, batches = state
    views = MonthViews(spark, scratch_path(spark, "views"), opening, 2019, buckets=2)
    for i, b in enumerate(batches):
        views.refresh(frame(b), f"b{i}")
        views.refresh(frame(b), f"b{i}")                # a replay changes nothing
    assert rows(views) == full(spark, state, batches)


def test_untouched_partitions_keep_their_files(spark, state):
    frame, opening, batches = state
    path = scratch_path(spark, "views")
    views = MonthViews(spark, path, opening, 2019, buckets=1)
    views.refresh(frame(batches[0]), "b0")
    listed = lambda: {r["p"] for r in spark.read.parquet(f"{path}/detail").selectExpr("_metadata.file_path p").distinct().collect()}
    before = listed()
    late = [r for r in batches[4] if r[6] and r[6].year == 2022][:1] or [(*batches[0][0][:6], dt.date(2022, 5, 3), *batches[0][0][7:])]
    views.refresh(frame(late), "late")
    month = late[0][6].strftime("month=%Y-%m")
    assert {p for p in before if month not in p} <= listed()
    touched = views.touched("detail", views._delta(frame(late)))
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and late[0][6].strftime("%Y-%m") in plan


def test_interrupted_refreshes(spark, state, monkeypatch):
    frame, opening, batches = state
    want = full(spark, state, batches[:2])
    for stop_at in ("before READY", "while replacing"):
        views = MonthViews(spark, scratch_path(spark, "views"), opening, 2019, buckets=1)
        views.refresh(frame(batches[0]), "b0")
        touch = files.touch

        def fail(s, path):
            if ("READY" in path) == (stop_at == "before READY"):
                raise RuntimeError("lost")
            touch(s, path)
        with monkeypatch.context() as m:
            m.setattr(files, "touch", fail)
            with pytest.raises(RuntimeError):
                views.refresh(frame(batches[1]), "b1")
        views.refresh(frame(batches[1]), "b1")
        assert rows(views) == want
