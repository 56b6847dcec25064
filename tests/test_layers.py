"""Layered tables: replays, lost writes and merges, pruning; the ledger by month in imports; the kept labeller."""

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.dedupe import new_movements
from ledgerline.operators.kept_model import KeptLabeller
from ledgerline.operators.model import nb_labeller
from ledgerline.session import scratch_path
from ledgerline.sources import files
from ledgerline.sources.layers import Layers
from ledgerline.sources.monthly import MonthLedger

ROWS = "ledger_id string, row_id string, date date, concept string, debit decimal(18,2), credit decimal(18,2), category string"


def day(year, month, d=1):
    return dt.date(year, month, d)


def frame(spark, rows):
    return spark.createDataFrame([(led, rid, d, c, Decimal(x), None, cat) for led, rid, d, c, x, cat in rows], ROWS)


def ids(df):
    return sorted(r[0] for r in df.select("row_id").collect())


def months(lo, n, ledger="a"):
    return [(ledger, f"{ledger}{i}", day(2020 + i // 12, i % 12 + 1), "compra", 5 + i, "Salud") for i in range(lo, lo + n)]


def test_batches_replace_themselves_and_merge(spark):
    t = Layers(spark, scratch_path(spark, "layers"), "row_id string, n int")
    batch = lambda *rows: spark.createDataFrame(list(rows), "row_id string, n int")
    assert t.read().count() == 0 and t.compact(2) is None
    t.append(batch(("a", 1), ("b", 2)), "1")
    t.append(batch(("c", 3)), "1")                          # the same batch again
    t.append(batch(), "empty")
    assert ids(t.read()) == ["c"] and ids(t.read(without="1")) == []
    for i in range(2, 5):
        t.append(batch(("c", i)), str(i))
    merged = t.compact(4, lambda d: d.groupBy("row_id").agg(F.sum("n").cast("int").alias("n")), keep=("4",))
    assert t.live() == ["b-4", merged]
    assert sorted(map(tuple, t.read().collect())) == [("c", 4), ("c", 8)]
    with pytest.raises(ValueError):
        t.append(batch(("c", 9)), "2")                      # part of a merged layer
    assert sorted(t.vacuum()) == ["b-1", "b-2", "b-3", "b-empty"]
    assert sorted(map(tuple, t.read().collect())) == [("c", 4), ("c", 8)]


def test_levels(spark):
    t = Layers(spark, scratch_path(spark, "layers"), "row_id string")
    for i in range(4):
        t.append(spark.createDataFrame([(str(i),)], "row_id string"), str(i))
        t.compact(2)
    assert [x.split("-")[1] for x in t.live()] == ["1", "1"]
    t.compact(2)
    assert [x.split("-")[1] for x in t.live()] == ["2"] and ids(t.read()) == ["0", "1", "2", "3"]


def test_unfinished_writes_and_merges_do_not_count(spark, monkeypatch):
    t = Layers(spark, scratch_path(spark, "layers"), "row_id string")
    for i in range(2):
        t.append(spark.createDataFrame([(str(i),)], "row_id string"), str(i))
    t._write(spark.createDataFrame([("x",)], "row_id string"), "b-lost")
    files.delete(spark, f"{t._folder('b-lost')}/_SUCCESS")
    assert ids(t.read()) == ["0", "1"]

    def lost(*_):
        raise OSError("driver lost")
    monkeypatch.setattr("ledgerline.sources.layers.files.create_new", lost)
    with pytest.raises(OSError):
        t.compact(2)
    monkeypatch.undo()
    assert ids(t.read()) == ["0", "1"]                      # the merged rows are there but don't count
    t.compact(2)
    assert ids(t.read()) == ["0", "1"] and len(t.live()) == 1


def test_an_import_reads_the_files_of_its_months(spark):
    store = MonthLedger(spark, scratch_path(spark, "ledger"), buckets=1)
    store.append(frame(spark, months(0, 24)), "1")
    store.append(frame(spark, months(0, 24, "b") + [(None, "n", day(2020, 3), "compra", 7, ""), ("a", "undated", None, "compra", 7, "")]), "2")
    batch = frame(spark, [("a", "x", day(2020, 3), " compra", 7, ""), ("b", "y", day(2020, 3), "compra", 8, ""),
                          (None, "z", day(2020, 3), "COMPRA", 7, ""), ("a", "u", None, "compra", 7, "")])
    near = store.around(batch)
    read = {r[0].split("/part_month=")[1].split("/")[0] for r in near.select(F.input_file_name()).distinct().collect()}
    assert read == {"0", "202003"}
    assert re.search(r"PartitionFilters: \[[^]]*part_month", near._jdf.queryExecution().toString())
    for _ in range(2):                                      # before and after merging
        assert ids(new_movements(batch, store)) == ["u", "y"] == ids(new_movements(batch, store.read()))
        store.compact(2)
    assert {r[0] for r in store.read().select("batch_id").distinct().collect()} == {"1", "2"}
    assert store.read().count() == 50


def test_empty_month_ledger(spark):
    store = MonthLedger(spark, scratch_path(spark, "ledger"))
    batch = frame(spark, months(0, 2))
    assert ids(new_movements(batch, store)) == ["a0", "a1"]
    assert new_movements(frame(spark, []), store).count() == 0


def test_kept_labeller_equals_training_from_scratch(spark):
    words = {"Salud": "farmacia clinica", "Coche": "gasolina taller", "": "farmacia taller"}
    rows = [("a", f"{cat}{i}", day(2020, 1 + i % 12), f"{text.split()[i % 2]} lugar{i % 3}", i + 1, cat)
            for cat, text in words.items() for i in range(8)]
    whole = frame(spark, rows)
    model = KeptLabeller(spark, scratch_path(spark, "labeller"))
    assert model.suggest(whole).count() == 0                # nothing learned yet
    for i in (0, 1, 2, 1):
        model.after_import(frame(spark, rows[i::3]), str(i))
    get = lambda df: sorted(map(tuple, df.select("row_id", "suggestion", "confidence", "review").collect()))
    expected = get(nb_labeller(whole))
    assert len(expected) == 8 and get(model.suggest(whole)) == expected
    model.compact(2)
    assert get(model.suggest(whole)) == expected
    assert sorted(r[0] for r in model.suggestions().select("row_id").collect()) == sorted(r[0] for r in expected)


def test_kept_labeller_learns_old_labels_recoded(spark):
    rows = [("a", "1", day(2020, 1), "farmacia", 1, "MEDICO"), ("a", "2", day(2020, 1), "taller", 1, "Coche"), ("a", "3", day(2020, 1), "farmacia", 1, "")]
    recode = spark.createDataFrame([("MEDICO", "Salud", "")], "old string, new string, sub string")
    model = KeptLabeller(spark, scratch_path(spark, "labeller"), recode=recode)
    model.learn(frame(spark, rows).withColumn("subcategory", F.lit("")), "1")
    assert [r["suggestion"] for r in model.suggest(frame(spark, rows)).collect()] == ["Salud"]
