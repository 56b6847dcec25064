"""What keeps the larger jobs linear: method sizes, rows that meet the rules, folders by year, moved partitions, batch sizes."""

import datetime as dt

from ledgerline.operators import aggregates as A
from ledgerline.operators import maintain
from ledgerline.plans import maintenance
from ledgerline.plans.common import by_year, ledger
from ledgerline.plans.labelling import rules
from ledgerline.session import TEXT_BATCHES, scratch_path, text_batches
from ledgerline.sources import adapter, files

SF = "/root/testdata/sf0.001"


def longest_method(spark, df):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = df._jdf.queryExecution().debug().codegenToSeq()
        return max(code.apply(i)._3().maxMethodCodeSize() for i in range(code.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_reclassification_is_compiled(spark):
    out = maintain.reclassified_ledger(adapter.movements(spark, SF), rules(spark, SF), adapter.CUTOVER_YEAR)
    assert longest_method(spark, out) <= 8000


def test_only_rows_without_label_meet_the_rules(spark, monkeypatch):
    seen, classify = [], maintain.classify
    monkeypatch.setattr(maintain, "classify", lambda df, r, **kw: seen.append((df, kw)) or classify(df, r, **kw))
    maintenance._rebuilt(spark, SF)
    (rows, kw), = seen
    met = rows.where(f"{kw.get('concept', 'concept')} is not null").select("label", "date").distinct().collect()
    assert met and all(r["label"] == "" and r["date"].year >= adapter.CUTOVER_YEAR for r in met)


def test_aggregates_of_a_struct_sort_by_a_hash(spark):
    detail = A.month_detail(ledger(spark, SF))
    assert "xxhash64" in detail._jdf.queryExecution().optimizedPlan().toString() and "_h" not in detail.columns


def test_by_year(spark):
    rows = [("a", dt.date(2020, 1, 2)), ("a", dt.date(2020, 1, 2)), ("b", dt.date(2021, 5, 6)), (None, None)]
    years = by_year(spark.createDataFrame(rows, "row_id string, date date"))
    assert sorted(map(tuple, years.collect()), key=repr) == sorted(((i, d, d and d.year) for i, d in rows), key=repr)
    assert all("_year=2021" in f for f in years.where("_year = 2021").selectExpr("_metadata.file_path f").toPandas()["f"])
    assert by_year(spark.createDataFrame([], "row_id string, date date")).count() == 0


def test_replace_moves_a_folder(spark):
    a, b = scratch_path(spark, "a"), scratch_path(spark, "b")
    files.touch(spark, f"{a}/m/new")
    files.touch(spark, f"{b}/m/old")
    files.replace(spark, f"{a}/m", f"{b}/m")
    assert files.names(spark, f"{b}/m") == ["new"] and files.names(spark, a) == []


def test_text_batches(spark):
    before = {k: spark.conf.get(k, None) for k in TEXT_BATCHES}
    first, second = TEXT_BATCHES
    try:
        spark.conf.unset(first)
        spark.conf.set(second, "9m")
        text_batches(spark)
        assert spark.conf.get(first) == TEXT_BATCHES[first] and spark.conf.get(second) == "9m"
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
