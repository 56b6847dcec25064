"""Properties of the report operators on the driver data (sf0.001)."""

from pyspark.sql import functions as F

from ledgerline.operators import aggregates as A
from ledgerline.operators import balances as B
from ledgerline.operators import crosstab as X
from ledgerline.operators import dedupe as DD
from ledgerline.plans.common import ledger
from ledgerline.plans.labelling import rules
from ledgerline.sources import adapter

from conftest import SF_SMALL


def test_closing_equals_next_opening(spark):
    b = B.running_balance(ledger(spark, SF_SMALL), adapter.opening_balances(spark, SF_SMALL))
    from pyspark.sql import Window
    w = Window.partitionBy("ledger_id").orderBy("month")
    bad = b.withColumn("nxt", F.lead("opening").over(w)).where(F.col("nxt").isNotNull() & (F.col("nxt") != F.col("closing")))
    assert bad.count() == 0


def test_cross_table_cells_sum_to_totals(spark):
    ct = X.cross_table(ledger(spark, SF_SMALL))
    cat = ct.where(F.col("level") == "category").groupBy("ledger_id", "section", "month").agg(F.sum("value").alias("s"))
    sec = ct.where(F.col("level") == "section").select("ledger_id", "section", "month", F.col("value").alias("t"))
    j = sec.join(cat, ["ledger_id", "section", "month"], "left").where(F.coalesce(F.col("s"), F.lit(0)) != F.col("t"))
    assert j.count() == 0
    tot = ct.where(F.col("level") == "total").groupBy("ledger_id", "section").agg(F.sum("value").alias("a"))
    all_m = sec.groupBy("ledger_id", "section").agg(F.sum("t").alias("b"))
    assert tot.join(all_m, ["ledger_id", "section"]).where(F.col("a") != F.col("b")).count() == 0


def test_month_expense_is_cross_expense_plus_unclassified_expense(spark):
    led = ledger(spark, SF_SMALL)
    m = A.month_totals(led).select("ledger_id", "month", "expense_total")
    ct = X.cross_table(led).where((F.col("level") == "section") & (F.col("section") == "expense"))
    unc = (A.with_flow(led).where((F.col("flow") == "expense") & (F.col("category") == "Sin clasificar"))
           .groupBy("ledger_id", "month").agg((-F.sum("amount")).alias("u")))
    j = (m.join(ct.select("ledger_id", "month", "value"), ["ledger_id", "month"])
          .join(unc, ["ledger_id", "month"], "left")
          .where(F.col("expense_total") != F.col("value") + F.coalesce(F.col("u"), F.lit(0))))
    assert j.count() == 0


def test_second_import_adds_nothing(spark):
    inc = adapter.incoming_rows(spark, SF_SMALL)
    led = adapter.existing_ledger(spark, SF_SMALL)
    first = DD.import_statements(inc, led, rules(spark, SF_SMALL), "b1")
    assert first.count() > 0
    cols = ["ledger_id", "date", "concept", "debit", "credit"]
    after = led.select(*cols).unionByName(first.select(*cols))
    again = DD.import_statements(inc, after, rules(spark, SF_SMALL), "b2")
    assert again.count() == 0


def test_shuffled_input_changes_nothing(spark):
    led = ledger(spark, SF_SMALL)
    a = A.month_totals(led).collect()
    b = A.month_totals(led.repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
