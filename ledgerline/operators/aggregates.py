"""Month / category aggregates.

Every aggregate groups by ``ledger_id`` first; partial (map-side) aggregation absorbs a hot
ledger before the shuffle.  Windows in other modules run on these aggregates, never on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import zero

from ledgerline.constants import (CONCEPT_CHARS, DEFAULT_INCOME_CATEGORIES, DEFAULT_SYSTEM_CATEGORIES,
                                  EXCLUDED_FROM_BALANCE, GROUP_MOVEMENTS_SHOWN, UNCLASSIFIED)
from ledgerline.functions.dates import month_label, month_number
from ledgerline.functions.labels import flow_class
from ledgerline.functions.text import truncate



def group_by_hash(df: DataFrame, *keys):
    """``df`` grouped by ``keys`` with their hash ``_h`` before them.  Spark sorts the rows for an aggregate that holds a text or
    a struct; with the hash first that compares one number and not several texts."""
    return df.groupBy(F.xxhash64(*keys).alias("_h"), *keys)


def with_flow(led: DataFrame, income=DEFAULT_INCOME_CATEGORIES, system=DEFAULT_SYSTEM_CATEGORIES) -> DataFrame:
    """Adds ``flow`` ∈ {income, expense, null}."""
    return led.withColumn("flow", flow_class("kind", "category", income, system))


def expense_rows(led: DataFrame, **kw) -> DataFrame:
    return with_flow(led, **kw).where(F.col("flow") == "expense")


def month_totals(led: DataFrame, with_net: bool = False, excluded: str = EXCLUDED_FROM_BALANCE, **kw) -> DataFrame:
    """A1: per (ledger, month): expense = −Σ amount of expense rows, income = Σ of income rows.
    A month with only system rows still appears, with zeros.  ``with_net`` adds W1's month net
    (Σ amount outside the excluded category) from the same aggregation pass."""
    f = with_flow(led, **kw)
    aggs = [F.coalesce(-F.sum(F.when(F.col("flow") == "expense", F.col("amount"))), zero()).alias("expense_total"),
            F.coalesce(F.sum(F.when(F.col("flow") == "income", F.col("amount"))), zero()).alias("income_total")]
    if with_net:
        aggs.append(F.coalesce(F.sum(F.when(F.col("category") != excluded, F.col("amount"))), zero()).alias("net"))
    return f.groupBy("ledger_id", "month").agg(*aggs).withColumn("label", month_label("month"))


def category_totals(led: DataFrame, **kw) -> DataFrame:
    """A2: −Σ per (ledger, month, category) of expense rows, 'Sin clasificar' included."""
    return (expense_rows(led, **kw).groupBy("ledger_id", "month", "category")
            .agg((-F.sum("amount")).alias("total"), F.count(F.lit(1)).alias("n")))


def subcategory_totals(led: DataFrame, **kw) -> DataFrame:
    """A3: −Σ per (ledger, month, category, subcategory) of expense rows; blank sub left out."""
    return (expense_rows(led, **kw).where(F.col("subcategory") != "")
            .groupBy("ledger_id", "month", "category", "subcategory")
            .agg((-F.sum("amount")).alias("total")))


def group_movements(rows: DataFrame, keys) -> DataFrame:
    """A4: per key set — last date, most frequent concept (tie ⇒ smallest text), Σ amount, count.

    Two-level aggregation instead of a per-group value map: (keys, concept) counts first, then
    the mode is ``min_by(concept, (−count, concept))``.  Both levels aggregate map-side, so a hot
    group never holds its distinct concepts in one task's memory.
    """
    keys = list(keys)
    lvl1 = (rows.groupBy(*keys, "concept")
            .agg(F.count(F.lit(1)).alias("_n"), F.max("date").alias("_d"), F.sum("amount").alias("_s")))
    return groups_from_concepts(lvl1, keys)


def groups_from_concepts(lvl1: DataFrame, keys) -> DataFrame:
    """A4's second level, on (keys, concept) with _n, _d and _s."""
    return (group_by_hash(lvl1, *keys)
            .agg(F.max("_d").alias("last_date"),
                 F.min_by("concept", F.struct((-F.col("_n")).alias("a"), F.col("concept").alias("b"))).alias("_mode"),
                 F.sum("_s").alias("total"), F.sum("_n").alias("n"))
            .withColumn("concept", truncate("_mode", CONCEPT_CHARS)).drop("_mode", "_h"))


def category_groups(led: DataFrame, **kw) -> DataFrame:
    """A4 inside a category: groups by (origin, subcategory) per (ledger, month, category) with the
    display rank O1 (amount ascending) and whether the group is among the first 30, which are shown."""
    return ranked_groups(group_movements(expense_rows(led, **kw), ["ledger_id", "month", "category", "origin", "subcategory"]))


def ranked_groups(g: DataFrame) -> DataFrame:
    """O1 on A4's groups inside a category."""
    w = Window.partitionBy("ledger_id", "month", "category").orderBy("total", "origin", "subcategory")
    return g.withColumn("rank", F.row_number().over(w)).withColumn("shown", F.col("rank") <= GROUP_MOVEMENTS_SHOWN)


def unclassified_movements(led: DataFrame) -> DataFrame:
    """the unlabelled rows with date, concept (60) and amount."""
    return (led.where(F.col("category") == UNCLASSIFIED)
            .select("ledger_id", "month", "row_id", "date", truncate("concept", CONCEPT_CHARS).alias("concept"),
                    "amount"))


def ledger_stats(months: DataFrame) -> DataFrame:
    """A9 over A1: mean expense / income per month, dearest and cheapest month (ties ⇒ later month),
    month count."""
    key = month_number("month")
    return (months.groupBy("ledger_id")
            .agg(F.sum("expense_total").alias("_se"), F.sum("income_total").alias("_si"),
                 F.count(F.lit(1)).alias("n_months"),
                 F.max_by(F.struct("month", "expense_total"), F.struct(F.col("expense_total"), key)).alias("_mx"),
                 F.min_by(F.struct("month", "expense_total"), F.struct(F.col("expense_total"), -key)).alias("_mn"))
            .select("ledger_id",
                    (F.col("_se").cast("double") / F.col("n_months")).alias("avg_expense"),
                    (F.col("_si").cast("double") / F.col("n_months")).alias("avg_income"),
                    F.col("_mx.month").alias("max_month"), F.col("_mx.expense_total").alias("max_expense"),
                    F.col("_mn.month").alias("min_month"), F.col("_mn.expense_total").alias("min_expense"),
                    "n_months"))


def review_count(led: DataFrame) -> DataFrame:
    """Number of 'Sin clasificar' rows per ledger, plus the all-ledgers total (ledger_id null)."""
    return led.rollup("ledger_id").agg(F.count_if(F.col("category") == UNCLASSIFIED).alias("n_review"))


def active_years(led: DataFrame) -> DataFrame:
    """Distinct years over all ledgers; the latest is the default."""
    # the distinct-year table has one row per calendar year, so the un-partitioned window is tiny
    y = led.select(F.substring("month", 1, 4).alias("year")).distinct()
    return y.withColumn("is_default", F.col("year") == F.max("year").over(Window.partitionBy()))


def account_accumulated(months: DataFrame, balances: DataFrame) -> DataFrame:
    """Σ income, Σ expense and the last month's closing balance per ledger."""
    last = balances.groupBy("ledger_id").agg(F.max_by("closing", "month").alias("last_balance"))
    tot = months.groupBy("ledger_id").agg(F.sum("income_total").alias("income_total"),
                                          F.sum("expense_total").alias("expense_total"))
    return tot.join(last, "ledger_id", "left")


def movement_count(groups: DataFrame) -> DataFrame:
    """Movements behind each category of a month (Σ n of its groups)."""
    return groups.groupBy("ledger_id", "month", "category").agg(F.sum("n").alias("n_movements"))


def month_detail(led: DataFrame, **kw) -> DataFrame:
    """One pass over ledger rows: (ledger, month, flow, category, subcategory, origin) sums and
    counts plus the month's last movement as max(struct(date, row_id, bank_balance)).  Month and
    category totals, balances and the cross table can all be derived from it."""
    return (group_by_hash(with_flow(led, **kw), "ledger_id", "month", "flow", "category", "subcategory", "origin")
            .agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"),
                 F.max(F.struct("date", "row_id", "bank_balance")).alias("_last")).drop("_h"))


def months_from_detail(fine: DataFrame, excluded: str = EXCLUDED_FROM_BALANCE) -> DataFrame:
    """A1 (with W1's net) from ``month_detail``."""
    exp = F.col("flow") == "expense"
    return (fine.groupBy("ledger_id", "month").agg(
                F.coalesce(-F.sum(F.when(exp, F.col("amount"))), zero()).alias("expense_total"),
                F.coalesce(F.sum(F.when(F.col("flow") == "income", F.col("amount"))), zero()).alias("income_total"),
                F.coalesce(F.sum(F.when(F.col("category") != excluded, F.col("amount"))), zero()).alias("net"))
            .withColumn("label", month_label("month")))


def categories_from_detail(fine: DataFrame) -> DataFrame:
    """A2 from ``month_detail``."""
    return (fine.where(F.col("flow") == "expense").groupBy("ledger_id", "month", "category")
                .agg((-F.sum("amount")).alias("total"), F.sum("n").alias("n")))


def subcategories_from_detail(fine: DataFrame) -> DataFrame:
    """A3 from ``month_detail``."""
    return (fine.where((F.col("flow") == "expense") & (F.col("subcategory") != ""))
                .groupBy("ledger_id", "month", "category", "subcategory").agg((-F.sum("amount")).alias("total")))
