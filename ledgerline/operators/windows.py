"""Ranking, trailing and trend windows.

Inputs are (ledger, month[, key]) aggregates; every window is partitioned by ledger (or finer).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.constants import (AVERAGE_MONTHS, TOP_CATEGORIES_N, TOP_MOVEMENTS_MIN_ABS, TOP_MOVEMENTS_N,
                                  TREND_BAND, TREND_MONTHS)
from ledgerline.functions.numbers import cents, round_ratio, vs_average, zero
from ledgerline.operators.aggregates import expense_rows, group_movements



def dense_grid(keys: DataFrame, months: DataFrame, facts: DataFrame, key_cols, value: str,
               fill=None) -> DataFrame:
    """Every key × every month of its ledger, missing = 0.

    ``keys`` and ``months`` are per-ledger aggregates (bounded by the taxonomy and the calendar),
    so the ledger-keyed join produces exactly the grid, never row pairs of the raw table.
    """
    key_cols = list(key_cols)
    grid = keys.select("ledger_id", *key_cols).distinct().join(
        months.select("ledger_id", "month").distinct(), "ledger_id")
    f = facts.select("ledger_id", *key_cols, "month", value)
    return (grid.join(f, ["ledger_id", *key_cols, "month"], "left")
                .withColumn(value, F.coalesce(F.col(value), zero() if fill is None else fill)))


def top_movements(led: DataFrame, n: int = TOP_MOVEMENTS_N, min_abs: int = TOP_MOVEMENTS_MIN_ABS, **kw) -> DataFrame:
    """W4 (+F10): per month, expense groups by (origin, category, sub) with |Σ| > min_abs, most
    negative first, first ``n``; ties by (origin, category, sub).  One pass over the rows: they are only
    aggregated (by keys and concept, map-side first), and totals, mode and rank come from those groups."""
    groups = group_movements(expense_rows(led, **kw), ["ledger_id", "month", "origin", "category", "subcategory"])
    return top_from_groups(groups, n, min_abs)


def top_from_groups(groups: DataFrame, n: int = TOP_MOVEMENTS_N, min_abs: int = TOP_MOVEMENTS_MIN_ABS) -> DataFrame:
    """W4 on already-built expense groups keyed (ledger, month, category, origin, subcategory)."""
    w = Window.partitionBy("ledger_id", "month").orderBy("total", "origin", "category", "subcategory")
    return (groups.where(F.abs("total") > min_abs).withColumn("rank", F.row_number().over(w))
                  .where(F.col("rank") <= n))


def last_n_months(months: DataFrame, n: int = AVERAGE_MONTHS) -> DataFrame:
    """The trailing ``n`` months of each ledger."""
    w = Window.partitionBy("ledger_id").orderBy(F.col("month").desc())
    return (months.select("ledger_id", "month").distinct()
            .withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= n))


def category_average(months: DataFrame, cat_totals: DataFrame, n: int = AVERAGE_MONTHS) -> DataFrame:
    """Over the last ``n`` months of the ledger, mean of the category's month total over the
    months where it occurs; rounded to cents exactly."""
    recent = last_n_months(months, n).select("ledger_id", "month")
    ct = cat_totals.join(recent, ["ledger_id", "month"], "left_semi")
    return (ct.groupBy("ledger_id", "category")
              .agg(F.sum(cents("total")).alias("_c"), F.count(F.lit(1)).alias("n_months"))
              .select("ledger_id", "category", round_ratio("_c", "n_months").alias("average"), "n_months"))


def top_categories(cat_totals: DataFrame, n: int = TOP_CATEGORIES_N) -> DataFrame:
    """All-time expense per category, descending (ties by name), first ``n``."""
    w = Window.partitionBy("ledger_id").orderBy(F.col("total").desc(), F.col("category"))
    return (cat_totals.groupBy("ledger_id", "category").agg(F.sum("total").alias("total"))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n))


def history(months: DataFrame, cat_totals: DataFrame, n: int = TOP_CATEGORIES_N) -> DataFrame:
    """Dense month series of the all-time top-``n`` categories (the expense / income series
    are A1)."""
    top = top_categories(cat_totals, n).select("ledger_id", "category", "rank")
    series = dense_grid(top, months, cat_totals, ["category"], "total")
    return series.join(top, ["ledger_id", "category"])


def category_trend(months: DataFrame, cat_totals: DataFrame, n: int = TREND_MONTHS,
                   band: float = TREND_BAND) -> DataFrame:
    """Series of the last ``n`` months up to each month (zero filled); with ≥ 3 points compare
    mean(last 3) with mean(older points): > +band 'up', < −band 'down', else 'flat'; '' when fewer
    than 3 points or the older mean is 0.  Rows: the categories present in the month."""
    grid = dense_grid(cat_totals, months, cat_totals.withColumn("_v", F.col("total")), ["category"], "_v")
    w = Window.partitionBy("ledger_id", "category").orderBy("month")
    idx = F.row_number().over(w)
    s3 = F.sum("_v").over(w.rowsBetween(-2, 0))
    so = F.sum("_v").over(w.rowsBetween(-(n - 1), -3))
    g = grid.select("ledger_id", "category", "month", F.least(idx, F.lit(n)).alias("_len"),
                    s3.alias("_s3"), so.alias("_so"))
    recent = F.col("_s3").cast("double") / 3
    older = F.coalesce(F.col("_so"), zero()).cast("double") / F.greatest(F.col("_len") - 3, F.lit(1))
    diff = (recent - older) / older
    trend = (F.when((F.col("_len") < 3) | (older == 0), F.lit(""))
              .when(diff > band, F.lit("up")).when(diff < -band, F.lit("down")).otherwise(F.lit("flat")))
    g = g.select("ledger_id", "category", "month", trend.alias("trend"))
    return cat_totals.select("ledger_id", "month", "category", "total").join(g, ["ledger_id", "category", "month"])


def trailing_mean(months: DataFrame, n: int = 3, value: str = "expense_total") -> DataFrame:
    """Mean of the ``n`` months before the current one; none ⇒ 0."""
    w = Window.partitionBy("ledger_id").orderBy("month").rowsBetween(-n, -1)
    mean = F.sum(value).over(w).cast("double") / F.count(value).over(w)
    return months.select("ledger_id", "month", F.coalesce(mean, F.lit(0.0)).alias("trailing_mean"))


def month_vs_average(cat_totals: DataFrame, averages: DataFrame) -> DataFrame:
    """J7 + P18: each category month total against its ledger average (absent ⇒ 0)."""
    j = cat_totals.join(averages.select("ledger_id", "category", "average"), ["ledger_id", "category"], "left")
    j = j.withColumn("average", F.coalesce(F.col("average"), F.lit(0.0)))
    ratio, status, bar = vs_average("total", "average")
    return j.select("ledger_id", "month", "category", "total", "average", ratio.alias("ratio"),
                    status.alias("status"), bar.alias("bar"))
