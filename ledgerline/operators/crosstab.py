"""Category × month cross tables (A5, A5w, A6, A15, F4–F6).

Long form: (ledger, section, level, category, subcategory, month, value).  Arrays aligned by month
index exist only in the JSON document sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import zero

from ledgerline.constants import UNCLASSIFIED
from ledgerline.functions.predicates import in_period
from ledgerline.operators.aggregates import with_flow
from ledgerline.operators.windows import dense_grid
from ledgerline.session import materialize

_KEYS = ["ledger_id", "section", "category", "subcategory", "month"]
# grouping_id over _KEYS: a set bit marks a column rolled up
_GID_SUB, _GID_CAT, _GID_TOTAL, _GID_SECTION = 0, 2, 3, 6


def _base(led: DataFrame, **kw) -> DataFrame:
    """(ledger, month, section, category, sub) sums; section null outside both sections."""
    f = with_flow(led, **kw)
    section = (F.when(F.col("flow") == "income", F.lit("income"))
                .when((F.col("flow") == "expense") & (F.col("category") != UNCLASSIFIED), F.lit("expense")))
    return (f.withColumn("section", section)
             .groupBy("ledger_id", "month", "section", "category", "subcategory")
             .agg(F.sum("amount").alias("amount")))


def cross_table(led: DataFrame, shared: bool = True, **kw) -> DataFrame:
    """A5: dense long cross table.  Income positive, expense shown positive, expense excludes
    'Sin clasificar'.  Levels: 'sub' (non-blank subs), 'category', 'section' (both sections, every
    month) and 'total' (category over all months, with the display rank O2: total desc, name)."""
    base = materialize(_base(led, **kw)) if shared else _base(led, **kw)
    return cross_table_from_base(base)


def detail_base(fine: DataFrame) -> DataFrame:
    """The leaf aggregate of the cross table from ``month_detail``."""
    section = (F.when(F.col("flow") == "income", F.lit("income"))
                .when((F.col("flow") == "expense") & (F.col("category") != UNCLASSIFIED), F.lit("expense")))
    return (fine.withColumn("section", section).groupBy("ledger_id", "month", "section", "category", "subcategory")
                .agg(F.sum("amount").alias("amount")))


def cross_table_from_base(base: DataFrame, year=None) -> DataFrame:
    """A5 on a (ledger_id, month, section, category, subcategory, amount) aggregate whose section is
    null for rows outside both sections (their months still count).  With ``year`` only its months are
    listed; the categories and their totals are still those of all years."""
    months = base.select("ledger_id", "month").distinct().where(in_period("month", year))
    facts = (base.where(F.col("section").isNotNull())
                 .withColumn("value", F.when(F.col("section") == "income", F.col("amount")).otherwise(-F.col("amount"))))
    agg = (facts.groupingSets(
              [["ledger_id", "section", "category", "subcategory", "month"],
               ["ledger_id", "section", "category", "month"],
               ["ledger_id", "section", "month"],
               ["ledger_id", "section", "category"]], *_KEYS)
              .agg(F.sum("value").alias("value"), F.grouping_id().alias("_gid")))

    sub = agg.where((F.col("_gid") == _GID_SUB) & (F.col("subcategory") != ""))
    sub_level = dense_grid(sub, months, sub, ["section", "category", "subcategory"], "value")
    cat = agg.where(F.col("_gid") == _GID_CAT)
    cat_level = dense_grid(cat, months, cat, ["section", "category"], "value")
    sections = months.select("ledger_id", F.explode(F.array(F.lit("income"), F.lit("expense"))).alias("section"))
    sec = agg.where(F.col("_gid") == _GID_SECTION)
    sec_level = dense_grid(sections, months, sec, ["section"], "value")
    tot = agg.where(F.col("_gid") == _GID_TOTAL)
    rank = F.row_number().over(Window.partitionBy("ledger_id", "section")
                               .orderBy(F.col("value").desc(), F.col("category")))
    cols = ["ledger_id", "section", "level", "category", "subcategory", "month", "value", "rank"]
    nul_s, nul_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    return (sub_level.select("ledger_id", "section", F.lit("sub").alias("level"), "category", "subcategory",
                             "month", "value", nul_i.alias("rank"))
            .unionByName(cat_level.select("ledger_id", "section", F.lit("category").alias("level"), "category",
                                          nul_s.alias("subcategory"), "month", "value", nul_i.alias("rank")))
            .unionByName(sec_level.select("ledger_id", "section", F.lit("section").alias("level"),
                                          nul_s.alias("category"), nul_s.alias("subcategory"), "month", "value",
                                          nul_i.alias("rank")))
            .unionByName(tot.select("ledger_id", "section", F.lit("total").alias("level"), "category",
                                    nul_s.alias("subcategory"), nul_s.alias("month"), "value", rank.alias("rank")))
            .select(*cols))


def cross_table_wide(ct: DataFrame, year: int) -> DataFrame:
    """A5w: category rows of one year with the months as columns (explicit month list, so the
    pivot needs no extra pass) plus the year total.  A month the ledger does not have is null."""
    months = [f"{year}-{m:02d}" for m in range(1, 13)]
    cat = ct.where((F.col("level") == "category") & in_period("month", year))
    wide = cat.groupBy("ledger_id", "section", "category").pivot("month", months).agg(F.sum("value"))
    total = sum((F.coalesce(F.col(f"`{m}`"), zero()) for m in months), zero())
    return wide.withColumn("total", total)


def unclassified_series(led: DataFrame) -> DataFrame:
    """−Σ amount of 'Sin clasificar' rows per month (any kind), dense over the ledger's months."""
    months = led.groupBy("ledger_id", "month").agg(
        (-F.coalesce(F.sum(F.when(F.col("category") == UNCLASSIFIED, F.col("amount"))), zero())).alias("value"))
    return months


def period_summary(base: DataFrame, balances: DataFrame, year) -> DataFrame:
    """A15 (+F5): for the visible months: opening of the first, closing of the last, Σ income and
    Σ expense of the cross-table sections, from the leaf aggregate."""
    sec = base.where(in_period("month", year))
    tot = sec.groupBy("ledger_id").agg(
        F.coalesce(F.sum(F.when(F.col("section") == "income", F.col("amount"))), zero()).alias("income_total"),
        F.coalesce(F.sum(F.when(F.col("section") == "expense", -F.col("amount"))), zero()).alias("expense_total"))
    b = balances.where(in_period("month", year)).groupBy("ledger_id").agg(
        F.min_by("opening", "month").alias("opening"), F.max_by("closing", "month").alias("closing"))
    return tot.join(b, "ledger_id", "left")


def non_empty_series(ct: DataFrame, year) -> DataFrame:
    """series (section, category[, sub]) with a non-zero value among the visible months, with
    their visible total."""
    rows = ct.where(F.col("level").isin("sub", "category") & in_period("month", year))
    return (rows.groupBy("ledger_id", "section", "level", "category", "subcategory")
                .agg(F.sum("value").alias("total"), F.max(F.abs("value")).alias("_mx"))
                .where(F.col("_mx") > 0).drop("_mx"))
