"""Report queries over the adapter ledger (A-, W-, J7–J11 operators), as registered callables.

Each callable takes (spark, sf_dir) and returns the finalized DataFrame; the same names key the
DuckDB oracle in ``ledgerline.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.predicates import is_card, valid_date
from ledgerline.operators import aggregates as A
from ledgerline.operators import balances as B
from ledgerline.operators import crosstab as X
from ledgerline.operators import windows as W
from ledgerline.plans.common import finalize, ledger
from ledgerline.session import materialize
from ledgerline.sources import adapter


def _months_and_categories(spark, sf):
    """A1 and A2 from one materialized pass over the ledger rows."""
    fine = materialize(A.month_detail(ledger(spark, sf)))
    return A.months_from_detail(fine).drop("net"), A.categories_from_detail(fine)

REPORT_YEAR = 1998          # the year shown by the period views (F5, A5w, A15, F6)
CARD_ORIGIN = "Tarjeta de crédito"


def flagship(spark, sf):
    """Month totals + running balance per ledger (A1 ⋈ W1): the entry query."""
    led = ledger(spark, sf)
    # one aggregation pass gives both A1's totals and W1's net; the window runs on its months
    m = A.month_totals(led, with_net=True)
    b = B.balance_from_net(m, adapter.opening_balances(spark, sf))
    return finalize(b.select("ledger_id", "month", "label", "income_total", "expense_total", "opening", "closing"))


def month_totals(spark, sf):
    return finalize(A.month_totals(ledger(spark, sf)))


def running_balance(spark, sf):
    return finalize(B.running_balance(ledger(spark, sf), adapter.opening_balances(spark, sf)))


def opening_balance(spark, sf):
    b = B.running_balance(ledger(spark, sf), adapter.opening_balances(spark, sf))
    return finalize(b.select("ledger_id", "month", "opening"))


def category_totals(spark, sf):
    return finalize(A.category_totals(ledger(spark, sf)))


def subcategory_totals(spark, sf):
    return finalize(A.subcategory_totals(ledger(spark, sf)))


def group_movements(spark, sf):
    return finalize(A.category_groups(ledger(spark, sf)))


def movement_count(spark, sf):
    return finalize(A.movement_count(A.category_groups(ledger(spark, sf))))


def top_movements(spark, sf):
    return finalize(W.top_movements(ledger(spark, sf)))


def cross_table(spark, sf):
    return finalize(X.cross_table(ledger(spark, sf)))


def card_cross_table(spark, sf):
    led = ledger(spark, sf)
    return finalize(X.cross_table(led.where(is_card("origin"))))


def cross_table_wide(spark, sf):
    base = X.detail_base(materialize(A.month_detail(ledger(spark, sf))))
    return finalize(X.cross_table_wide(X.cross_table_from_base(base, REPORT_YEAR), REPORT_YEAR))


def unclassified_series(spark, sf):
    return finalize(X.unclassified_series(ledger(spark, sf)))


def unclassified_movements(spark, sf):
    return finalize(A.unclassified_movements(ledger(spark, sf)))


def last_n_months(spark, sf):
    return finalize(W.last_n_months(A.month_totals(ledger(spark, sf))))


def category_average(spark, sf):
    months, cat = _months_and_categories(spark, sf)
    return finalize(W.category_average(months, cat))


def top_categories(spark, sf):
    return finalize(W.top_categories(A.category_totals(ledger(spark, sf))))


def history(spark, sf):
    months, cat = _months_and_categories(spark, sf)
    return finalize(W.history(months, cat))


def category_trend(spark, sf):
    months, cat = _months_and_categories(spark, sf)
    return finalize(W.category_trend(months, cat))


def trailing_mean(spark, sf):
    return finalize(W.trailing_mean(A.month_totals(ledger(spark, sf))))


def month_vs_average(spark, sf):
    months, ct = _months_and_categories(spark, sf)
    return finalize(W.month_vs_average(ct, W.category_average(months, ct)))


def ledger_stats(spark, sf):
    return finalize(A.ledger_stats(A.month_totals(ledger(spark, sf))))


def bank_balance(spark, sf):
    return finalize(B.bank_balance(ledger(spark, sf)))


def balance_delta(spark, sf):
    return finalize(B.balance_delta(B.running_balance(ledger(spark, sf), adapter.opening_balances(spark, sf))))


def last_known_balance(spark, sf):
    return finalize(B.last_known_balance(B.bank_balance(ledger(spark, sf))))


def _months_and_bank(spark, sf):
    """A1 and W3 from one materialized pass over the ledger rows."""
    fine = materialize(A.month_detail(ledger(spark, sf)))
    nets = fine.groupBy("ledger_id", "month").agg(F.sum("amount").alias("net"), F.max("_last").alias("_row"))
    bank = B.bank_balance_from(nets.select("ledger_id", "month", "net", F.col("_row.bank_balance").alias("_last")))
    return A.months_from_detail(fine).drop("net"), bank


def account_summary(spark, sf):
    return finalize(B.account_summary(*_months_and_bank(spark, sf)))


def balance_for_month(spark, sf):
    return finalize(B.balance_for_month(B.bank_balance(ledger(spark, sf))))


def review_count(spark, sf):
    return finalize(A.review_count(ledger(spark, sf)))


def active_years(spark, sf):
    return finalize(A.active_years(ledger(spark, sf)))


def account_accumulated(spark, sf):
    return finalize(A.account_accumulated(*_months_and_bank(spark, sf)))


def period_summary(spark, sf):
    fine = materialize(A.month_detail(ledger(spark, sf)))
    b = B.balance_from_net(A.months_from_detail(fine), adapter.opening_balances(spark, sf))
    return finalize(X.period_summary(X.detail_base(fine), b, REPORT_YEAR))


def non_empty_series(spark, sf):
    """a series is non-empty by the rows of the year alone, so only they are read."""
    led = ledger(spark, sf, min_year=REPORT_YEAR, before_year=REPORT_YEAR + 1)
    return finalize(X.non_empty_series(X.cross_table(led), REPORT_YEAR))


def valid_dates(spark, sf):
    """F2 with a later first year: per ledger, rows kept and rows dropped."""
    mv = adapter.movements(spark, sf)
    keep = valid_date("date", REPORT_YEAR)
    return finalize(mv.groupBy("ledger_id").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped")))


QUERIES = {
    "flagship": flagship,
    "month_totals": month_totals,
    "running_balance": running_balance,
    "opening_balance": opening_balance,
    "category_totals": category_totals,
    "subcategory_totals": subcategory_totals,
    "group_movements": group_movements,
    "movement_count": movement_count,
    "top_movements": top_movements,
    "cross_table": cross_table,
    "card_cross_table": card_cross_table,
    "cross_table_wide": cross_table_wide,
    "unclassified_series": unclassified_series,
    "unclassified_movements": unclassified_movements,
    "last_n_months": last_n_months,
    "category_average": category_average,
    "top_categories": top_categories,
    "history": history,
    "category_trend": category_trend,
    "trailing_mean": trailing_mean,
    "month_vs_average": month_vs_average,
    "ledger_stats": ledger_stats,
    "bank_balance": bank_balance,
    "balance_delta": balance_delta,
    "last_known_balance": last_known_balance,
    "account_summary": account_summary,
    "balance_for_month": balance_for_month,
    "review_count": review_count,
    "active_years": active_years,
    "account_accumulated": account_accumulated,
    "period_summary": period_summary,
    "non_empty_series": non_empty_series,
    "valid_dates": valid_dates,
}
