"""Balances (W1, W2, W3, W8, W9, J10, J11).

All windows run on (ledger, month) aggregates: one row per ledger-month, so a window partition
holds at most the ledger's months however many movements it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numbers import zero

from ledgerline.constants import EXCLUDED_FROM_BALANCE
from ledgerline.functions.dates import month_label

_U = Window.unboundedPreceding
_F = Window.unboundedFollowing


def _by_ledger():
    return Window.partitionBy("ledger_id").orderBy("month")


def running_balance(led: DataFrame, opening: DataFrame | None = None,
                    excluded: str = EXCLUDED_FROM_BALANCE) -> DataFrame:
    """W1 + W2: closing[m] = opening balance + running Σ amount (category 'No va' excluded only);
    opening[m] = closing[m−1].  Months come from all rows, so a month of only excluded rows is flat."""
    m = (led.groupBy("ledger_id", "month")
            .agg(F.coalesce(F.sum(F.when(F.col("category") != excluded, F.col("amount"))), zero()).alias("net")))
    return balance_from_net(m, opening).select("ledger_id", "month", "opening", "closing", "net")


def balance_from_net(m: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """W1 on a (ledger, month, net, ...) aggregate: keeps its columns, adds opening and closing."""
    if opening is not None:
        m = m.join(opening.select("ledger_id", F.col("opening").alias("_open")), "ledger_id", "left")
    else:
        m = m.withColumn("_open", zero())
    closing = F.coalesce(F.col("_open"), zero()) + F.sum("net").over(_by_ledger().rowsBetween(_U, 0))
    return (m.withColumn("closing", closing)
             .withColumn("opening", F.col("closing") - F.col("net")).drop("_open"))


def bank_balance(led: DataFrame, origin: str | None = None, zero_is_unknown: bool = True) -> DataFrame:
    """closing = bank balance on the month's last movement (by date, then row_id); a missing
    (or 0) balance is unknown ⇒ previous closing + month net; the first known month opens at
    closing − net; leading unknown months stay null.

    The recurrence is a gap reset: ``seg`` = number of known months so far; inside a segment
    closing = anchor balance + Σ net after the anchor month.
    """
    rows = led if origin is None else led.where(F.col("origin") == origin)
    m = (rows.groupBy("ledger_id", "month")
             .agg(F.sum("amount").alias("net"),
                  F.max_by("bank_balance", F.struct("date", "row_id")).alias("_last")))
    return bank_balance_from(m, zero_is_unknown)


def bank_balance_from(m: DataFrame, zero_is_unknown: bool = True) -> DataFrame:
    """W3's recurrence on a (ledger_id, month, net, _last) month aggregate, ``_last`` being the
    bank balance on the month's last movement.  A column ``_anchor`` holds the ledger's closing before its first
    month here (null: unknown)."""
    anchor = F.col("_anchor") if "_anchor" in m.columns else F.lit(None).cast("decimal(38,2)")
    known = F.nullif(F.col("_last"), zero()) if zero_is_unknown else F.col("_last")
    m = m.withColumn("_known", known).withColumn(
        "_seg", F.count("_known").over(_by_ledger().rowsBetween(_U, 0)))
    seg_w = Window.partitionBy("ledger_id", "_seg").orderBy("month")
    closing = F.when(
        F.col("_seg") > 0,
        F.first("_known").over(seg_w.rowsBetween(_U, _F))
        + F.sum("net").over(seg_w.rowsBetween(_U, 0))
        - F.first("net").over(seg_w.rowsBetween(_U, _F))).otherwise(anchor + F.sum("net").over(seg_w.rowsBetween(_U, 0)))
    m = m.withColumn("closing", closing)
    prev = F.coalesce(F.lag("closing").over(_by_ledger()), anchor)
    opening = F.when(prev.isNull() & F.col("closing").isNotNull(), F.col("closing") - F.col("net")).otherwise(prev)
    return m.withColumn("opening", opening).select("ledger_id", "month", "opening", "closing", "net")


def balance_delta(balances: DataFrame) -> DataFrame:
    """Closing − previous closing with the previous month's label; blank for the first and the
    last month of the ledger."""
    w = _by_ledger()
    prev_close, prev_month = F.lag("closing").over(w), F.lag("month").over(w)
    is_last = F.lead("month").over(w).isNull()
    ok = prev_close.isNotNull() & F.col("closing").isNotNull() & ~is_last
    return balances.select(
        "ledger_id", "month",
        F.when(ok, F.col("closing") - prev_close).alias("delta"),
        F.when(ok, month_label(prev_month)).alias("prev_label"))


def last_known_balance(balances: DataFrame) -> DataFrame:
    """Latest non-null closing at or before each month."""
    return balances.select("ledger_id", "month",
                           F.last("closing", ignorenulls=True).over(_by_ledger().rowsBetween(_U, 0))
                           .alias("last_known"))


def account_summary(months: DataFrame, balances: DataFrame) -> DataFrame:
    """Month income, expense and closing balance (A1 ⋈ W3 on ledger, month)."""
    return (months.select("ledger_id", "month", "label", "income_total", "expense_total")
            .join(balances.select("ledger_id", "month", F.col("closing").alias("balance")),
                  ["ledger_id", "month"], "left"))


def balance_for_month(balances: DataFrame) -> DataFrame:
    """The month's closing balance, else the ledger's last known one (latest non-null overall)."""
    latest = F.last("closing", ignorenulls=True).over(_by_ledger().rowsBetween(_U, _F))
    return balances.select(
        "ledger_id", "month",
        F.coalesce(F.col("closing"), latest).alias("balance"),
        F.col("closing").isNull().alias("is_fallback"))
