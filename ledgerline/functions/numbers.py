"""Money column functions (P3, P4, P8, P13, P18) and exact rounding helpers.

Money is DECIMAL(18,2) everywhere: sums are exact and order independent.  Results
are cast to double only in the last projection.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.constants import VS_AVG_BAD, VS_AVG_BAR_CAP, VS_AVG_WARN
from ledgerline.functions.text import strip

MONEY = "decimal(18,2)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero() -> Column:
    return F.lit(0).cast(MONEY)


def zero_if_null(c) -> Column:
    return F.coalesce(_c(c), F.lit(0).cast(MONEY))


def signed_amount(credit="credit", debit="debit") -> Column:
    """Credit − debit, a missing side counts as 0."""
    return (zero_if_null(credit) - zero_if_null(debit)).cast("decimal(19,2)")


def abs_amount(debit="debit", credit="credit") -> Column:
    """max(|debit|, |credit|), null as 0."""
    return F.greatest(F.abs(zero_if_null(debit)), F.abs(zero_if_null(credit)))


def parse_bank_amount(c, signed: bool = False) -> Column:
    """Keep digits , . ; comma becomes dot; blank means 0; unparseable is null (row rejected).

    By default the sign is lost, as in the statement reader this reproduces; ``signed=True`` keeps
    a leading minus.
    """
    text = F.coalesce(_c(c).cast("string"), F.lit(""))
    kept = F.regexp_replace(text, r"[^0-9,.]", "")
    dotted = F.regexp_replace(kept, ",", ".")
    value = F.when(dotted == "", F.lit(0).cast(MONEY)).otherwise(dotted.try_cast(MONEY))
    if signed:
        value = F.when(F.trim(text).startswith("-"), -value).otherwise(value)
    return value


def parse_amount_es(c) -> Column:
    """A number passes through; Spanish-formatted text: drop '.', comma becomes dot; failure means 0."""
    s = strip(F.coalesce(_c(c).cast("string"), F.lit("")))
    number = F.typeof(_c(c)).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")     # folded by the optimizer
    s = F.when(number, s).otherwise(F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.coalesce(s.try_cast(MONEY), F.lit(0).cast(MONEY))


def cents(c) -> Column:
    """Exact integer cents of a 2-dp decimal."""
    return (_c(c) * 100).cast("bigint")


def int_div(a, b) -> Column:
    """Integer division of non-negative bigints (SQL ``div``), exact: (a − a mod b) / b."""
    a, b = _c(a).cast("bigint"), _c(b).cast("bigint")
    return ((a - a % b) / b).cast("bigint")


def round_ratio(num_cents, den) -> Column:
    """(num_cents / den) rounded half away from zero to cents, as double.

    Pure integer arithmetic, so every engine gives the same bits.
    """
    n, d = _c(num_cents).cast("bigint"), _c(den).cast("bigint")
    q = int_div(F.abs(n) * 2 + d, d * 2)
    return (F.signum(n).cast("bigint") * q).cast("double") / 100


def vs_average(total, avg):
    """ratio = total/avg (0 if avg ≤ 0); status ok ≤ 1 < warn ≤ 1.2 < bad; bar = min(ratio,1.5)/1.5·100."""
    t, a = _c(total).cast("double"), _c(avg).cast("double")
    ratio = F.when(a > 0, t / a).otherwise(F.lit(0.0))
    status = F.when(ratio > VS_AVG_BAD, "bad").when(ratio > VS_AVG_WARN, "warn").otherwise("ok")
    bar = F.least(ratio, F.lit(VS_AVG_BAR_CAP)) / VS_AVG_BAR_CAP * 100
    return ratio, status, bar
