"""Row predicates (F1–F11) as Column expressions; Catalyst pushes them to the scan where it can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.constants import (BALANCE_LINE_TEXTS, NEEDS_LABEL_TEXTS, OPENING_MARKER_KINDS,
                                  TRAINING_EXCLUDED, UNCLASSIFIED)
from ledgerline.functions.text import strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_balance_line(concept="concept") -> Column:
    """F1 (negated): statement lines such as 'SALDO ANTERIOR' that are not movements."""
    return F.upper(strip(F.coalesce(_c(concept), F.lit("")))).isin(*BALANCE_LINE_TEXTS)


def valid_date(date="date", min_year: int | None = None) -> Column:
    """date present and (optionally) year ≥ min_year."""
    p = _c(date).isNotNull()
    # a range on the column itself (not year(date)) so a stored ledger's scan can push it down
    return p if min_year is None else p & (_c(date) >= F.lit(f"{min_year:04d}-01-01").cast("date"))


def is_marker_kind(kind="kind") -> Column:
    """F3 (negated): legacy opening / closing balance rows."""
    return strip(F.coalesce(_c(kind), F.lit(""))).isin(*OPENING_MARKER_KINDS)


def is_card(origin="origin") -> Column:
    """origin contains 'tarjeta', case-insensitive; null ⇒ false."""
    return F.coalesce(F.lower(_c(origin)).contains("tarjeta"), F.lit(False))


def in_period(month="month", year: str | int | None = None) -> Column:
    """months of a year ('all' / None ⇒ every month)."""
    if year is None or str(year) == "all":
        return F.lit(True)
    return _c(month).startswith(str(year))


def needs_label(category="category") -> Column:
    """blank category or NAN/NONE/SIN CLASIFICAR/PENDIENTE (case-insensitive)."""
    s = strip(F.coalesce(_c(category), F.lit("")))
    return (s == "") | F.upper(s).isin(*NEEDS_LABEL_TEXTS)


def is_training_row(category="category", excluded=TRAINING_EXCLUDED) -> Column:
    """F8: labelled and not an excluded / system label."""
    s = strip(F.coalesce(_c(category), F.lit("")))
    return (s != "") & ~s.isin(*excluded) & ~needs_label(s)


def from_year(date="date", year: int = 1999) -> Column:
    """rows of the cut-over year on (a pushable range on the date column)."""
    return _c(date) >= F.lit(f"{year:04d}-01-01").cast("date")


def is_unclassified(category="category") -> Column:
    """the exact report label 'Sin clasificar'."""
    return _c(category) == UNCLASSIFIED
