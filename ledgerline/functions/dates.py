"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.constants import MONTH_ABBR, SERIAL_DATE_EPOCH, SERIAL_DATE_HIGH, SERIAL_DATE_LOW
from ledgerline.functions.text import strip

# text forms accepted per row, day first unless the year leads; each is tried per row
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d")
TWO_DIGIT_YEAR_FORMATS = ("d/M/yy", "d-M-yy", "d.M.yy")
TWO_DIGIT_YEAR_PIVOT = 2069         # 69..99 are 1969..1999


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c) -> Column:
    """P5: day-first text, with or without a time of day; else a spreadsheet serial number
    20000 < n < 80000 (day 0 = 1899-12-30); else null.

    The usual form is tried first.  The others are the body of a lambda, so they are worked out only where it fails and stay
    out of the generated code, which they made too large to be compiled."""
    s = strip(_c(c).cast("string"))
    return F.coalesce(F.try_to_date(s, DAY_FIRST_FORMATS[0]), F.transform(F.array(s), _other_date)[0])


def _other_date(s: Column) -> Column:
    """P5 of a trimmed text in any of its forms."""
    day = F.regexp_replace(s, r"[ T]+\d{1,2}:\d{2}.*$", "")
    full = F.coalesce(*[F.try_to_date(day, fmt) for fmt in DAY_FIRST_FORMATS])
    short = F.coalesce(*[F.try_to_date(day, fmt) for fmt in TWO_DIGIT_YEAR_FORMATS])
    short = F.when(F.year(short) >= TWO_DIGIT_YEAR_PIVOT, F.add_months(short, -1200)).otherwise(short)
    text = F.coalesce(full, short)
    n = s.try_cast("double")
    serial = F.when((n > SERIAL_DATE_LOW) & (n < SERIAL_DATE_HIGH),
                    F.date_add(F.lit(SERIAL_DATE_EPOCH).cast("date"), F.floor(n).cast("int")))
    return F.coalesce(text, serial)


def month_key(c="date") -> Column:
    """Month as 'yyyy-MM' text."""
    return F.date_format(_c(c), "yyyy-MM")


def month_label(month="month") -> Column:
    """P9: 'yyyy-MM' → 'Ene 25' (month abbreviation + two-digit year); not locale dependent."""
    m = _c(month)
    names = F.array(*[F.lit(x) for x in MONTH_ABBR])
    return F.concat(F.element_at(names, F.substring(m, 6, 2).cast("int")), F.lit(" "), F.substring(m, 3, 2))


def month_number(month="month") -> Column:
    """year·12 + month, for ordering months as integers (tie-breaks toward later months)."""
    m = _c(month)
    return F.substring(m, 1, 4).cast("int") * 12 + F.substring(m, 6, 2).cast("int")
