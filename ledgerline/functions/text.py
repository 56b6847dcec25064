"""Text column functions (P1, P6, P7, P14, P15, P16). All native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.constants import BLANK_TEXTS, MINING_STOP_WORDS, MODEL_STOP_WORDS


# rule bounds: wider and finer than money, so no bound is rounded or lost
BOUND = "decimal(38,10)"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# white space of Unicode, as a character set for trimming: statements hold no-break spaces
WHITE_SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c) -> Column:
    """Trim Unicode white space at both ends."""
    return F.trim(_c(c), F.lit(WHITE_SPACE))


def norm_header(c) -> Column:
    """Lower, trim, strip the five accented vowels, keep only [a-z0-9]."""
    s = F.translate(F.lower(strip(c)), "áéíóú", "aeiou")
    return F.regexp_replace(s, "[^a-z0-9]", "")


def norm_concept(c, upper: bool = True) -> Column:
    """Upper; ``. * - /`` and digit runs become spaces; spaces collapsed; trimmed."""
    s = F.coalesce(_c(c).cast("string"), F.lit(""))
    if upper:
        s = F.upper(s)
    # punctuation → space, then every run of digits and whitespace → one space: the same text as
    # replacing digit runs and collapsing spaces in two passes, with one regex instead of three
    s = F.translate(s, ".*-/", "    ")
    s = F.regexp_replace(s, r"(?U)[\d\s]+", " ")
    return F.trim(s)


def tokens(normalised, stop_words=MINING_STOP_WORDS, min_len: int = 3) -> Column:
    """Split a normalised text on spaces, drop stop words and tokens shorter than ``min_len``."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.filter(F.split(_c(normalised), " "),
                    lambda t: (F.length(t) >= min_len) & ~F.array_contains(stop, t))


def clean_text(c) -> Column:
    """Null / 'nan' / 'none' (any case) become the empty string; trimmed."""
    s = strip(F.coalesce(_c(c).cast("string"), F.lit("")))
    return F.when(F.lower(s).isin(*BLANK_TEXTS), F.lit("")).otherwise(s)


def clean_num(c, default=None) -> Column:
    """Non-numeric text becomes ``default`` (null for rules, 0 for reclassify)."""
    v = strip(_c(c).cast("string")).try_cast(BOUND)
    return v if default is None else F.coalesce(v, F.lit(default).cast(BOUND))


def model_text(*cols, stop_words=MODEL_STOP_WORDS) -> Column:
    """Join the text fields with spaces, normalise (P6) and keep model tokens."""
    joined = F.concat_ws(" ", *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])
    return F.array_join(tokens(norm_concept(joined), stop_words), " ")


def truncate(c, n: int) -> Column:
    """First ``n`` characters, for display."""
    return F.substring(F.coalesce(_c(c), F.lit("")), 1, n)
