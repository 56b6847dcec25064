"""Label column functions: flow class (P12), movement key (P10), recode policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.constants import DEFAULT_INCOME_CATEGORIES, DEFAULT_SYSTEM_CATEGORIES, INCOME_KIND
from ledgerline.functions.text import strip


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flow_class(kind="kind", category="category",
               income=DEFAULT_INCOME_CATEGORIES, system=DEFAULT_SYSTEM_CATEGORIES) -> Column:
    """System category ⇒ null; kind 'Ingresos' ⇒ income; blank kind and income category ⇒ income;
    anything else (any other kind) ⇒ expense."""
    k, cat = strip(F.coalesce(_c(kind), F.lit(""))), _c(category)
    return (F.when(cat.isin(*system), F.lit(None).cast("string"))
            .when((k == INCOME_KIND) | ((k == "") & cat.isin(*income)), F.lit("income"))
            .when(cat != "", F.lit("expense")))


def movement_key(date="date", concept="concept", debit="debit", credit="credit") -> Column:
    """P10: first 12 hex of md5('date|UPPER(TRIM(concept))|debit|credit'), null amounts as 0.00.

    The text is built from DECIMAL(18,2) values, so it is identical in every engine.
    """
    z = F.lit(0).cast("decimal(18,2)")
    parts = [_c(date).cast("date").cast("string"),
             F.upper(strip(F.coalesce(_c(concept), F.lit("")))),
             F.coalesce(_c(debit).cast("decimal(18,2)"), z).cast("string"),
             F.coalesce(_c(credit).cast("decimal(18,2)"), z).cast("string")]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)


def recode_category(df: DataFrame, recode: DataFrame, policy: str, label="category", sub="subcategory",
                    before_year: int | None = None, hit_col: str | None = None) -> DataFrame:
    """Legacy label → (category, subcategory) through a recode table ``(old, new, sub)``.

    policy ``fill``   — map sub only fills a blank sub (optionally only for rows before ``before_year``);
    policy ``rebuild`` — a non-blank map sub wins, else the old sub is kept.
    policy ``any``    — as ``fill``, for rows of every year.
    Labels absent from the map are kept.  The recode table is a lookup with one entry per ``old``: of
    several the smallest (new, sub) counts, so no row is multiplied.  Spark broadcasts it by size.
    ``hit_col`` names a column to keep that says whether the label was in the map.
    """
    r = recode_map(recode)
    j = df.join(r, _c(label) == F.col("_old"), "left")
    hit = F.col("_old").isNotNull()
    if before_year is not None and policy != "any":
        hit = hit & (F.year("date") < before_year)
    old_sub = F.coalesce(_c(sub), F.lit(""))
    if policy in ("fill", "any"):
        new_sub = F.when(hit & (F.col("_msub") != "") & (old_sub == ""), F.col("_msub")).otherwise(old_sub)
    elif policy == "rebuild":
        new_sub = F.when(hit & (F.col("_msub") != ""), F.col("_msub")).otherwise(old_sub)
    else:
        raise ValueError(policy)
    new_cat = F.when(hit, F.col("_new")).otherwise(_c(label))
    j = j if hit_col is None else j.withColumn(hit_col, F.col("_old").isNotNull())
    return (j.withColumn(label, new_cat).withColumn(sub, new_sub)
            .drop("_old", "_new", "_msub"))


def recode_map(recode: DataFrame) -> DataFrame:
    """One row per old label: _old, _new, _msub."""
    entry = F.min(F.struct(F.col("new").alias("n"), F.coalesce(F.col("sub"), F.lit("")).alias("s"))).alias("e")
    return (recode.where(F.col("old").isNotNull()).groupBy(F.col("old").alias("_old")).agg(entry)
            .select("_old", F.col("e.n").alias("_new"), F.col("e.s").alias("_msub")))
