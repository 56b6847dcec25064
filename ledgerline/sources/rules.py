"""Rule table loader (S4) with the priority rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import clean_num, clean_text

RULE_COLUMNS = ("priority", "ord", "pattern", "lo", "hi", "category", "subcategory", "origin", "kind", "spec", "outs")


def load_rules(raw: DataFrame) -> DataFrame:
    """Clean and rank a rule sheet ``(ord, pattern, lo, hi, category, subcategory, origin, kind)``.

    Rows without category, or with neither text nor amount, are dropped; the pattern is
    upper-cased (not normalised).  ``priority`` (W11): more conditions first, then more filled
    outputs (sub + origin + kind), then longer pattern, then sheet order.

    The rank is a window over the whole rule table: rule sheets are a small, user-edited
    parameter (their size is checked before they are inlined or broadcast by ``classify``).
    """
    cols = set(raw.columns)

    def opt_text(c):
        return clean_text(c) if c in cols else F.lit("")

    r = raw.select(
        F.col("ord").cast("int").alias("ord"),
        F.upper(clean_text("pattern")).alias("pattern"),
        clean_num("lo").alias("lo"), clean_num("hi").alias("hi"),
        clean_text("category").alias("category"), opt_text("subcategory").alias("subcategory"),
        opt_text("origin").alias("origin"), opt_text("kind").alias("kind"))
    has_text = F.col("pattern") != ""
    has_amount = F.col("lo").isNotNull() | F.col("hi").isNotNull()
    r = r.where((F.col("category") != "") & (has_text | has_amount))
    r = (r.withColumn("spec", has_text.cast("int") + has_amount.cast("int"))
          .withColumn("outs", (F.col("subcategory") != "").cast("int") + (F.col("origin") != "").cast("int")
                      + (F.col("kind") != "").cast("int")))
    w = Window.orderBy(F.col("spec").desc(), F.col("outs").desc(), F.length("pattern").desc(), F.col("ord"))
    return r.withColumn("priority", F.row_number().over(w)).select(*RULE_COLUMNS)
