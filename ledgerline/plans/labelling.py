"""Rule-labelling queries (S4, J2, J2b, A10, P13) over the adapter ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.numbers import abs_amount as abs_amount_col
from ledgerline.operators import classify as C
from ledgerline.plans.common import finalize
from ledgerline.sources import adapter
from ledgerline.sources.rules import load_rules as load_rules_op


def rules(spark, sf):
    return load_rules_op(adapter.raw_rules(spark, sf))


def _classified(spark, sf, strategy="case"):
    mv = adapter.movements(spark, sf).select("ledger_id", "row_id", "concept", "debit", "credit")
    return C.classify(mv, rules(spark, sf), strategy=strategy)


def _labels(df):
    return finalize(df.select("ledger_id", "row_id", *C.OUT))


def load_rules(spark, sf):
    return finalize(rules(spark, sf))


def classify(spark, sf):
    return _labels(_classified(spark, sf, "case"))


def classify_join(spark, sf):
    return _labels(_classified(spark, sf, "join"))


def classify_index(spark, sf):
    return _labels(_classified(spark, sf, "index"))


def classify_distinct(spark, sf):
    return _labels(_classified(spark, sf, "distinct"))


def amount_rules(spark, sf):
    """One amount-only rule for each part: from its price to a width by its key; some are open at one end."""
    part = spark.read.parquet(f"{sf}/part.parquet")
    price, width = F.col("p_retailprice").cast("decimal(18,2)"), (F.col("p_partkey") % 97 * 3).cast("decimal(18,2)")
    return load_rules_op(part.select(
        F.col("p_partkey").cast("int").alias("ord"), F.lit("").alias("pattern"),
        F.when(F.col("p_partkey") % 211 != 0, (price * 20).cast("string")).alias("lo"),
        F.when(F.col("p_partkey") % 307 != 0, (price * 20 + width).cast("string")).alias("hi"),
        F.concat(F.lit("Rango "), F.col("p_partkey").cast("string")).alias("category"),
        F.when(F.col("p_partkey") % 5 == 0, "s").otherwise("").alias("subcategory"), F.lit("").alias("origin"), F.lit("").alias("kind")))


def classify_amounts(spark, sf):
    """J2 with as many amount-only rules as there are parts."""
    mv = adapter.movements(spark, sf).select("ledger_id", "row_id", "concept", "debit", "credit")
    return _labels(C.classify(mv, amount_rules(spark, sf), strategy="index"))


def rule_coverage(spark, sf):
    return finalize(C.rule_coverage(_classified(spark, sf)))


def category_distribution(spark, sf):
    return finalize(C.category_distribution(_classified(spark, sf)))


def top_unclassified(spark, sf):
    """Coverage of the colour-word rules alone, so that some concepts stay unclassified."""
    mv = adapter.movements(spark, sf).select("ledger_id", "row_id", "concept", "debit", "credit")
    only_colours = load_rules_op(adapter.raw_rules(spark, sf, with_priority_rules=False))
    return finalize(C.top_unclassified(C.classify(mv, only_colours.where(~F.col("pattern").isin("RED", "BLUE")))))


def rule_specificity(spark, sf):
    return finalize(C.rule_specificity(rules(spark, sf)))


def abs_amount(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.select("row_id", abs_amount_col("debit", "credit").alias("abs_amount")))


QUERIES = {
    "load_rules": load_rules,
    "classify": classify,
    "classify_join": classify_join,
    "classify_distinct": classify_distinct,
    "classify_amounts": classify_amounts,
    "classify_index": classify_index,
    "rule_coverage": rule_coverage,
    "category_distribution": category_distribution,
    "top_unclassified": top_unclassified,
    "rule_specificity": rule_specificity,
    "abs_amount": abs_amount,
}
