"""Ledger maintenance: reclassify (R2) with change counts (A12) and log, rebuild from legacy
labels (R3), label validation (J9).

Nothing is rewritten in place: an applied change is a new table version written next to the old one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.constants import CHANGE_EXAMPLE_CHARS, CHANGE_EXAMPLES, KINDS, ORIGINS, UNCLASSIFIED
from ledgerline.functions.labels import recode_category
from ledgerline.functions.predicates import from_year, is_marker_kind, valid_date
from ledgerline.functions.text import clean_text, truncate
from ledgerline.operators.classify import classify
from ledgerline.session import materialize
from ledgerline.sources.versions import Versions

FIELDS = ("category", "subcategory", "origin", "kind")


def reclassify(ledger: DataFrame, rules: DataFrame, year: int) -> DataFrame:
    """R2: rows of ``year`` on are labelled again (J2).  No match ⇒ untouched; the category is set
    when it differs; sub / origin / kind only when the rule gives one and it differs.
    Output: the rows of the year on with old and new values and per-field change flags."""
    rows = ledger.where(from_year("date", year))
    for f in FIELDS:
        rows = rows.withColumn(f"old_{f}", clean_text(f))
    rows = rows.withColumn("concept", clean_text("concept"))
    c = classify(rows, rules)
    matched = F.col("new_category") != UNCLASSIFIED
    out = c.withColumn("matched", matched)
    for f in FIELDS:
        new, old = F.col(f"new_{f}"), F.col(f"old_{f}")
        if f == "category":
            changed = matched & (old != new)
        else:
            changed = matched & (new != "") & (old != new)
        out = out.withColumn(f"{f}_changed", changed).withColumn(f, F.when(changed, new).otherwise(old))
    return out.select("ledger_id", "row_id", "date", "concept", "matched", *FIELDS,
                      *[f"old_{f}" for f in FIELDS], *[f"{f}_changed" for f in FIELDS])


def reclassified_ledger(ledger: DataFrame, rules: DataFrame, year: int, path: str | None = None) -> DataFrame:
    """R2 applied: the whole ledger as a new version — rows before ``year`` as they are, the others with the labels
    that ``reclassify`` gives, every column kept.  With ``path`` the version is written there (never over the
    ledger it reads) and read back."""
    after = F.coalesce(from_year("date", year), F.lit(False))
    old = ledger.where(~after)
    # cleaned in a step of their own: inside the rule chain's they make a method that the JVM does not compile
    rows = ledger.where(after).withColumns({"_concept": clean_text("concept"), **{f"_own_{f}": clean_text(f) for f in FIELDS}})
    rows = classify(rows, rules, concept="_concept")
    matched = F.col("new_category") != UNCLASSIFIED
    for f in FIELDS:
        new, own = F.col(f"new_{f}"), F.col(f"_own_{f}")
        take = matched & (own != new) & (F.lit(True) if f == "category" else new != "")
        rows = rows.withColumn(f, F.when(take, new).otherwise(own))
    out = old.unionByName(rows.select(*ledger.columns))
    if path is None:
        return out
    out.write.mode("errorifexists").parquet(path)
    return ledger.sparkSession.read.parquet(path)


def apply_reclassification(versions: Versions, rules: DataFrame, year: int, name: str) -> DataFrame:
    """R2 applied to the current version of a ledger and published as version ``name``, which is then current."""
    versions.publish(reclassified_ledger(versions.read(), rules, year), name)
    return versions.read(name)


def first_changes(reclassified: DataFrame, n: int) -> DataFrame:
    """The first ``n`` changed rows by date and row id.  Changed rows sort first and the others are dropped after the limit:
    a filter on the flags would move below the rule chain and repeat it, with the normalised concept, in every flag."""
    any_change = F.col(f"{FIELDS[0]}_changed")
    for f in FIELDS[1:]:
        any_change = any_change | F.col(f"{f}_changed")
    return reclassified.withColumn("_any", any_change).orderBy(F.col("_any").desc(), "date", "row_id").limit(n).where("_any").drop("_any")


def change_examples(reclassified: DataFrame, n: int = CHANGE_EXAMPLES) -> DataFrame:
    """The first ``n`` changed rows by date and row id, with 35 characters of the concept and the changes as text."""
    # the n rows are written first: with a long rule chain the texts below would repeat its code in one method
    first = materialize(first_changes(reclassified, n))
    texts = [F.when(F.col(f"{f}_changed"), F.concat(F.lit(f"{f}: '"), F.col(f"old_{f}"), F.lit("' -> '"), F.col(f), F.lit("'"))) for f in FIELDS]
    return first.select("ledger_id", "row_id", "date", truncate("concept", CHANGE_EXAMPLE_CHARS).alias("concept"),
                        F.concat_ws("; ", *texts).alias("changes"))


def change_counts(reclassified: DataFrame) -> DataFrame:
    """Rows seen, matched, untouched, changed category / sub / origin / kind."""
    return reclassified.agg(
        F.count(F.lit(1)).alias("rows_seen"), F.count_if("matched").alias("matched"),
        F.count_if(~F.col("matched")).alias("untouched"),
        *[F.count_if(f"{f}_changed").alias(f"{f}_changed") for f in FIELDS])


def change_log(reclassified: DataFrame) -> DataFrame:
    """The per-field change report: one row per changed (row, field) with old and new value."""
    stacked = reclassified.select(
        "ledger_id", "row_id",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").alias("old_value"),
                                     F.col(f).alias("new_value"), F.col(f"{f}_changed").alias("changed"))
                            for f in FIELDS])).alias("c"))
    return (stacked.where(F.col("c.changed"))
                   .select("ledger_id", "row_id", "c.field", "c.old_value", "c.new_value"))


def rebuild_ledger(legacy: DataFrame, rules: DataFrame, recode: DataFrame, cutover: int,
                   min_year: int | None = None, use_rules: bool = True) -> DataFrame:
    """Legacy rows (``label``/``label2``) → ledger rows.  Dated rows only (F2), marker kinds
    dropped (F3).  From the cut-over year on (when ``use_rules``): a label in the recode map is
    translated (P11 'rebuild': map sub wins, else old sub); another label is kept; no label ⇒ rule
    labels (J2, with amounts) and the review flag.  Before it, labels are kept."""
    rows = legacy.where(valid_date("date", min_year) & ~is_marker_kind("kind"))
    rows = (rows.withColumn("label", clean_text("label")).withColumn("label2", clean_text("label2"))
                .withColumn("kind", clean_text("kind")).withColumn("origin", clean_text("origin")))
    after = from_year("date", cutover) if use_rules else F.lit(False)
    rows = recode_category(rows.withColumn("_cat", F.col("label")).withColumn("_sub", F.col("label2")),
                           recode, "rebuild", label="_cat", sub="_sub", hit_col="_mapped")
    blank = F.col("label") == ""
    # only rows whose label comes from the rules have a concept here: the others are not normalised and meet no rule
    labelled = classify(rows.withColumn("_concept", F.when(after & blank, F.col("concept"))), rules, concept="_concept")
    cat = (F.when(after & F.col("_mapped"), F.col("_cat"))
            .when(after & blank, F.col("new_category")).otherwise(F.col("label")))
    sub = (F.when(after & F.col("_mapped"), F.col("_sub"))
            .when(after & blank, F.col("new_subcategory")).otherwise(F.col("label2")))
    review = after & blank & (F.col("new_category") == UNCLASSIFIED)
    return labelled.select("ledger_id", "row_id", "kind", "origin", cat.alias("category"), sub.alias("subcategory"),
                           "date", "concept", "debit", "credit", "bank_balance", review.alias("review"),
                           *[(F.coalesce(F.col(c), F.lit("")) if c in legacy.columns else F.lit("")).alias(c)
                             for c in ("reference", "destination")])


def invalid_labels(ledger: DataFrame, taxonomy: DataFrame, strict: bool = False) -> DataFrame:
    """Rows whose category is not in the taxonomy, whose subcategory is not in the flat
    subcategory list (or, ``strict``, not in its category's list), or whose origin / kind is not
    one of the two allowed values (blank allowed, as in a dropdown)."""
    cats = taxonomy.select(F.col("category").alias("_tc"), F.col("subcategories").alias("_subs"))
    flat = taxonomy.select(F.explode("subcategories").alias("_fs")).distinct()
    j = ledger.join(cats, F.col("category") == F.col("_tc"), "left")
    j = j.join(flat, F.col("subcategory") == F.col("_fs"), "left")
    bad_cat = (F.col("category") != "") & F.col("_tc").isNull()
    if strict:
        bad_sub = (F.col("subcategory") != "") & ~F.coalesce(F.array_contains("_subs", F.col("subcategory")), F.lit(False))
    else:
        bad_sub = (F.col("subcategory") != "") & F.col("_fs").isNull()
    bad_origin = (F.col("origin") != "") & ~F.col("origin").isin(*ORIGINS)
    bad_kind = (F.col("kind") != "") & ~F.col("kind").isin(*KINDS)
    return (j.select("ledger_id", "row_id", bad_cat.alias("bad_category"), bad_sub.alias("bad_subcategory"),
                     bad_origin.alias("bad_origin"), bad_kind.alias("bad_kind"))
             .where(F.col("bad_category") | F.col("bad_subcategory") | F.col("bad_origin") | F.col("bad_kind")))
