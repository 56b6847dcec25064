"""Mining, migration and maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.labels import recode_category as recode_op
from ledgerline.operators import maintain as M
from ledgerline.operators import mining as G
from ledgerline.plans.common import finalize
from ledgerline.plans.labelling import rules
from ledgerline.session import materialize, scratch_path
from ledgerline.sources import adapter
from ledgerline.sources.versions import Versions


def _mining(spark, sf):
    """(labelled history, its patterns): what follows reads the patterns several times, so they are written once."""
    rows = adapter.mining_rows(spark, sf)
    return rows, materialize(G.mine_patterns(rows))


def _all_rows(spark, sf):
    return adapter.movements(spark, sf).select("row_id", "concept")


def mine_patterns(spark, sf):
    return finalize(G.mine_patterns(adapter.mining_rows(spark, sf)))


def unmatched_concepts(spark, sf):
    rows, pats = _mining(spark, sf)
    return finalize(G.tokenize(G.unmatched_concepts(rows, pats)).select("ledger_id", "row_id", "norm"))


def _summary(rows, pats):
    return G.unmatched_summary(G.tokenize(G.unmatched_concepts(rows, pats)))


def unmatched_summary(spark, sf):
    return finalize(_summary(*_mining(spark, sf)))


def pattern_example(spark, sf):
    return finalize(G.pattern_example(_all_rows(spark, sf), _mining(spark, sf)[1]))


def propose_categories(spark, sf):
    return finalize(G.propose_categories(_mining(spark, sf)[1], adapter.proposals(spark, sf), "pattern"))


def _review_patterns(spark, sf, mined):
    return G.rule_review_patterns(mined[1], _all_rows(spark, sf), adapter.proposals(spark, sf))


def _review_unmatched(spark, sf, mined):
    return G.rule_review_unmatched(_summary(*mined), adapter.proposals(spark, sf))


def rule_review_patterns(spark, sf):
    return finalize(_review_patterns(spark, sf, _mining(spark, sf)))


def rule_review_unmatched(spark, sf):
    return finalize(_review_unmatched(spark, sf, _mining(spark, sf)))


def write_rule_review(spark, sf):
    """S7 sink: the three review tables written and read back, as (sheet, key)."""
    path, mined = scratch_path(spark, "review"), _mining(spark, sf)
    G.write_rule_review(_review_patterns(spark, sf, mined), _review_unmatched(spark, sf, mined), _taxonomy(spark, sf), path)
    keys = {"patterns": "pattern", "unmatched": "norm_concept", "categories": "category"}
    parts = [spark.read.parquet(f"{path}/{s}").select(F.lit(s).alias("sheet"), F.col(k).alias("key")) for s, k in keys.items()]
    return finalize(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def _old_sheets(spark, sf):
    mined = _mining(spark, sf)
    pats = _review_patterns(spark, sf, mined).select(
        "pattern", F.col("proposed_category").alias("category"), F.col("proposed_subcategory").alias("subcategory"))
    unm = _review_unmatched(spark, sf, mined).select(
        "norm_concept", F.col("proposed_category").alias("category"), F.col("proposed_subcategory").alias("subcategory"))
    return pats, unm


def union_rules(spark, sf):
    return finalize(G.union_rules(*_old_sheets(spark, sf)))


def migrate_rules(spark, sf):
    return finalize(G.migrate_rules(*_old_sheets(spark, sf)))


def migrate_new_rules(spark, sf):
    """U1 / R1 of a sheet in the new format: amounts, origin and type are kept."""
    return finalize(G.migrate_rules(None, None, adapter.new_format_sheet(spark, sf)))


def _taxonomy(spark, sf):
    """The taxonomy of the whole ledger."""
    return G.taxonomy_from(adapter.movements(spark, sf))


def flat_subcategories(spark, sf):
    return finalize(G.flat_subcategories(_taxonomy(spark, sf)))


def category_reference(spark, sf):
    return finalize(G.category_reference(_taxonomy(spark, sf)))


def _legacy(spark, sf):
    return adapter.legacy_movements(spark, sf)


def recode_any_year(spark, sf):
    """P11 policy (c): rows of every year, the map sub fills a blank sub (before training)."""
    lg = _legacy(spark, sf).withColumn("category", F.col("label")).withColumn("subcategory", F.col("label2"))
    return finalize(recode_op(lg, adapter.recode_table(spark), "any").select("row_id", "category", "subcategory"))


def recode_category(spark, sf):
    """P11 policy (a): before the cut-over year, map sub only fills a blank sub."""
    df = _legacy(spark, sf).select("row_id", "date", F.col("label").alias("category"), F.col("label2").alias("subcategory"))
    return finalize(recode_op(df, adapter.recode_table(spark), "fill", before_year=adapter.CUTOVER_YEAR)
                    .select("row_id", "category", "subcategory"))


def recode_rebuild(spark, sf):
    """P11 policy (b): a non-blank map sub wins over the old sub, all rows."""
    df = _legacy(spark, sf).select("row_id", "date", F.col("label").alias("category"), F.col("label2").alias("subcategory"))
    return finalize(recode_op(df, adapter.recode_table(spark), "rebuild").select("row_id", "category", "subcategory"))


def _reclassified(spark, sf):
    return M.reclassify(adapter.movements(spark, sf), rules(spark, sf), adapter.CUTOVER_YEAR)


def reclassify(spark, sf):
    return finalize(_reclassified(spark, sf).drop("concept", "date"))


def reclassified_ledger(spark, sf):
    """R2 applied: a full new version of the ledger, written and read back."""
    out = M.reclassified_ledger(adapter.movements(spark, sf), rules(spark, sf), adapter.CUTOVER_YEAR, scratch_path(spark, "version"))
    return finalize(out.select("ledger_id", "row_id", "date", "concept", "debit", "credit", *M.FIELDS))


def ledger_versions(spark, sf):
    """R2 as versions: the ledger, its reclassification, one of all years, and the way back to the first change; the
    current version's rows."""
    versions = Versions(spark, scratch_path(spark, "versions"))
    versions.publish(adapter.movements(spark, sf), "initial")
    M.apply_reclassification(versions, rules(spark, sf), adapter.CUTOVER_YEAR, "reclassified")
    M.apply_reclassification(versions, rules(spark, sf), adapter.FIRST_YEAR, "all-years")
    versions.roll_back()
    return finalize(versions.read().select("ledger_id", "row_id", "date", "concept", "debit", "credit", *M.FIELDS))


def change_examples(spark, sf):
    return finalize(M.change_examples(_reclassified(spark, sf)))


def change_counts(spark, sf):
    return finalize(M.change_counts(_reclassified(spark, sf)))


def change_log(spark, sf):
    return finalize(M.change_log(_reclassified(spark, sf)))


def _rebuilt(spark, sf):
    return M.rebuild_ledger(_legacy(spark, sf), rules(spark, sf), adapter.recode_table(spark),
                            adapter.CUTOVER_YEAR, min_year=adapter.FIRST_YEAR)


def rebuild_ledger(spark, sf):
    return finalize(_rebuilt(spark, sf))


def invalid_labels(spark, sf):
    return finalize(M.invalid_labels(_rebuilt(spark, sf), _taxonomy(spark, sf)))


QUERIES = {
    "mine_patterns": mine_patterns,
    "unmatched_concepts": unmatched_concepts,
    "unmatched_summary": unmatched_summary,
    "pattern_example": pattern_example,
    "propose_categories": propose_categories,
    "rule_review_patterns": rule_review_patterns,
    "rule_review_unmatched": rule_review_unmatched,
    "union_rules": union_rules,
    "migrate_rules": migrate_rules,
    "migrate_new_rules": migrate_new_rules,
    "flat_subcategories": flat_subcategories,
    "category_reference": category_reference,
    "recode_category": recode_category,
    "recode_any_year": recode_any_year,
    "recode_rebuild": recode_rebuild,
    "reclassify": reclassify,
    "reclassified_ledger": reclassified_ledger,
    "ledger_versions": ledger_versions,
    "change_examples": change_examples,
    "write_rule_review": write_rule_review,
    "change_counts": change_counts,
    "change_log": change_log,
    "rebuild_ledger": rebuild_ledger,
    "invalid_labels": invalid_labels,
}
