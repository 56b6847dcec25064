"""Labeller queries (M1, M2, M2b) over the adapter ledger: rows with a blank category need a label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import model as MD
from ledgerline.operators.kept_model import KeptLabeller
from ledgerline.plans.common import by_year, finalize
from ledgerline.session import scratch_path
from ledgerline.sources import adapter


def nb_labeller(spark, sf):
    return finalize(MD.nb_labeller(adapter.movements(spark, sf)))


def nb_kept(spark, sf):
    """M2b kept: learned year by year, one year twice, early years added up; then it scores the whole ledger."""
    mv = adapter.movements(spark, sf)
    model = KeptLabeller(spark, scratch_path(spark, "labeller"))
    mv = by_year(mv.select("row_id", "date", "category", "debit", "credit", *MD.TEXT_COLS))
    first, last = mv.agg(F.min("_year"), F.max("_year")).first()
    for year in [*range(first or 0, (last or -1) + 1), first or 0]:
        model.learn(mv.where(F.col("_year") == year), f"y{year}")
    model.compact(fan_in=2, keep=(f"y{last}",))
    return finalize(model.suggest(mv))


def suggest_labels(spark, sf):
    """M1 + M2: fit the calibrated machines on labelled rows, suggest for the others."""
    mv = adapter.movements(spark, sf)
    model = MD.train_labeller(mv)
    return finalize(MD.suggest_labels(model, mv))


QUERIES = {
    "nb_labeller": nb_labeller,
    "nb_kept": nb_kept,
    "suggest_labels": suggest_labels,
}
