"""Import queries (P10, J1, J1b, S3, S3b, R4, A14) over the adapter's ledger / incoming split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.labels import movement_key as movement_key_col
from ledgerline.operators import dedupe as D
from ledgerline.plans.common import by_year, finalize
from ledgerline.plans.labelling import rules
from ledgerline.session import scratch_path
from ledgerline.sources import adapter
from ledgerline.sources.ledger import append_movements as append_op
from ledgerline.sources.ledger import new_since as new_since_op
from ledgerline.sources.monthly import MonthLedger

BATCH = "import-1"


def movement_key(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.select("row_id", movement_key_col().alias("movement_key")))


def new_movements(spark, sf):
    inc = adapter.incoming_rows(spark, sf)
    return finalize(D.new_movements(inc, adapter.existing_ledger(spark, sf))
                    .select("ledger_id", "row_id", "copy_no", "file_no"))


def first_file_wins(spark, sf):
    return finalize(D.first_file_wins(adapter.incoming_rows(spark, sf)).select("ledger_id", "row_id", "copy_no", "file_no"))


def _imported(spark, sf):
    inc = adapter.incoming_rows(spark, sf)
    return inc, D.import_statements(inc, adapter.existing_ledger(spark, sf), rules(spark, sf), BATCH)


def import_statements(spark, sf):
    _, imp = _imported(spark, sf)
    return finalize(imp.drop("file_no"))


def import_summary(spark, sf):
    inc, imp = _imported(spark, sf)
    return finalize(D.import_summary(inc, imp))


def append_movements(spark, sf):
    """S3 projection of the imported rows (no write here; ``append_movements(path=...)`` writes)."""
    _, imp = _imported(spark, sf)
    rows, _ = append_op(imp)
    return finalize(rows)


def month_ledger(spark, sf):
    """S3 by month: the ledger appended in batches by year, one of them twice, then merged; an import that reads only the
    months of its batch; its rows appended.  Rows and sums of each ledger, batch and month as they are read back."""
    old = adapter.existing_ledger(spark, sf).withColumn("batch_id", F.concat(F.lit("y"), F.year("date").cast("string")))
    store = MonthLedger(spark, scratch_path(spark, "month-ledger"), buckets=2)
    years = by_year(old)
    first, last = years.agg(F.min("_year"), F.max("_year")).first()
    for year in range(first or 0, (last or -1) + 1):
        store.append(years.where(F.col("_year") == year), f"y{year}")
    if first:
        store.append(years.where(F.col("_year") == first), f"y{first}")
    store.compact(fan_in=2)
    store.append(D.import_statements(adapter.incoming_rows(spark, sf), store, rules(spark, sf), BATCH), BATCH)
    rows = store.read().groupBy("ledger_id", "batch_id", F.year("date").alias("year"), F.month("date").alias("month"))
    return finalize(rows.agg(F.count(F.lit(1)).alias("n"), F.sum("debit").alias("debit"), F.sum("credit").alias("credit"),
                             F.count_if("review").alias("n_review")))


def new_since(spark, sf):
    return finalize(new_since_op(adapter.movements(spark, sf)).select("ledger_id", "row_id", "batch_id"))


QUERIES = {
    "movement_key": movement_key,
    "new_movements": new_movements,
    "first_file_wins": first_file_wins,
    "import_statements": import_statements,
    "import_summary": import_summary,
    "append_movements": append_movements,
    "month_ledger": month_ledger,
    "new_since": new_since,
}
