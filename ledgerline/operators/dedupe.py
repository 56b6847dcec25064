"""Import dedupe: movement identity (P10), new movements (J1), first file wins (J1b), the import
composition (R4) and its per-file summary (A14).

A movement's identity is (ledger, date, UPPER(TRIM(concept)), debit, credit) with null ≡ 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.constants import UNCLASSIFIED
from ledgerline.functions.predicates import is_balance_line
from ledgerline.functions.text import strip
from ledgerline.operators.classify import classify
from ledgerline.session import materialize

KEY = ("ledger_id", "_k_date", "_k_concept", "_k_debit", "_k_credit")


def with_key(df: DataFrame) -> DataFrame:
    z = F.lit(0).cast("decimal(18,2)")
    return (df.withColumn("_k_date", F.col("date").cast("date"))
              .withColumn("_k_concept", F.upper(strip(F.coalesce(F.col("concept"), F.lit("")))))
              .withColumn("_k_debit", F.coalesce(F.col("debit").cast("decimal(18,2)"), z))
              .withColumn("_k_credit", F.coalesce(F.col("credit").cast("decimal(18,2)"), z)))


def drop_key(df: DataFrame) -> DataFrame:
    return df.drop(*KEY[1:])


def _meets(left: DataFrame, right: DataFrame, keys, how: str) -> DataFrame:
    """Semi or anti join on ``keys``; rows without a ledger are one ledger, as in ``first_file_wins``."""
    other = right.select(*[F.col(c).alias(f"_o{c}") for c in keys])
    on = [F.col(c).eqNullSafe(F.col(f"_o{c}")) if c == "ledger_id" else F.col(c) == F.col(f"_o{c}") for c in keys]
    return left.join(other, on, how)


def _known_keys(ledger, inc: DataFrame) -> DataFrame:
    """Keys of the ledger rows that share (ledger, date) with the batch.  A ledger stored by month gives only the files of the
    batch's months and buckets.  The batch's first and last day are a range on the date column, which reaches the ledger's
    scan; a semi join on its small day set then filters the rest map-side, before a join on keys shuffles it."""
    first, last = inc.agg(F.min("_k_date"), F.max("_k_date")).first()
    if not isinstance(ledger, DataFrame):
        ledger = ledger.around(inc, "_k_date")
    rows = ledger
    if dict(ledger.dtypes)["date"] in ("date", "timestamp", "timestamp_ntz"):
        after = F.date_add(F.lit(last).cast("date"), 1)
        rows = ledger.where((F.col("date") >= F.lit(first).cast("date")) & (F.col("date") < after))
    days = inc.select("ledger_id", "_k_date").distinct()
    return _meets(with_key(rows), days, ("ledger_id", "_k_date"), "left_semi").select(*KEY)


def new_movements(incoming: DataFrame, ledger) -> DataFrame:
    """Incoming rows whose key is absent from the ledger, a DataFrame or a ``MonthLedger`` (left anti join; duplicates
    inside one file are all kept).  Spark picks broadcast or sort-merge by size; AQE splits skewed keys."""
    # the batch is read several times below (its span, its days, its keys): materialized once, in the shared folder
    inc = materialize(with_key(incoming))
    return drop_key(_meets(inc, _known_keys(ledger, inc), KEY, "left_anti"))


def _with_file(df: DataFrame, file_col: str) -> DataFrame:
    # rows without a file number come after every numbered file, as one file; rows without a ledger are one ledger
    return with_key(df).withColumn("_file", F.struct(F.col(file_col).isNull().alias("none"), F.col(file_col).alias("file")))


def _of_first_file(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose key and file are in ``first`` (KEY, _first)."""
    other = first.select(*[F.col(c).alias(f"_f{c}") for c in KEY], "_first")
    same = F.col("_file") == F.col("_first")
    for c in KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_f{c}"))
    return drop_key(rows.join(other, same, "left_semi").drop("_file"))


def first_file_wins(incoming: DataFrame, file_col: str = "file_no") -> DataFrame:
    """Files of one run are imported one after another, so a key present in several files is
    taken from the first file only (all its copies there).  The first file per key is an
    aggregate joined back — partial aggregation absorbs a hot key before the shuffle."""
    k = _with_file(incoming, file_col)
    return _of_first_file(k, k.groupBy(*KEY).agg(F.min("_file").alias("_first")))


def fresh_movements(incoming: DataFrame, ledger, file_col: str = "file_no") -> DataFrame:
    """J1b then J1, with the batch computed once: it is aggregated to its keys, the keys meet the ledger, and only
    then rows are attached."""
    inc = materialize(_with_file(incoming, file_col))
    first = inc.groupBy(*KEY).agg(F.min("_file").alias("_first"))
    return _of_first_file(inc, _meets(first, _known_keys(ledger, inc), KEY, "left_anti"))


def import_statements(statements: DataFrame, ledger, rules: DataFrame, batch_id: str,
                      file_col: str = "file_no") -> DataFrame:
    """Statements (D2) → drop balance lines (F1) → first file wins (J1b) → not yet in the
    ledger (J1) → rule labels (J2) → ledger rows (S3 form), one per movement added."""
    s = statements.where(F.col("date").isNotNull() & ~is_balance_line("concept"))
    s = s.withColumn("concept", strip(F.coalesce(F.col("concept"), F.lit(""))))
    new = fresh_movements(s, ledger, file_col)
    labelled = classify(new, rules)
    pos = lambda c: F.when(F.col(c) > 0, F.col(c))  # noqa: E731  0 / missing ⇒ null
    return labelled.select(
        "ledger_id", "row_id", F.col(file_col), F.lit(batch_id).alias("batch_id"),
        F.col("new_kind").alias("kind"), F.col("new_origin").alias("origin"),
        F.col("new_category").alias("category"), F.col("new_subcategory").alias("subcategory"),
        "date", "concept", pos("debit").alias("debit"), pos("credit").alias("credit"),
        F.when(F.col("bank_balance") != 0, F.col("bank_balance")).alias("bank_balance"),
        *[(F.coalesce(F.col(c), F.lit("")) if c in statements.columns else F.lit("")).alias(c) for c in ("reference", "destination")],
        (F.col("new_category") == UNCLASSIFIED).alias("review"))


def import_summary(statements: DataFrame, imported: DataFrame, file_col: str = "file_no") -> DataFrame:
    """Per file — rows read, added, classified, to review — plus the run total (file null) and
    the alert flag (anything to review)."""
    read = statements.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_read"))
    added = imported.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_new"),
                                           F.count_if(~F.col("review")).alias("n_classified"),
                                           F.count_if(F.col("review")).alias("n_review"))
    per_file = read.join(added, file_col, "left").na.fill(0, ["n_new", "n_classified", "n_review"])
    return (per_file.rollup(file_col)
            .agg(*[F.sum(c).alias(c) for c in ("n_read", "n_new", "n_classified", "n_review")])
            .withColumn("alert", F.col("n_review") > 0))
