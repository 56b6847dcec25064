"""Ledger reader (S2), append (S3), last-import marker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.constants import UNCLASSIFIED
from ledgerline.functions.dates import month_key, parse_date
from ledgerline.functions.labels import recode_category
from ledgerline.functions.numbers import MONEY, parse_amount_es, signed_amount
from ledgerline.functions.predicates import valid_date
from ledgerline.functions.text import clean_text, strip

LEDGER_COLUMNS = ("ledger_id", "row_id", "date", "month", "kind", "origin", "category", "subcategory",
                  "concept", "debit", "credit", "bank_balance", "amount")


def read_ledger(source, spark: SparkSession | None = None, min_year: int | None = None,
                recode: DataFrame | None = None, recode_before: int | None = None,
                keep_blank: bool = False, before_year: int | None = None) -> DataFrame:
    """Typed ledger rows for the reports.  Text dates and amounts are read as P5 and P4; other types are cast.

    ``source`` is a movements DataFrame or a parquet path.  Absent text columns default to '',
    ``amount = credit − debit`` (null as 0), ``month = yyyy-MM``, rows without a date or before
    ``min_year`` are dropped, a blank category becomes 'Sin clasificar' (unless ``keep_blank``,
    the model's variant).  With ``recode``, legacy labels of rows before ``recode_before`` are
    translated with the fill-blank-sub policy.
    """
    df = spark.read.parquet(source) if isinstance(source, str) else source
    cols = set(df.columns)
    kinds = dict(df.dtypes)
    if "date" not in cols:
        raise ValueError("a ledger needs a date column")
    if kinds["date"] not in ("date", "timestamp", "timestamp_ntz"):       # text or serial dates (P5)
        df = df.withColumn("date", parse_date("date"))

    def money(c):
        if c not in cols:
            return F.lit(None).cast(MONEY)
        blank = strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""       # as in P4, so worked out once
        return F.when(~blank, parse_amount_es(c)) if kinds[c] == "string" else F.col(c).cast(MONEY)

    def text(c):
        return clean_text(c) if c in cols else F.lit("")

    dated = df.where(valid_date("date", min_year))
    if before_year is not None:                       # a range on the column, so a stored ledger's scan gets it
        dated = dated.where(F.col("date") < F.lit(f"{before_year:04d}-01-01").cast("date"))
    out = dated.select(
        "ledger_id", "row_id", F.col("date").cast("date").alias("date"),
        text("kind").alias("kind"), text("origin").alias("origin"),
        text("category").alias("category"), text("subcategory").alias("subcategory"),
        strip(F.coalesce(F.col("concept"), F.lit(""))).alias("concept") if "concept" in cols else F.lit("").alias("concept"),
        *[money(c).alias(c) for c in ("debit", "credit", "bank_balance")],
    )
    if recode is not None:
        out = recode_category(out, recode, "fill", before_year=recode_before)
    if not keep_blank:
        out = out.withColumn("category", F.when(F.col("category") == "", F.lit(UNCLASSIFIED)).otherwise(F.col("category")))
    return (out.withColumn("amount", signed_amount("credit", "debit"))
               .withColumn("month", month_key("date"))
               .select(*LEDGER_COLUMNS))


def append_movements(new_rows: DataFrame, path: str | None = None):
    """S3: labelled new rows in ledger form: 0 debit/credit/balance ⇒ null, review = unclassified.

    With ``path``, the rows are added to the parquet ledger, one folder per batch (not per ledger: there may be
    millions).  A batch that is written again replaces itself, so a retried job doubles nothing.  Counts (added,
    unclassified) are gathered with ``observe`` during that single write.  Returns (rows, {added, unclassified} or None).
    """
    rows = new_rows.select(
        "ledger_id", "row_id", "batch_id", "kind", "origin", "category", "subcategory", "date", "concept",
        F.nullif(F.col("debit"), F.lit(0)).alias("debit"),
        F.nullif(F.col("credit"), F.lit(0)).alias("credit"),
        F.nullif(F.col("bank_balance"), F.lit(0)).alias("bank_balance"),
        *[(F.coalesce(F.col(c), F.lit("")) if c in new_rows.columns else F.lit("")).alias(c) for c in ("reference", "destination")],
        (F.col("category") == UNCLASSIFIED).alias("review"))
    if path is None:
        return rows, None
    from pyspark.sql import Observation
    obs = Observation("append")
    (rows.observe(obs, F.count(F.lit(1)).alias("added"),
                  F.count_if(F.col("review")).alias("unclassified"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))
    return rows, obs.get


def new_since(ledger: DataFrame) -> DataFrame:
    """The rows of each ledger's last import batch (the 'new' marker moves with each batch).  Batches are
    ordered by the number at the end of their id (none: before all numbers), then by the id."""
    number = F.coalesce(F.regexp_extract(F.col("batch_id"), r"([0-9]+)$", 1).try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)"))
    order = F.struct(number.alias("n"), F.col("batch_id").alias("id"))
    last = ledger.groupBy("ledger_id").agg(F.max(order)["id"].alias("_last"))
    return (ledger.join(last, "ledger_id").where(F.col("batch_id") == F.col("_last")).drop("_last"))
