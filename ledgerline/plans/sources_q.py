"""Source / sink and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import predicates as PR
from ledgerline.functions.dates import month_key, month_label, parse_date as parse_date_col
from ledgerline.functions.numbers import parse_amount_es as es_col
from ledgerline.functions.numbers import parse_bank_amount as bank_col
from ledgerline.functions.numbers import signed_amount as signed_col
from ledgerline.functions.text import clean_text as clean_col
from ledgerline.functions.text import model_text as model_text_col
from ledgerline.functions.text import norm_concept as norm_col
from ledgerline.functions.text import norm_header as norm_header_col
from ledgerline.functions.text import tokens as tokens_col
from ledgerline.functions.text import truncate
from ledgerline.plans.common import finalize
from ledgerline.session import scratch_path
from ledgerline.sources import adapter
from ledgerline.sources.ledger import read_ledger as read_op_ledger
from ledgerline.sources.statements import read_statements as read_op
from ledgerline.sources.statements import source_lines, write_statement_files
from ledgerline.sources.statements import statement_outcomes as outcomes_op


def read_statements(spark, sf):
    """S1 round trip: the incoming rows written as raw statements of rotating layouts into the
    shared checkpoint folder, read back by the layout-detecting reader."""
    path = write_statement_files(adapter.incoming_rows(spark, sf), scratch_path(spark, "statements"))
    rows, _ = read_op(spark, path)
    reference = F.split_part("reference", F.lit("\n"), F.lit(1))
    return finalize(rows.select(F.col("ledger_id").cast("string").alias("ledger_id"), "file_no", "date", "concept", "debit", "credit",
                                "balance", reference.alias("reference"), F.contains("reference", F.lit("\n")).alias("several_lines")))


def statement_rejects(spark, sf):
    path = write_statement_files(adapter.incoming_rows(spark, sf), scratch_path(spark, "statements"))
    _, rejects = read_op(spark, path)
    return finalize(rejects.select(F.col("ledger_id").cast("string").alias("ledger_id"), "file_no", "reason",
                                   F.regexp_extract("raw", "COMPRA SIN [A-Z]+", 0).alias("line")))


def statement_outcomes(spark, sf):
    """Every line after a header is accounted for: lines, movements, balance lines and rejects per file."""
    path = write_statement_files(adapter.incoming_rows(spark, sf), scratch_path(spark, "statements"))
    out, _ = outcomes_op(spark, source_lines(spark.read.text(path)))
    return finalize(out.groupBy(F.col("ledger_id").cast("string").alias("ledger_id"), "file_no").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("outcome") == "row").alias("n_rows"),
        F.count_if(F.col("outcome") == "balance").alias("n_balance"), F.count_if(F.col("outcome") == "reject").alias("n_rejects")))


def _texts(spark, sf):
    """Date and amount texts in several spellings, derived from the lineitem rows."""
    b = adapter.base_rows(spark, sf)
    amt = F.coalesce(F.col("debit"), F.col("credit"))
    cents = (amt * 100).cast("bigint")
    thousands = F.concat((cents / 100000).cast("bigint").cast("string"), F.lit("."),
                         F.lpad(((cents / 100).cast("bigint") % 1000).cast("string"), 3, "0"), F.lit(","),
                         F.lpad((cents % 100).cast("string"), 2, "0"))
    form = F.col("_linenumber") % 4
    amount_text = (F.when(form == 0, amt.cast("string"))
                    .when(form == 1, F.concat(F.lit("$ "), F.regexp_replace(amt.cast("string"), r"\.", ",")))
                    .when(form == 2, F.concat(F.lit("-"), amt.cast("string")))
                    .otherwise(F.when(amt >= 1000, thousands).otherwise(F.lit(""))))
    serial = F.datediff(F.col("date"), F.lit("1899-12-30").cast("date")).cast("string")
    spelled = F.col("_linenumber") % 7
    date_text = (F.when(spelled == 0, F.date_format("date", "d/M/yyyy"))
                  .when(spelled == 1, serial)
                  .when(spelled == 2, F.concat(serial, F.lit(".75")))
                  .when(spelled == 3, F.date_format("date", "yyyy-MM-dd"))
                  .when(spelled == 4, F.date_format("date", "dd/MM/yy"))
                  .when(spelled == 5, F.concat(F.lit("\u00a0"), F.date_format("date", "yyyy-MM-dd"), F.lit(" 00:00:00")))
                  .otherwise(F.concat(F.date_format("date", "yyyy/MM/dd"), F.lit(" 10:15"))))
    return b.select("row_id", amount_text.alias("amount_text"), date_text.alias("date_text"), amt.alias("amount_number"))


def parse_bank_amount(spark, sf):
    t = _texts(spark, sf)
    return finalize(t.select("row_id", "amount_text", bank_col("amount_text").alias("amount")))


def parse_amount_es(spark, sf):
    t = _texts(spark, sf)
    return finalize(t.select("row_id", "amount_text", es_col("amount_text").alias("amount"),
                             es_col("amount_number").alias("from_decimal"),
                             es_col(F.col("amount_number").cast("double")).alias("from_double")))


def parse_date(spark, sf):
    t = _texts(spark, sf)
    return finalize(t.select("row_id", "date_text", parse_date_col("date_text").alias("date")))


def norm_header(spark, sf):
    """P1 over the part names and brands used as header-like texts."""
    p = spark.read.parquet(f"{sf}/part.parquet")
    return finalize(p.select("p_partkey", norm_header_col(F.concat_ws(" ", "p_name", "p_brand")).alias("norm")))


def norm_concept(spark, sf):
    mv = adapter.movements(spark, sf)
    spaced = F.translate("concept", " ", "\u00a0")           # no-break spaces, as in some statements
    concept = F.when(F.substring("row_id", 14, 2).isin("02", "04", "06"), spaced).otherwise(F.col("concept"))
    return finalize(mv.select("row_id", norm_col(concept).alias("norm")))


def tokens(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.select("row_id", F.array_join(tokens_col(norm_col("concept")), " ").alias("tokens")))


def signed_amount(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.select("row_id", signed_col("credit", "debit").alias("amount")))


def month_labels(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.select(month_key("date").alias("month")).distinct()
                    .select("month", month_label("month").alias("label")))


def clean_text(spark, sf):
    """P14 over the legacy labels (blank, 'nan'-like and padded values)."""
    lg = adapter.legacy_movements(spark, sf)
    raw = F.when(F.col("label") == "", F.lit("nan")).when(F.col("label") == "PROMO", F.lit(" None ")).otherwise(
        F.concat(F.lit(" "), F.col("label")))
    return finalize(lg.select("row_id", clean_col(raw).alias("label")))


def model_text(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.select("row_id", model_text_col("concept", "reference", "destination", "origin").alias("text")))


def truncate_concept(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.select("row_id", truncate("concept", 20).alias("short")))


def drop_balance_lines(spark, sf):
    """F1 over the statement lines (the fixture writes one balance line per statement)."""
    path = write_statement_files(adapter.incoming_rows(spark, sf), scratch_path(spark, "statements"))
    out, _ = outcomes_op(spark, source_lines(spark.read.text(path)))
    return finalize(out.where(PR.is_balance_line("concept")).groupBy(F.col("ledger_id").cast("string").alias("ledger_id"), "file_no")
                    .agg(F.count(F.lit(1)).alias("balance_lines")))


def drop_marker_kinds(spark, sf):
    lg = adapter.legacy_movements(spark, sf)
    return finalize(lg.where(~PR.is_marker_kind("kind")).select("row_id", "kind"))


def card_subset(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.where(PR.is_card("origin")).select("row_id", "origin"))


def needs_label(spark, sf):
    lg = adapter.legacy_movements(spark, sf)
    return finalize(lg.where(PR.needs_label("label")).select("row_id", "label"))


def training_rows(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.where(PR.is_training_row("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")))


def from_year(spark, sf):
    mv = adapter.movements(spark, sf)
    return finalize(mv.where(PR.from_year("date", adapter.CUTOVER_YEAR)).groupBy("ledger_id").agg(
        F.count(F.lit(1)).alias("n")))


def read_ledger(spark, sf):
    """S2 over a stored ledger whose dates and amounts are text (day-first dates, Spanish amounts)."""
    mv = adapter.movements(spark, sf)
    # 1,234.56 → 1.234,56
    amounts = [F.translate(F.format_number(c, 2), ",.", ".,").alias(c) for c in ("debit", "credit", "bank_balance")]
    text = mv.select("ledger_id", "row_id", "kind", "origin", "category", "subcategory", "concept",
                     F.date_format("date", "d/M/yyyy").alias("date"), *amounts)
    path = scratch_path(spark, "text-ledger")
    text.write.parquet(path)
    return finalize(read_op_ledger(path, spark, min_year=adapter.FIRST_YEAR))


QUERIES = {
    "read_ledger": read_ledger,
    "read_statements": read_statements,
    "statement_rejects": statement_rejects,
    "statement_outcomes": statement_outcomes,
    "parse_bank_amount": parse_bank_amount,
    "parse_amount_es": parse_amount_es,
    "parse_date": parse_date,
    "norm_header": norm_header,
    "norm_concept": norm_concept,
    "tokens": tokens,
    "signed_amount": signed_amount,
    "month_labels": month_labels,
    "clean_text": clean_text,
    "model_text": model_text,
    "truncate_concept": truncate_concept,
    "drop_balance_lines": drop_balance_lines,
    "drop_marker_kinds": drop_marker_kinds,
    "card_subset": card_subset,
    "needs_label": needs_label,
    "training_rows": training_rows,
    "from_year": from_year,
}
