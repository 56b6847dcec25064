"""The per-ledger JSON document.

The document is assembled only from aggregates whose size is bounded by months × categories
(month summaries, category groups, top movements, averages, cross-table series), so no ledger — not
even one holding a third of all movements — sends its rows into a single task.  The one unbounded
list of the original document (every unclassified movement of a month) stays a long-form table
(``unclassified_movements``); the document carries that series' monthly totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.constants import UNCLASSIFIED
from ledgerline.functions.dates import month_label
from ledgerline.functions.predicates import is_card
from ledgerline.operators import aggregates as A
from ledgerline.operators import balances as B
from ledgerline.operators import crosstab as X
from ledgerline.operators import windows as W
from ledgerline.functions.numbers import zero
from ledgerline.session import materialize


def _ordered_values(items: Column, key: str, value: str) -> Column:
    """collect_list order is not defined: sort the (key, value) structs, keep the values."""
    return F.transform(F.array_sort(items), lambda x: x[value])


def _from_detail(fine: DataFrame, opening: DataFrame | None):
    """Month totals (A1), category / subcategory totals (A2, A3), balances (W1, W3), cross table
    (A5), unclassified series (A6) and review count (A13), all from the month detail aggregate."""
    mk = ["ledger_id", "month"]
    exp = F.col("flow") == "expense"
    m = fine.groupBy(*mk).agg(
        F.sum("amount").alias("_all"),
        F.max("_last").alias("_lastrow"),
        (-F.coalesce(F.sum(F.when(F.col("category") == UNCLASSIFIED, F.col("amount"))), zero())).alias("value"),
        F.sum(F.when(F.col("category") == UNCLASSIFIED, F.col("n"))).alias("_unc_n"))
    months = A.months_from_detail(fine)
    cat = A.categories_from_detail(fine)
    subs = (fine.where(exp & (F.col("subcategory") != "")).groupBy(*mk, "category", "subcategory")
                .agg((-F.sum("amount")).alias("total")))
    bal = B.balance_from_net(months.select(*mk, "net"), opening).select(*mk, "opening", "closing", "net")
    bank = B.bank_balance_from(m.select(*mk, F.col("_all").alias("net"), F.col("_lastrow.bank_balance").alias("_last")))
    xt = X.cross_table_from_base(X.detail_base(fine))
    unc = m.select(*mk, "value")
    n_review = m.groupBy("ledger_id").agg(F.coalesce(F.sum("_unc_n"), F.lit(0)).alias("n_review"))
    return months, cat, subs, bal, bank, xt, unc, n_review


def _sort_by(arr: Column, field: str) -> Column:
    """array_sort on one key field (structs holding maps have no natural order)."""
    return F.array_sort(arr, lambda a, b: F.when(a[field] < b[field], -1).when(a[field] > b[field], 1).otherwise(0))


def _cross_sections(xt: DataFrame):
    """Per ledger: the category rows of both sections (O2 order) and the section totals, as arrays by month."""
    series = (xt.where(F.col("level") == "category")
                .groupBy("ledger_id", "section", "category")
                .agg(_ordered_values(F.collect_list(F.struct("month", "value")), "month", "value").alias("values")))
    sub_series = (xt.where(F.col("level") == "sub")
                    .groupBy("ledger_id", "section", "category", "subcategory")
                    .agg(_ordered_values(F.collect_list(F.struct("month", "value")), "month", "value").alias("values"))
                    .groupBy("ledger_id", "section", "category")
                    .agg(F.map_from_entries(F.collect_list(F.struct("subcategory", "values"))).alias("subcats")))
    totals = xt.where(F.col("level") == "total").select("ledger_id", "section", "category", F.col("value").alias("total"), "rank")
    rows = (series.join(sub_series, ["ledger_id", "section", "category"], "left")
                  .join(totals, ["ledger_id", "section", "category"]))
    sections = rows.groupBy("ledger_id").agg(
        *[F.transform(_sort_by(F.collect_list(F.when(F.col("section") == s, F.struct(
            "rank", F.col("category").alias("cat"), "values", "subcats", "total"))), "rank"), lambda x: x.dropFields("rank"))
          .alias(s) for s in ("income", "expense")])
    sec_tot = (xt.where(F.col("level") == "section").groupBy("ledger_id", "section")
                 .agg(_ordered_values(F.collect_list(F.struct("month", "value")), "month", "value").alias("v"))
                 .groupBy("ledger_id").agg(
                     F.max(F.when(F.col("section") == "income", F.col("v"))).alias("income_total"),
                     F.max(F.when(F.col("section") == "expense", F.col("v"))).alias("expense_total")))
    return sections, sec_tot


def ledger_document(led: DataFrame, opening: DataFrame | None, generated_at: str, **kw) -> DataFrame:
    """(ledger_id, document) with document = to_json({generated, n_review, months, averages,
    history, cross, card, account}); ``generated_at`` is a parameter (no wall clock inside a job)."""
    fine = materialize(A.month_detail(led, **kw))
    groups = materialize(A.group_movements(A.expense_rows(led, **kw),
                                           ["ledger_id", "month", "category", "origin", "subcategory"]))
    months, cat, subs, bal, bank, xt, unc, n_review = _from_detail(fine, opening)
    groups = groups.withColumn("rank", F.row_number().over(
        Window.partitionBy("ledger_id", "month", "category").orderBy("total", "origin", "subcategory")))
    top = W.top_from_groups(groups.drop("rank"))
    avg = W.category_average(months, cat)
    hist = W.history(months, cat)
    mk = ["ledger_id", "month"]

    sub_map = subs.groupBy(*mk, "category").agg(
        F.map_from_entries(F.collect_list(F.struct("subcategory", "total"))).alias("sub"))
    movs = groups.groupBy(*mk, "category").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("last_date").cast("string").alias("f"), F.col("concept").alias("c"), F.col("total").alias("m"),
        F.col("subcategory").alias("d2"), F.col("origin"), "n"))).alias("movs"))
    cats = (cat.join(sub_map, [*mk, "category"], "left").join(movs, [*mk, "category"], "left")
               .groupBy(*mk).agg(F.map_from_entries(F.collect_list(F.struct(
                   "category", F.struct("total", "sub", "movs")))).alias("categories")))
    tops = top.groupBy(*mk).agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("last_date").cast("string").alias("f"), F.col("concept").alias("c"), F.col("total").alias("m"),
        F.col("subcategory").alias("d2"), "category", "origin", "n"))).alias("top_movements"))
    month_docs = (months.join(cats, mk, "left").join(tops, mk, "left")
                  .groupBy("ledger_id").agg(_sort_by(F.collect_list(F.struct(
                      F.col("month").alias("id"), "label", "expense_total", "income_total", "categories",
                      "top_movements")), "id").alias("months"),
                      F.sum("expense_total").alias("_e")))

    averages = avg.groupBy("ledger_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "average"))).alias("averages"))
    by_cat = (hist.groupBy("ledger_id", "category", "rank")
                  .agg(_ordered_values(F.collect_list(F.struct("month", "total")), "month", "total").alias("series"))
                  .groupBy("ledger_id").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(
                      F.struct("rank", "category", "series"))), lambda x: F.struct(x["category"], x["series"])))
                      .alias("by_category")))

    sections, sec_tot = _cross_sections(xt)
    bal_arr = (bal.join(unc, mk, "left").groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct(
        "month", "opening", "closing", F.col("value").alias("unclassified")))).alias("_b")))
    cross = (bal_arr.join(sections, "ledger_id", "left").join(sec_tot, "ledger_id", "left")
                    .select("ledger_id", F.struct(
                        F.transform("_b", lambda x: x["month"]).alias("months"),
                        F.transform("_b", lambda x: month_label(x["month"])).alias("labels"),
                        F.transform("_b", lambda x: x["opening"]).alias("opening"),
                        F.transform("_b", lambda x: x["closing"]).alias("closing"),
                        "income", "income_total", "expense", "expense_total",
                        F.transform("_b", lambda x: x["unclassified"]).alias("unclassified")).alias("cross")))
    card_fine = fine.where(is_card("origin"))
    card_sections, card_tot = _cross_sections(X.cross_table_from_base(X.detail_base(card_fine)))
    card_months = card_fine.groupBy("ledger_id").agg(F.array_sort(F.collect_set("month")).alias("months"))
    card = (card_months.join(card_sections, "ledger_id", "left").join(card_tot, "ledger_id", "left")
            .select("ledger_id", F.struct("months", "income", "income_total", "expense", "expense_total").alias("card")))
    account = (months.join(bank.select(*mk, F.col("closing").alias("balance")), mk, "left")
                     .groupBy("ledger_id").agg(F.array_sort(F.collect_list(F.struct(
                         F.col("month").alias("id"), "label", F.col("income_total").alias("income"),
                         F.col("expense_total").alias("expense"), "balance"))).alias("account")))

    doc = (month_docs.join(n_review, "ledger_id").join(averages, "ledger_id", "left").join(by_cat, "ledger_id", "left")
           .join(cross, "ledger_id", "left").join(card, "ledger_id", "left").join(account, "ledger_id", "left"))
    history = F.struct(F.transform("months", lambda m: m["label"]).alias("labels"),
                       F.transform("months", lambda m: m["expense_total"]).alias("expense"),
                       F.transform("months", lambda m: m["income_total"]).alias("income"),
                       F.col("by_category"))
    return doc.select("ledger_id", F.to_json(F.struct(
        F.lit(generated_at).alias("generated"), "n_review", "months", "averages", history.alias("history"),
        "cross", "card", "account"), {"ignoreNullFields": "false"}).alias("document"))


def write_document(docs: DataFrame, path: str, unclassified: DataFrame | None = None) -> None:
    """S5 sink: the documents as rows of one table and, beside it, the long-form list of unclassified movements
    (F11), which has no bound per ledger.  Not one folder per ledger: there may be millions."""
    docs.select("ledger_id", "document").write.mode("overwrite").parquet(f"{path}/documents")
    if unclassified is not None:
        unclassified.write.mode("overwrite").parquet(f"{path}/unclassified")
