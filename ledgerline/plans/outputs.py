"""Document sink, statement column mapping and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators.dedupe import import_statements as import_op
from ledgerline.operators.aggregates import month_totals
from ledgerline.operators.aggregates import unclassified_movements as unclassified_op
from ledgerline.operators.document import ledger_document
from ledgerline.operators.document import write_document as write_op
from ledgerline.operators.kept_model import KeptLabeller
from ledgerline.plans.common import finalize, ledger
from ledgerline.plans.labelling import rules
from ledgerline.session import materialize, scratch_path
from ledgerline.sources import adapter
from ledgerline.sources.ledger import read_ledger
from ledgerline.sources.monthly import MonthLedger
from ledgerline.sources.statements import FIELDS, read_statements, write_statement_files
from ledgerline.streaming.inbox import import_stream as stream_op
from ledgerline.streaming.inbox import refresh_months as refresh_op
from ledgerline.streaming.inbox import run_log
from ledgerline.streaming.views import MonthViews

GENERATED_AT = "2026-01-01T00:00:00"


def _read_once(spark, sf):
    """The ledger as read, written once: it is aggregated in several ways, and reading it inside an aggregation makes a
    method that the JVM does not compile."""
    return materialize(ledger(spark, sf))


def write_document(spark, sf):
    """One JSON document per ledger (rows-only check: nested output)."""
    return ledger_document(_read_once(spark, sf), adapter.opening_balances(spark, sf), GENERATED_AT)


_MOVEMENTS = "array<struct<rank:int,f:string,c:string,m:double,d2:string,category:string,origin:string,n:bigint>>"
_SERIES = ("array<struct<id:string,label:string,expense_total:double,income_total:double,"
           f"categories:map<string,struct<total:double,sub:map<string,double>,movs:{_MOVEMENTS}>>,top_movements:{_MOVEMENTS}>>")
_CATEGORIES = "array<struct<cat:string,values:array<double>,subcats:map<string,array<double>>,total:double>>"
_CROSS = f"struct<months:array<string>,income:{_CATEGORIES},expense:{_CATEGORIES},income_total:array<double>,expense_total:array<double>>"


def document_values(spark, sf):
    """S5 written and read back as rows (section, key, month, value): every number of every document."""
    path = scratch_path(spark, "documents")
    led = _read_once(spark, sf)
    write_op(ledger_document(led, adapter.opening_balances(spark, sf), GENERATED_AT), path, unclassified_op(led))
    balances, totals = ("opening", "closing", "unclassified"), ("income_total", "expense_total")
    schema = (f"struct<n_review:bigint,months:{_SERIES},averages:map<string,double>,history:struct<expense:array<double>,income:array<double>,"
              f"by_category:map<string,array<double>>>,cross:{_CROSS.removesuffix('>')},{','.join(f'{c}:array<double>' for c in balances)}>,card:{_CROSS},"
              "account:array<struct<id:string,income:double,expense:double,balance:double>>>")
    d = spark.read.parquet(f"{path}/documents").select("ledger_id", F.from_json("document", schema).alias("d")).select("ledger_id", "d.*")

    def cells(part, name):
        """A section of a cross table: each category's months, those of its subcategories (if it has any) and its total."""
        cat = d.select("ledger_id", F.col(f"{part}.months").alias("m"), F.explode(f"{part}.{name}").alias("c"))
        series = lambda level, key, ids, values: F.struct(F.lit(f"{part} {name}{level}").alias("section"), key.alias("key"), ids.alias("i"), values.alias("v"))
        subs = F.transform(F.map_entries("c.subcats"), lambda s: series(" sub", F.concat_ws("|", "c.cat", s["key"]), F.col("m"), s["value"]))
        own = F.array(series("", F.col("c.cat"), F.col("m"), F.col("c.values")),
                      series(" total", F.col("c.cat"), F.array(F.lit(None).cast("string")), F.array("c.total")))
        return cat.select("ledger_id", F.explode(F.concat(own, F.coalesce(subs, F.array()))).alias("s")).select(
            "ledger_id", "s.section", "s.key", F.explode(F.arrays_zip("s.i", "s.v")).alias("z")).select(
            "ledger_id", "section", "key", F.col("z.i").alias("month"), F.col("z.v").alias("value"))
    months = d.select("ledger_id", F.explode("months").alias("m"))
    total = lambda n: months.select("ledger_id", F.lit("months").alias("section"), F.lit(n).alias("key"), F.col("m.id").alias("month"), F.col(f"m.{n}").alias("value"))

    def by_month(section, key, ids, values):
        z = d.select("ledger_id", key.alias("key"), F.explode(F.arrays_zip(ids.alias("i"), values.alias("v"))).alias("z"))
        return z.select("ledger_id", F.lit(section).alias("section"), "key", F.col("z.i").alias("month"), F.col("z.v").alias("value"))

    def listed(section, rows, *before):
        """Movement lists: all their fields but the amount in the key."""
        key = F.concat_ws("|", *before, *[F.coalesce(F.col(f"x.{c}").cast("string"), F.lit("")) for c in ("rank", "origin", "d2", "c", "f", "n")])
        return rows.select("ledger_id", F.lit(section).alias("section"), key.alias("key"), "month", F.col("x.m").alias("value"))

    ids = F.col("months.id")
    single = lambda section, df: df.select("ledger_id", F.lit(section).alias("section"), "key", F.lit(None).cast("string").alias("month"), "value")
    cats = months.select("ledger_id", F.col("m.id").alias("month"), F.explode("m.categories").alias("key", "c"))
    hist = d.select("ledger_id", ids.alias("i"), F.explode("history.by_category").alias("key", "v")).select(
        "ledger_id", "key", F.explode(F.arrays_zip("i", "v")).alias("z"))
    account = d.select("ledger_id", F.explode("account").alias("a"))
    parts = [total("income_total"), *[by_month("cross", F.lit(c), F.col("cross.months"), F.col(f"cross.{c}")) for c in balances + totals],
             *[by_month("card", F.lit(c), F.col("card.months"), F.col(f"card.{c}")) for c in totals],
             *[by_month("history", F.lit(c), ids, F.col(f"history.{c}")) for c in ("expense", "income")],
             hist.select("ledger_id", F.lit("history by category").alias("section"), "key", F.col("z.i").alias("month"), F.col("z.v").alias("value")),
             single("averages", d.select("ledger_id", F.explode("averages").alias("key", "value"))),
             single("n_review", d.select("ledger_id", F.lit("").alias("key"), F.col("n_review").cast("double").alias("value"))),
             *[account.select("ledger_id", F.lit("account").alias("section"), F.lit(c).alias("key"), F.col("a.id").alias("month"), F.col(f"a.{c}").alias("value"))
               for c in ("income", "expense", "balance")],
             cats.select("ledger_id", F.lit("category").alias("section"), "key", "month", F.col("c.total").alias("value")),
             cats.select("ledger_id", "month", F.col("key").alias("k"), F.explode("c.sub").alias("s", "value")).select(
                 "ledger_id", F.lit("subcategory").alias("section"), F.concat_ws("|", "k", "s").alias("key"), "month", "value"),
             listed("movements", cats.select("ledger_id", "month", "key", F.explode("c.movs").alias("x")), "key"),
             listed("top", months.select("ledger_id", F.col("m.id").alias("month"), F.explode("m.top_movements").alias("x")), "x.category")]
    out = total("expense_total")
    for p in parts:
        out = out.unionByName(p)
    for part in ("cross", "card"):
        for name in ("income", "expense"):
            out = out.unionByName(cells(part, name))
    return out


def map_columns(spark, sf):
    """The column each canonical field was mapped to, per statement file."""
    path = write_statement_files(adapter.incoming_rows(spark, sf), scratch_path(spark, "statements"))
    _, _, mapping = read_statements(spark, path, with_mapping=True)
    stacked = mapping.select(
        F.regexp_extract("path", r"ledger_id=([^/]+)", 1).alias("ledger_id"),
        F.regexp_extract("path", r"file_no=([^/]+)", 1).cast("int").alias("file_no"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("pos")) for f in FIELDS])).alias("m"))
    return finalize(stacked.select("ledger_id", "file_no", "m.field", "m.pos"))


_CANON = ["ledger_id", "reference", "kind", "origin", "category", "subcategory", "date", "concept", "debit", "credit",
          "bank_balance", "review"]


def _streamed(spark, sf):
    """The incoming rows as raw statement files in an inbox, imported by the streaming job; the ledger's path."""
    inbox = write_statement_files(adapter.incoming_rows(spark, sf), scratch_path(spark, "inbox"))
    led_path = scratch_path(spark, "ledger")
    (adapter.existing_ledger(spark, sf).drop("batch_id")
        .write.mode("overwrite").parquet(f"{led_path}/batch_id=initial"))
    stream_op(spark, inbox, led_path, rules(spark, sf), scratch_path(spark, "stream-ckpt"))
    return led_path


def import_stream(spark, sf):
    """The rows that the stream imported into a ledger folder (one ``batch_id=`` folder per micro-batch)."""
    out = spark.read.parquet(_streamed(spark, sf)).where(F.col("batch_id") != "initial")
    # some references of the fixture hold a line break and a separator
    return finalize(out.withColumn("reference", F.split_part("reference", F.lit("\n"), F.lit(1))).select(*_CANON))


def import_stream_by_month(spark, sf):
    """T1 into a ledger stored by month, merged after the import, with the kept labeller learning from each batch."""
    inbox = write_statement_files(adapter.incoming_rows(spark, sf), scratch_path(spark, "inbox"))
    store = MonthLedger(spark, scratch_path(spark, "month-ledger"), buckets=2)
    old = adapter.existing_ledger(spark, sf)
    store.append(old, "initial")
    labeller = KeptLabeller(spark, scratch_path(spark, "labeller"))
    labeller.learn(old, "initial")
    stream_op(spark, inbox, store, rules(spark, sf), scratch_path(spark, "stream-ckpt"), after_import=labeller.after_import)
    store.compact(fan_in=2)
    out = store.read().where(F.col("batch_id") != "initial")
    return finalize(out.withColumn("reference", F.split_part("reference", F.lit("\n"), F.lit(1))).select(*_CANON))


def stream_summary(spark, sf):
    """A14 of the stream: the run log, one row per statement file."""
    log = run_log(spark, f"{_streamed(spark, sf)}-runs")
    return finalize(log.select(
        F.regexp_extract("path", r"ledger_id=([^/]+)", 1).alias("ledger_id"), F.regexp_extract("path", r"file_no=([^/]+)", 1).cast("int").alias("file_no"),
        "status", "n_read", "n_new", "n_classified", "n_review", "n_rejected", "alert"))


def refresh_months(spark, sf):
    """Month totals after an import, recomputed only for the touched (ledger, month) pairs."""
    old = adapter.existing_ledger(spark, sf)
    imported = import_op(adapter.incoming_rows(spark, sf), old, rules(spark, sf), "import-1")
    cols = ["ledger_id", "row_id", "date", "kind", "origin", "category", "subcategory", "concept", "debit",
            "credit", "bank_balance"]
    after = old.select(*cols).unionByName(imported.select(*cols))
    old_months = month_totals(read_ledger(old, min_year=adapter.FIRST_YEAR))
    led_after = read_ledger(after, min_year=adapter.FIRST_YEAR)
    touched = read_ledger(imported.select(*cols), min_year=adapter.FIRST_YEAR)
    return finalize(refresh_op(old_months, led_after, touched))


def view_rows(views):
    """All views as rows: view, ledger_id, month, key, value, n."""
    none = F.lit(None).cast("long")

    def rows(view, df, key, value, n=none):
        return df.select(F.lit(view).alias("view"), "ledger_id", "month", key.alias("key"), F.col(value).cast("double").alias("value"), n.cast("long").alias("n"))

    text = lambda *cols: F.concat_ws("|", *cols)
    months, w1, w3 = views.month_totals(), views.running_balance(), views.bank_balance()
    parts = [rows("A1", months, F.lit("expense"), "expense_total"), rows("A1", months, F.lit("income"), "income_total"),
             rows("A2", views.category_totals(), F.col("category"), "total", F.col("n")),
             rows("A3", views.subcategory_totals(), text("category", "subcategory"), "total"),
             rows("A4", views.category_groups(), text("category", "origin", "subcategory", "concept", F.col("last_date").cast("string")), "total", F.col("n")),
             rows("A5", views.cross_table(), text("section", "level", "category", "subcategory"), "value", F.col("rank")),
             *[rows(v, df, F.lit(c), c) for v, df in (("W1", w1), ("W3", w3)) for c in ("closing", "opening")]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def refresh_all(spark, sf):
    """The stored views of the ledger after an import and after a second batch of backdated rows (1998), which the
    first state of the ledger lacks."""
    old = adapter.existing_ledger(spark, sf)
    late = (F.year("date") == 1998) & (F.substring("row_id", 14, 2) == "04")
    views = MonthViews(spark, scratch_path(spark, "views"), adapter.opening_balances(spark, sf), adapter.FIRST_YEAR, buckets=1)
    views.refresh(old.where(~late), "initial")
    views.refresh(import_op(adapter.incoming_rows(spark, sf), old, rules(spark, sf), "import-1"), "import-1")
    views.refresh(old.where(late), "late-1")
    return view_rows(views)


QUERIES = {
    "write_document": write_document,
    "document_values": document_values,
    "map_columns": map_columns,
    "import_stream": import_stream,
    "import_stream_by_month": import_stream_by_month,
    "stream_summary": stream_summary,
    "refresh_months": refresh_months,
    "refresh_all": refresh_all,
}
