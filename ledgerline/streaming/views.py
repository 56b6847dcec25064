"""Stored month views of a ledger, kept up to date import by import.

Three tables hold what the reports are derived from:

* ``concepts``: (ledger, month, flow, category, subcategory, origin, concept) sums, for A4;
* ``detail``: the same without the concept, with the month's last movement, for A1-A3 and A5;
* ``balances``: (ledger, month) nets with the running (W1) and bank (W3) balances.

They are partitioned by a hash bucket of the ledger and the month (balances: the year).  A batch is aggregated to a
delta; only the touched partitions are read, merged with it and overwritten.  Sums, counts and the last movement
merge, so no movement is read again.  Balances are recomputed from a ledger's first touched month on, starting at the
closing of its last untouched month, so backdated rows are right too.

A refresh is idempotent by its tag: the new content of the touched partitions is written in full beside the tables
(``pending``) before any of them is replaced.  A refresh that is interrupted before that starts again, one
interrupted after it moves the partitions that are left in ``pending``, and one that is finished does nothing.
Corrections of rows that a view already holds are no import: ``rebuild`` reads the whole ledger.

Defined cases: an empty batch changes nothing; rows without a ledger are one ledger; undated rows and rows before
``min_year`` are left out as in the reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.constants import EXCLUDED_FROM_BALANCE
from ledgerline.functions.numbers import zero
from ledgerline.operators import aggregates as A
from ledgerline.operators.balances import bank_balance_from
from ledgerline.operators.crosstab import cross_table_from_base, detail_base
from ledgerline.session import materialize
from ledgerline.sources import files
from ledgerline.sources.ledger import read_ledger

BUCKETS = 16            # hash buckets of ledgers; choose them such that a bucket's month is about one file
SUM = "decimal(38,2)"
KEYS = ["bucket", "month", "ledger_id", "flow", "category", "subcategory", "origin"]

TABLES = {
    "concepts": ("ledger_id string, flow string, category string, subcategory string, origin string, concept string, "
                 f"amount {SUM}, n bigint, last_date date, bucket int, month string", ["bucket", "month"]),
    "detail": ("ledger_id string, flow string, category string, subcategory string, origin string, "
               f"amount {SUM}, n bigint, _last struct<date:date,row_id:string,bank_balance:decimal(18,2)>, bucket int, month string",
               ["bucket", "month"]),
    "balances": (f"ledger_id string, month string, net {SUM}, all_net {SUM}, last_balance decimal(18,2), opening {SUM}, closing {SUM}, "
                 f"bank_opening {SUM}, bank_closing {SUM}, bucket int, year int", ["bucket", "year"]),
}


def _same(left: DataFrame, right: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Join on equal columns where null is a value; the columns of ``left`` and those ``right`` adds."""
    named = right.select(*[F.col(c).alias(f"_r_{c}") for c in cols], *[c for c in right.columns if c not in cols])
    on = [left[c].eqNullSafe(named[f"_r_{c}"]) for c in cols]
    return left.join(named, on, how).drop(*[f"_r_{c}" for c in cols])


class MonthViews:
    """The month views stored at ``path``; ``opening`` holds (ledger_id, opening), ``flow`` the category lists of P12."""

    def __init__(self, spark: SparkSession, path: str, opening: DataFrame | None = None, min_year: int | None = None,
                 buckets: int = BUCKETS, excluded: str = EXCLUDED_FROM_BALANCE, **flow):
        self.spark, self.path, self.opening, self.min_year = spark, path.rstrip("/"), opening, min_year
        self.buckets, self.excluded, self.flow = buckets, excluded, flow

    # ---- refresh ------------------------------------------------------------------------------

    def refresh(self, rows: DataFrame, tag: str) -> None:
        """Take the ledger rows of batch ``tag`` into the views."""
        if files.exists(self.spark, f"{self.path}/applied/{tag}"):
            return
        pending = f"{self.path}/pending/{tag}"
        if not files.exists(self.spark, f"{pending}/READY"):
            self._prepare(rows, pending)
            files.touch(self.spark, f"{pending}/READY")
        for name in TABLES:
            self._replace(f"{pending}/{name}", f"{self.path}/{name}")
        files.touch(self.spark, f"{self.path}/applied/{tag}")
        files.delete(self.spark, pending)

    def _replace(self, pending: str, table: str) -> None:
        """Put the partitions of ``pending`` (two folder levels) in the place of the table's, folder by folder: they are written
        as they shall lie.  A folder that was moved is no longer pending, so a replay goes on where it stopped."""
        for a in files.names(self.spark, pending):
            for b in files.names(self.spark, f"{pending}/{a}") if "=" in a else ():
                files.replace(self.spark, f"{pending}/{a}/{b}", f"{table}/{a}/{b}")

    def rebuild(self, ledger: DataFrame, tag: str = "initial") -> None:
        """The views of a whole ledger, from nothing."""
        files.delete(self.spark, self.path)
        self.refresh(ledger, tag)

    def _stored(self, name: str) -> DataFrame:
        schema, _ = TABLES[name]
        if files.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], schema)

    def _delta(self, rows: DataFrame) -> DataFrame:
        led = A.with_flow(read_ledger(rows, min_year=self.min_year), **self.flow)
        bucket = F.pmod(F.xxhash64("ledger_id"), F.lit(self.buckets)).cast("int")
        return materialize(A.group_by_hash(led.withColumn("bucket", bucket), *KEYS, "concept").agg(
            F.sum("amount").cast(SUM).alias("amount"), F.count(F.lit(1)).alias("n"),
            F.max(F.struct("date", "row_id", "bank_balance")).alias("_last")).drop("_h"))

    def touched(self, name: str, delta: DataFrame) -> DataFrame:
        """The stored rows of the partitions that the delta touches.  The lists are bounded by the calendar and the
        buckets; as literals they prune the scan."""
        parts = [(r["bucket"], r["month"]) for r in delta.select("bucket", "month").distinct().collect()]
        pruned = self._stored(name).where(F.col("bucket").isin(sorted({b for b, _ in parts})) & F.col("month").isin(sorted({m for _, m in parts})))
        pairs = F.broadcast(self.spark.createDataFrame(parts, "bucket int, month string"))
        return pruned.join(pairs, ["bucket", "month"], "left_semi")

    def _prepare(self, rows: DataFrame, pending: str) -> None:
        def write(name, df):
            schema, parts = TABLES[name]
            df.write.mode("overwrite").partitionBy(*parts).parquet(f"{pending}/{name}")
            return self.spark.read.schema(schema).parquet(f"{pending}/{name}")

        delta = self._delta(rows)
        concepts = delta.withColumn("last_date", F.col("_last.date")).drop("_last")
        merged = self.touched("concepts", delta).unionByName(concepts)
        # dealt by partition before they are added up: the delta holds a key once, and the files are written by partition
        write("concepts", merged.repartition("bucket", "month").groupBy(*KEYS, "concept").agg(
            F.sum("amount").cast(SUM).alias("amount"), F.sum("n").alias("n"), F.max("last_date").alias("last_date")))
        sums = [F.sum("amount").cast(SUM).alias("amount"), F.sum("n").alias("n"), F.max("_last").alias("_last")]
        merged = self.touched("detail", delta).unionByName(A.group_by_hash(delta, *KEYS).agg(*sums).drop("_h"))
        detail = write("detail", merged.groupBy(*KEYS).agg(*sums).repartition("bucket", "month"))
        write("balances", self._balances(detail, delta.select("bucket", "ledger_id", "month").distinct()).repartition("bucket", "year"))

    def _balances(self, detail: DataFrame, months: DataFrame) -> DataFrame:
        """The balance partitions that hold a month from a touched ledger's first touched month on."""
        months = materialize(months)
        first = materialize(months.groupBy("bucket", "ledger_id").agg(F.min("month").alias("first")))
        span = first.agg(F.min("first"), F.collect_set("bucket")).first()          # one date and a list of buckets
        stored = self._stored("balances").where(F.col("bucket").isin(span[1] or []))
        old = _same(stored, first.drop("bucket"), ["ledger_id"], "left")           # first: null for untouched ledgers
        # the closing before the first touched month
        before = (old.where("month < first").groupBy("ledger_id")
                  .agg(F.max(F.struct("month", "closing", "bank_closing")).alias("anchor")))
        kept = _same(old.where("month >= first").select("ledger_id", "bucket", "month", "net", "all_net", "last_balance"),
                     months.drop("bucket"), ["ledger_id", "month"], "left_anti")
        fresh = _same(detail, months.drop("bucket"), ["ledger_id", "month"], "left_semi").groupBy("ledger_id", "bucket", "month").agg(
            F.coalesce(F.sum(F.when(F.col("category") != self.excluded, F.col("amount"))), zero()).cast(SUM).alias("net"),
            F.sum("amount").cast(SUM).alias("all_net"), F.max("_last")["bank_balance"].alias("last_balance"))
        suffix = _same(kept.unionByName(fresh), before, ["ledger_id"], "left")
        start = F.col("anchor.closing")
        if self.opening is not None:
            suffix = _same(suffix, self.opening.select("ledger_id", "opening"), ["ledger_id"], "left")
            start = F.coalesce(start, F.col("opening"))
        run = Window.partitionBy("ledger_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
        closing = (F.coalesce(start, zero()) + F.sum("net").over(run)).cast(SUM)
        w1 = suffix.select("ledger_id", "bucket", "month", "net", "all_net", "last_balance", closing.alias("closing"),
                           F.col("anchor.bank_closing").alias("_anchor"))
        w3 = bank_balance_from(w1.select("ledger_id", "month", F.col("all_net").alias("net"), F.col("last_balance").alias("_last"), "_anchor"))
        bank = w3.select("ledger_id", "month", F.col("opening").cast(SUM).alias("bank_opening"), F.col("closing").cast(SUM).alias("bank_closing"))
        new = _same(w1.drop("_anchor"), bank, ["ledger_id", "month"], "left").withColumn("opening", (F.col("closing") - F.col("net")).cast(SUM))
        new = materialize(new.withColumn("year", F.substring("month", 1, 4).cast("int")))
        # the other rows of the partitions that are replaced
        parts = F.broadcast(new.select("bucket", "year").distinct())
        others = stored.where(F.col("year") >= int((span[0] or "0")[:4])).join(parts, ["bucket", "year"], "left_semi")
        others = _same(others, new.select("ledger_id", "month"), ["ledger_id", "month"], "left_anti")
        return others.unionByName(new.select(*others.columns))

    # ---- reports ------------------------------------------------------------------------------

    def detail(self) -> DataFrame:
        return self._stored("detail").drop("bucket")

    def month_totals(self) -> DataFrame:
        """A1."""
        return A.months_from_detail(self.detail(), self.excluded).drop("net")

    def category_totals(self) -> DataFrame:
        """A2."""
        return A.categories_from_detail(self.detail())

    def subcategory_totals(self) -> DataFrame:
        """A3."""
        return A.subcategories_from_detail(self.detail())

    def category_groups(self) -> DataFrame:
        """A4 with the display rank O1."""
        lvl1 = self._stored("concepts").where(F.col("flow") == "expense").select(
            "ledger_id", "month", "category", "origin", "subcategory", "concept", F.col("n").alias("_n"),
            F.col("last_date").alias("_d"), F.col("amount").alias("_s"))
        return A.ranked_groups(A.groups_from_concepts(lvl1, ["ledger_id", "month", "category", "origin", "subcategory"]))

    def cross_table(self) -> DataFrame:
        """A5."""
        return cross_table_from_base(materialize(detail_base(self.detail())))

    def running_balance(self) -> DataFrame:
        """W1, W2."""
        return self._stored("balances").select("ledger_id", "month", "opening", "closing", "net")

    def bank_balance(self) -> DataFrame:
        """W3."""
        return self._stored("balances").select(
            "ledger_id", "month", F.col("bank_opening").alias("opening"), F.col("bank_closing").alias("closing"), F.col("all_net").alias("net"))
