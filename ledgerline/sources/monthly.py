"""The ledger stored by month and ledger bucket (S3), so that an import reads only what its batch can meet.

Inside each layer (see ``layers``) rows lie in ``part_month=<yyyymm>/part_bucket=<hash bucket of the ledger>`` folders; undated
rows are in month 0.  ``batch_id`` stays a column of the rows, so it survives the merging of batches.
``around`` gives the rows of a batch's months and buckets: the two lists are bounded by the calendar and the number of
buckets, and as literals on partition columns they prune files before anything is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.layers import FAN_IN, Layers

BUCKETS = 16            # choose them such that a bucket's month is about one file
ROWS = ("ledger_id string, row_id string, batch_id string, kind string, origin string, category string, subcategory string, date date, "
        "concept string, debit decimal(18,2), credit decimal(18,2), bank_balance decimal(18,2), reference string, destination string, review boolean")
PARTS = ("part_month", "part_bucket")


def month_number(date) -> Column:
    """yyyymm as a number; 0 without a date."""
    return F.coalesce(F.year(date) * 100 + F.month(date), F.lit(0))


class MonthLedger:
    """A ledger at ``path``.  ``schema`` may name more columns than S3's; columns that a batch lacks are null."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, schema: str = ROWS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.columns = spark.createDataFrame([], schema).schema
        self.layers = Layers(spark, path, f"{schema}, part_month int, part_bucket int", PARTS)

    def _bucket(self, ledger_id) -> Column:
        return F.pmod(F.xxhash64(ledger_id), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, tag: str) -> None:
        """S3: add the rows of batch ``tag``, or replace them if it was written before."""
        cols = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.columns if f.name != "batch_id"]
        self.layers.append(rows.select(*cols, F.lit(tag).alias("batch_id"), month_number(F.col("date").cast("date")).alias("part_month"),
                                       self._bucket("ledger_id").alias("part_bucket")), tag)

    def read(self, without: str | None = None) -> DataFrame:
        return self.layers.read(without).drop(*PARTS)

    def batch(self, tag: str) -> DataFrame:
        return self.layers.batch(tag).drop(*PARTS)

    def around(self, batch: DataFrame, date: str = "date", without: str | None = None) -> DataFrame:
        """The rows in the months and buckets of ``batch`` (ledger_id, ``date``)."""
        part = F.struct(month_number(F.col(date).cast("date")).alias("m"), self._bucket("ledger_id").alias("b"))
        found = batch.agg(F.collect_set(part["m"]).alias("m"), F.collect_set(part["b"]).alias("b")).first()
        rows = self.layers.read(without)
        return rows.where(F.col("part_month").isin(found["m"]) & F.col("part_bucket").isin(found["b"])).drop(*PARTS)

    def compact(self, fan_in: int = FAN_IN, keep: tuple[str, ...] = ()) -> str | None:
        """Merge batches into larger files, all columns kept."""
        return self.layers.compact(fan_in, keep=keep)

    def vacuum(self) -> list[str]:
        return self.layers.vacuum()

    def known(self, tag: str):
        """The ledger as batch ``tag`` finds it, for the import."""
        return Before(self, tag)


class Before:
    """The ledger without one batch."""

    def __init__(self, ledger: MonthLedger, tag: str):
        self.ledger, self.tag = ledger, tag

    def around(self, batch: DataFrame, date: str = "date") -> DataFrame:
        return self.ledger.around(batch, date, self.tag)


class BatchFolders:
    """A ledger with one folder for each batch and nothing else, as other writers may keep it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def known(self, tag: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("batch_id") != tag)

    def append(self, rows: DataFrame, tag: str) -> None:
        rows.drop("batch_id").write.mode("overwrite").parquet(f"{self.path}/batch_id={tag}")

    def batch(self, tag: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/batch_id={tag}")
