"""Shared plumbing of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.session import scratch_path
from ledgerline.sources import adapter
from ledgerline.sources.ledger import read_ledger


def finalize(df: DataFrame) -> DataFrame:
    """Last projection of the output contract: money → double (after exact decimal sums),
    integers → bigint, dates → ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def by_year(df: DataFrame) -> DataFrame:
    """``df`` written once, in a folder for each year of ``date`` (the added column ``_year``): what takes it year by year reads
    each year's files, and the tables behind it are not joined anew each time."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "by-year")
    rows = df.withColumn("_year", F.year("date"))
    rows.write.partitionBy("_year").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def ledger(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    """The report view of the adapter ledger (S2) from the first year of the data."""
    kw.setdefault("min_year", adapter.FIRST_YEAR)
    return read_ledger(adapter.movements(spark, sf_dir), **kw)
