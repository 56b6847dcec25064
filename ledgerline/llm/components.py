"""Connected components of a link table by alternating large and small stars.

Each round rewires links to the smallest neighbour; the table is written to the shared checkpoint
folder after each round, so a lost executor costs one round.  Nothing but a row count and a checksum
comes to the driver.  Links are aggregated (min per node, map-side first) and joined, so a hub with a
third of all links is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.withColumnRenamed("m", "v")).where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has two columns of one ordered type.  Returns (node, root): the smallest node of its
    component for every node that has a link; the smallest nodes themselves are included."""
    a, b = links.columns
    now = links.toDF("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(now.distinct())
    state = _state(now)
    while state[0]:
        nxt = materialize(_small_star(_large_star(now)))
        after = _state(nxt)
        now = nxt
        if after == state:
            break
        state = after
    members = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return members.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
