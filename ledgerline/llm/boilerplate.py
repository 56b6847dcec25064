"""Line de-duplication by site-relative frequency.

For each host, the share of its pages that contain a line is the number of pages with the line over the
number of pages of the host; lines over ``ratio`` are boilerplate and are dropped from every page of that host.
A page counts once per line, however often it repeats it.  The ratio decides on hosts of every size; a line on
a single page (fewer than ``min_pages``) repeats nothing and stays, whatever its share of a small host.

Counting is a map-side combined aggregation over (host, line), compared as whole lines; a hot host is spread
over its lines.  What is dropped is one list per host, no longer than the host's mean number of lines over
``ratio``; it is written as a table, so the join back broadcasts it when it is small and splits hot hosts
as a skewed join else.

Defined cases: a page without a host keeps all its lines and counts nowhere; a null or empty text has no
lines; lines are trimmed of spaces and empty ones are no lines; every row is a page, so repeated rows count
each; an empty table gives no rows.  Only the columns behind the three expressions are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize

RATIO = 0.05
MIN_PAGES = 2

BLOCK_TAG = (r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|hr|tr|td|th|table|section|article|header|footer|nav|title|body|html|head)"
             r"\b[^>]*>")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1)
    return F.when(host != "", host)


def lines_of_html(html: Column) -> Column:
    """The text of a page, one line per block: scripts, styles and comments go, other tags vanish."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b[^>]*>.*?</script>", "")
    text = F.regexp_replace(text, r"(?is)<style\b[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(text, BLOCK_TAG, "\n"), r"<[^>]*>", "")


def drop_boilerplate(df: DataFrame, key: Column, host: Column, text: Column, ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per row of ``df``: ``key``, ``host``, ``n_lines``, ``n_dropped`` and ``kept``, the remaining
    lines joined by line feeds."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    pages = materialize(df.select(key.alias("key"), host.alias("host"), lines.alias("lines")))
    hosted = pages.where(F.col("host").isNotNull())
    totals = hosted.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    pages_with = (hosted.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line")
                  .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    common = pages_with.join(totals, "host").where(F.col("n") > ratio * F.col("total"))
    drops = materialize(common.groupBy("host").agg(F.collect_list("line").alias("drop")))
    joined = pages.join(drops, "host", "left").withColumn(
        "rest", F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
            F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), x))))
    return joined.select("key", "host", F.size("lines").cast("long").alias("n_lines"),
                         (F.size("lines") - F.size("rest")).cast("long").alias("n_dropped"),
                         F.array_join("rest", "\n").alias("kept"))
