"""Exact de-duplication: group by a 128-bit content hash, compare the bytes, keep one stable id.

The grouping key of the first aggregation is (hash, normalised text): Spark compares the whole key,
so texts with equal hashes and different bytes stay apart.  Copies collapse map-side, so a text that
a third of all rows share moves once per task.  What follows is narrow: every row finds its class
by the hash alone, and only rows of a collided hash (normally none) meet their texts again.

Defined cases: a null text is empty; empty texts are equal to each other; rows with the same id and
equal texts all count and share their flag; a null id never wins over another, and a class whose
ids are all null has a null ``keep_id`` and keeps all its rows; an empty table gives no rows.  The classes
read only the id and text columns, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import ROW, by_position, drop_rows, lower_ascii, ranked, with_row_key
from ledgerline.session import materialize


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                  digest: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of ``df``: ``id``, ``keep_id`` (the id that stays: the smallest, or the
    largest with ``keep="max"``), ``group_size``, ``kept`` and ``text_sha256``."""
    pick = {"min": F.min, "max": F.max}[keep]
    rows = df.select(F.col(f"`{id_col}`").alias("id"), lower_ascii(F.col(f"`{text_col}`")).alias("text"))
    keyed = rows.withColumn("hash", digest(F.col("text")))
    by_text = keyed.groupBy("hash", "text").agg(pick("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    classes = materialize(by_text.select("hash", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
                                         "keep_id", "group_size"))
    collided = materialize(classes.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"))
                           .where(F.col("texts") > 1).select("hash"))
    if collided.isEmpty():
        out = keyed.select("id", "hash").join(classes, "hash")
    else:
        alone = keyed.select("id", "hash").join(classes.join(collided, "hash", "left_anti"), "hash")
        texts = by_text.join(collided, "hash", "left_semi").withColumn(
            "text_sha256", F.sha2(F.col("text").cast("binary"), 256))
        clashing = keyed.join(collided, "hash", "left_semi").join(texts, ["hash", "text"]).drop("text")
        out = alone.unionByName(clashing)
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      "text_sha256")


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min",
                      lenient: bool = True) -> DataFrame:
    """``df`` without the rows whose text an other kept row has; all columns as they were.  ``lenient``: rows with a
    null id and all rows with the kept id stay; else one row of each text stays, null ids last."""
    plain = by_position(df)
    id_, text = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    if lenient:
        keyed = with_row_key(plain)
        rows = keyed.select(ranked(F.col(id_), keep).alias("id"), F.col(text).alias("text"))
        found = exact_classes(rows, "id", "text", keep)
        gone = found.where("id.id is not null and not (id.id <=> keep_id.id)").select("id.key")
        return drop_rows(keyed, materialize(gone.distinct())).drop(ROW).toDF(*df.columns)
    # the first row of each (hash, text) goes through one shuffle; each task sends one row of a text at most
    low = lower_ascii(F.col(text))
    best = F.col(id_).asc_nulls_last() if keep == "min" else F.col(id_).desc_nulls_last()
    ties = [f.name for f in plain.schema.fields if f.dataType.typeName() not in ("map", "variant") and f.name != id_]
    order = Window.partitionBy("hash", "low").orderBy(best, *ties)
    ranks = plain.withColumn("hash", md5_128(low)).withColumn("low", low).withColumn("rank", F.row_number().over(order))
    return ranks.where("rank = 1").drop("hash", "low", "rank").toDF(*df.columns)
