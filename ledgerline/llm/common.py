"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is; null counts as empty."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, UPPER.lower())


def by_position(df: DataFrame) -> DataFrame:
    """``df`` with columns c0, c1, ...: added columns can't clash with its own, which may have any names."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def keep_rows(df: DataFrame, cols: list[str], make_test: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows of which the values of ``cols`` pass the test; all columns as they were, nothing is shuffled.
    ``make_test`` runs once in each task."""
    at = [df.columns.index(c) for c in cols]

    def run(batches):
        test = make_test()
        for b in batches:
            values = zip(*((x.as_py() for x in b.column(i)) for i in at))      # one row's texts at a time
            yield b.filter(pa.array([test(*v) for v in values], pa.bool_()))

    plain = by_position(df)
    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


#: column of ``with_row_key``
ROW = "__row"


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with ``ROW``, a 256-bit digest of all columns: what is decided on a row is kept by it, so ids may
    repeat or be null.  Only equal rows share a key."""
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != ROW]))
    return df.withColumn(ROW, F.unhex(F.sha2(whole.cast("binary"), 256)))


def ranked(id_: Column, keep: str = "min") -> Column:
    """(absent, id, key) of a keyed row: the order in which one row of a class is kept, null ids last."""
    absent = id_.isNull() if keep == "min" else id_.isNotNull()
    return F.struct(absent.alias("absent"), id_.alias("id"), F.col(ROW).alias("key"))


def drop_rows(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key is not in the one column of ``keys``, a written table: Spark broadcasts it when it
    is small and shuffles else.  ``ROW`` stays."""
    gone = keys.toDF("__gone")
    return keyed.join(gone, keyed[ROW] == gone["__gone"], "left_anti")


def one_per_class(keyed: DataFrame, decided: DataFrame) -> DataFrame:
    """One row for each class; ``decided`` is a written table of (key, kept) of every row, where only the class's
    first key is kept.  Equal rows share it, so those (normally none) collapse at the end."""
    left = drop_rows(keyed, materialize(decided.where("not kept").select("key").distinct()))
    again = materialize(decided.where("kept").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    if not again.isEmpty():
        equal = left.join(again, left[ROW] == again["key"], "left_semi").dropDuplicates([ROW])
        left = drop_rows(left, again).unionByName(equal)
    return left.drop(ROW)
