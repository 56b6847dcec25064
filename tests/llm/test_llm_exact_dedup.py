"""Exact de-duplication: classes, collisions of the hash, edge rows and the filter."""

import hashlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import exact_dedup as X

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

ROWS = [(1, "Same Text"), (2, "same text"), (7, "SAME TEXT"), (3, "other"), (4, None), (5, ""), (6, "É"), (8, "é"), (9, "É"),
        (10, "x" * 200_000), (11, "X" * 200_000), (None, "other"), (None, "lone"), (None, "lone"), (3, "other"), (12, "ok ")]


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    out = []
    for i, t in rows:
        text = (t or "").translate(LOWER)
        ids = [x for x in groups[text] if x is not None]
        k = keep(ids) if ids else None
        out.append((i, k, len(groups[text]), i == k, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def frame(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, hash string, keep_id int")


def collide(text):
    return F.octet_length(text).cast("string").cast("binary")          # equal lengths collide


@pytest.mark.parametrize("digest", [X.md5_128, collide])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_classes(spark, keep, digest):
    got = sorted((tuple(r) for r in X.exact_classes(frame(spark), keep=keep, digest=digest).collect()), key=repr)
    assert got == brute(ROWS, {"min": min, "max": max}[keep])


def test_filter_keeps_the_columns(spark):
    out = X.drop_exact_copies(frame(spark))
    assert out.columns == ["doc_id", "text", "hash", "keep_id"]
    kept = sorted((r["doc_id"] for r in out.collect()), key=repr)
    assert kept == sorted([1, 3, 3, 4, 6, 8, 10, 12, None, None, None], key=repr)
    assert X.drop_exact_copies(frame(spark).limit(0)).count() == 0


def test_empty_table(spark):
    assert X.exact_classes(frame(spark).limit(0)).count() == 0
