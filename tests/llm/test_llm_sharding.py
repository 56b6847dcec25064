"""The lookup table's balance and stability, and edge rows."""

from collections import Counter

import pytest

from ledgerline.llm import sharding as S


def test_balance_and_little_movement():
    full = S.lookup_table()
    sizes = Counter(full)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    fewer = S.lookup_table(S.SHARDS[:-1])
    moved = sum(a != b for a, b in zip(full, fewer) if a != S.SHARDS[-1])
    assert moved / len(full) < 0.25                       # a plain modulus would move about 15 of 16


def test_first_claims_follow_the_preferences():
    table, taken = S.lookup_table(("a", "b", "c"), 11), {}
    prefs = {s: list(S._preferences(s, 11)) for s in "abc"}
    for turn in range(11):
        s = "abc"[turn % 3]
        slot = next(x for x in prefs[s] if x not in taken)
        taken[slot] = s
    assert table == [taken[i] for i in range(11)]
    assert all(sorted(p) == list(range(11)) for p in prefs.values())


@pytest.mark.parametrize("shards,size", [((), 7), (("a", "a"), 7), (("a",), 8), (tuple("abcdefgh"), 7)])
def test_bad_parameters(shards, size):
    with pytest.raises(ValueError):
        S.lookup_table(shards, size)


def test_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 5), (1, "y", 6), (None, "z", 7), (2, None, 8)], "doc_id long, shard string, slot int")
    rows = S.assign_shards(df.withColumnRenamed("shard", "kept")).collect()
    assert len(rows) == 4 and {r["shard"] for r in rows} <= set(S.SHARDS)
    assert len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    again = S.assign_shards(df).collect()                  # clashing columns are replaced
    assert again[0].asDict().keys() == {"doc_id", "slot", "shard"}
    assert S.assign_shards(df.limit(0)).count() == 0
    S.write_shards(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7)], "doc_id long, __key int, __at int, __slot int, __shard int, c0 int, Slot int")
    out = S.assign_shards(df)
    assert out.columns == ["doc_id", "__key", "__at", "__slot", "__shard", "c0", "slot", "shard"]
    assert tuple(out.first())[:6] == (1, 2, 3, 4, 5, 6)
    assert out.first()["shard"] == S.assign_shards(df.select("doc_id")).first()["shard"]
    assert S.assign_shards(df, "Slot").count() == 1             # the key may be a column that is replaced
    S.write_shards(df, str(tmp_path / "out"))


def test_no_python_on_the_executors(spark):
    df = S.assign_shards(spark.range(10).withColumnRenamed("id", "doc_id"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan and "BroadcastHashJoin" in plan


def test_query_writes_whole_documents(spark):
    from conftest import SF_SMALL
    from ledgerline.llm.queries import op2_sharding
    out = op2_sharding(spark, SF_SMALL)
    assert out.columns == ["doc_id", "slot", "shard"]
    files = out.inputFiles()
    assert files and all("/shard=shard-" in f for f in files)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    written = spark.read.parquet(files[0].split("/shard=")[0]).select(docs.columns)
    assert sorted(map(repr, written.collect())) == sorted(map(repr, docs.collect()))
