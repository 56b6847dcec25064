"""Chat formatting: reversible escapes, the role machine, loss flags and edge rows."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.llm import chat as C

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "[OUT] ", "[ROLE]", "[/ROLE] ", " [/END]", "[SYS] ", "\\", "<", "[", "x", "\n", " ", "é", "$1"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE] "]),
                                   st.lists(st.sampled_from(BITS), max_size=8).map("".join)), min_size=1, max_size=5),
                min_size=1, max_size=8))
def test_every_conversation_reads_back(spark, convs):
    rows = [(i, t, r, x) for i, conv in enumerate(convs) for t, (r, x) in enumerate(conv)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = C.format_chats(df)
    got = out.select("conv_id", C.read_chats(F.col("formatted")).alias("turns"), C.loss_text(F.col("segments")).alias("loss"))
    for r in got.collect():
        conv = convs[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == conv
        assert r["loss"] == "".join(x for role, x in conv if role == "assistant")


def flags(spark, roles):
    df = spark.createDataFrame([(1, i, r, "t") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")
    r = C.format_chats(df).first()
    return r["valid"], r["complete"]


def test_machine(spark):
    assert flags(spark, ["system", "user", "assistant"]) == (True, True)
    assert flags(spark, ["user", "assistant", "user"]) == (True, False)
    for bad in (["assistant"], ["user", "user"], ["user", "system"], ["system", "system"], ["user", "tool"], ["system", "assistant"], [None]):
        assert flags(spark, bad) == (False, False)


def test_edges(spark):
    rows = [(None, 0, "user", "lost"), (None, 1, "assistant", "too"), (1, 1, "assistant", None), (1, 0, "user", ""),
            (2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, "system", "first"), (3, 0, None, "no role"),
            (4, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in C.format_chats(df).withColumn("turns", C.read_chats(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[None]["turns"]] == [("user", "lost"), ("assistant", "too")]
    assert [tuple(t) for t in out[1]["turns"]] == [("user", ""), ("assistant", "")] and out[1]["valid"]
    assert [t["text"] for t in out[2]["turns"]] == ["first", "same", "same"] and not out[2]["valid"]
    assert [tuple(t) for t in out[3]["turns"]] == [("", "no role")]
    assert len(out[4]["turns"][0]["text"]) == 300_000
    assert [s["loss"] for s in out[1]["segments"]] == [False] * 4 + [True, False]
    assert C.format_chats(df.limit(0)).count() == 0


def test_no_python_on_the_executors(spark):
    df = spark.range(3).selectExpr("id as conv_id", "id as turn", "'user' as role", "'x' as text")
    assert "Python" not in C.format_chats(df)._jdf.queryExecution().toString()
