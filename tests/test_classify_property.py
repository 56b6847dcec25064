"""Property: every rule-labelling strategy gives the same labels as a direct reading of the rules."""

import re
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.operators import classify as C
from ledgerline.sources.rules import load_rules

WORDS = ["RING", "BOLT", "SMALL", "RED", "AB", "X", "GEAR 7", "SM"]
SCHEMA = "ord int, pattern string, lo string, hi string, category string, subcategory string, origin string, kind string"

rule_st = st.tuples(st.sampled_from(WORDS + [""]), st.sampled_from([None, "0", "50", "500"]),
                    st.sampled_from([None, "100", "1000"]), st.sampled_from(["A", "B", "C"]),
                    st.sampled_from(["", "s"]), st.sampled_from(["", "o"]))
row_st = st.tuples(st.lists(st.sampled_from(WORDS + ["12", "-", "."]), max_size=4),
                   st.sampled_from(["0.00", "49.99", "50.00", "100.00", "999.00", "2000.00"]))


def _norm(s):
    s = re.sub(r"[.*\-/]", " ", s.upper())
    s = re.sub(r"[0-9]+", " ", s)
    return re.sub(r"\s+", " ", s).strip()


def _expected(rules, concept, amount):
    ranked = []
    for o, (p, lo, hi, cat, sub, org) in enumerate(rules, 1):
        if not cat or (not p and lo is None and hi is None):
            continue
        spec = (1 if p else 0) + (1 if lo is not None or hi is not None else 0)
        outs = (1 if sub else 0) + (1 if org else 0)
        ranked.append(((-spec, -outs, -len(p), o), p, lo, hi, cat))
    if not concept.strip():
        return "Sin clasificar"
    for _, p, lo, hi, cat in sorted(ranked):
        if p and p not in concept.upper() and p not in _norm(concept):
            continue
        if lo is not None and D(amount) < D(lo):
            continue
        if hi is not None and D(amount) > D(hi):
            continue
        return cat
    return "Sin clasificar"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(rule_st, min_size=1, max_size=6), st.lists(row_st, min_size=1, max_size=6))
def test_strategies_agree_with_direct_reading(spark, rules, rows):
    raw = spark.createDataFrame([(i + 1, *r[:3], r[3], r[4], r[5], "") for i, r in enumerate(rules)], SCHEMA)
    ranked = load_rules(raw)
    data = [(str(i), " ".join(ws), D(a)) for i, (ws, a) in enumerate(rows)]
    df = spark.createDataFrame([(*d, None) for d in data],
                               "row_id string, concept string, debit decimal(18,2), credit decimal(18,2)")
    exp = {rid: _expected(rules, c, str(a)) for rid, c, a in data}
    for strategy in ("case", "join", "distinct", "index"):
        got = {r["row_id"]: r["new_category"] for r in C.classify(df, ranked, strategy).collect()}
        assert got == exp, strategy


def test_many_amount_rules_need_no_pairwise_join(spark):
    """More amount-only rules than a CASE chain takes: equal to a direct reading, and only equi-joins in the plan."""
    import random
    rnd = random.Random(9)
    for n in (40, 400):
        rules = []
        for i in range(n):
            lo, hi = (rnd.choice([None, str(rnd.randrange(3000) / 4)]) for _ in range(2))
            if lo is None and hi is None:
                hi = "10"
            rules.append(("", lo, hi, f"C{i}", rnd.choice(["", "s"]), ""))
        raw = spark.createDataFrame([(i + 1, *r, "") for i, r in enumerate(rules)], SCHEMA)
        ranked = load_rules(raw)
        amounts = [f"{rnd.randrange(0, 80000) / 100:.2f}" for _ in range(150)] + ["0.00", "9999999999999999.99"]
        data = [(str(i), rnd.choice(["RING", "BOLT 7", " "]), D(a)) for i, a in enumerate(amounts)]
        df = spark.createDataFrame([(*d, None) for d in data], "row_id string, concept string, debit decimal(18,2), credit decimal(18,2)")
        out = C.classify(df, ranked, "index")
        assert {r["row_id"]: r["new_category"] for r in out.collect()} == {i: _expected(rules, c, str(a)) for i, c, a in data}
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_stabbing_is_exact_at_the_bounds(spark):
    rows = [("0", "0", 5), ("10.01", "10.01", 4), ("10", "20.5", 3), (None, "7", 2), ("1000", None, 1), ("30", "20", 0), ("-5", "-1", 0)]
    iv = spark.createDataFrame(rows, "lo string, hi string, v int").selectExpr("cast(lo as decimal(18,2)) lo", "cast(hi as decimal(18,2)) hi", "v")
    points = [D(x) for x in ("0.00", "6.99", "7.00", "7.01", "10.00", "10.01", "20.50", "20.51", "999.99", "1000.00", "9999999999999999.99")]
    pts = spark.createDataFrame([(p,) for p in points], "p decimal(18,2)")
    got = {r["p"]: r["v"] for r in C.stab_intervals(pts, "p", iv, "v").collect()}
    want = {p: min((v for lo, hi, v in rows if (lo is None or D(lo) <= p) and (hi is None or p <= D(hi))), default=None) for p in points}
    assert got == {p: v for p, v in want.items() if v is not None}


def _contained(texts, patterns):
    return sorted((t, p) for t in texts for p in patterns if p and (p in t or p in t[::-1]))


def test_patterns_of_common_grams_only(spark):
    """Every gram of most patterns is in a third of the texts or more: equal to a direct reading, each pair once, and
    the texts of a hot key are dealt over salts."""
    import random
    rnd = random.Random(5)
    texts = sorted({"".join(rnd.choice(["PAGO TARJETA ", "PAGO ", "TARJETA ", "AB", "X", "RECIBO "]) for _ in range(rnd.randrange(1, 5)))
                    for _ in range(400)})
    patterns = ["PAGO", "PAGO TARJETA", "TARJETA", "PAG", "AG", "P", "ARJETA PAGO", "RECIBO X", "XX", "PAGOS", "AAA", "OGAP", ""]
    df = spark.createDataFrame([(t, t[::-1]) for t in texts], "t string, r string")
    pats = spark.createDataFrame([(p, i) for i, p in enumerate(patterns + ["PAGO"])], "pattern string, no int")
    want = sorted([*_contained(texts, patterns), *((t, "PAGO") for t, p in _contained(texts, patterns) if p == "PAGO")])
    for bound in (C.HOT_TEXTS, 7, 1):
        got = C.gram_matches(df, ["t", "r"], pats, hot_texts=bound)
        assert sorted((r["t"], r["pattern"]) for r in got.collect()) == want, bound
        assert sorted(got.columns) == ["no", "pattern", "r", "t"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_hot_key_is_split(spark):
    """3,000 of 9,000 texts share their grams with ten patterns: no task of the matching gets them all."""
    from pyspark.sql import functions as F
    n = 9000
    df = spark.range(n).select(F.concat(F.when(F.col("id") % 3 == 0, "PAGO TARJETA ").otherwise("Q"), F.col("id").cast("string")).alias("t"))
    pats = spark.createDataFrame([(p,) for p in ("PAGO", "PAGO ", "AGO T", "TARJETA", "TARJE", "RJETA", "ETA", "GO TA", "O TARJ", "JETA ")], "pattern string")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in zip(keys, ("-1", "-1", "false", "16")):
            spark.conf.set(k, v)
        out = C.gram_matches(df, ["t"], pats, hot_texts=100).withColumn("task", F.spark_partition_id())
        per_task = {r["task"]: r["count"] for r in out.groupBy("task").count().collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(per_task.values()) == 10 * n // 3
    assert max(per_task.values()) < 10 * n // 3 / 5


def test_intervals_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(C, "INTERVALS_PER_TASK", 50)
    bounds = F.col("id") % 400
    own = spark.range(1000).coalesce(1).select(bounds.cast("decimal(38,10)").alias("lo"), (bounds + 3).cast("decimal(38,10)").alias("hi"),
                                               F.struct(F.col("id").alias("o")).alias("rule"))
    dealt = C.dealt_intervals(own, "rule")
    assert dealt.rdd.getNumPartitions() == 21
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 100
    points = spark.range(500).select(F.col("id").cast("decimal(18,2)").alias("amt"))
    got = {int(r["amt"]): r["rule"]["o"] for r in C.stab_intervals(points, "amt", own, "rule").collect()}
    want = {p: min(o for o in range(1000) if o % 400 <= p <= o % 400 + 3) for p in range(403)}
    assert got == want
    monkeypatch.setattr(C, "MAX_BROADCAST_RULES", 300)                   # some levels broadcast, some not
    assert {int(r["amt"]): r["rule"]["o"] for r in C.stab_intervals(points, "amt", own, "rule").collect()} == want
