"""Rule mining: patterns are mined once for all sheets; the first row of a pattern, with odd ids and concepts."""

from ledgerline.operators import mining as G
from ledgerline.plans import maintenance as M

from conftest import SF_SMALL


def test_rule_sheets_mine_once(spark, monkeypatch):
    mine, review, mined, used = G.mine_patterns, G.rule_review_patterns, [], []
    monkeypatch.setattr(G, "mine_patterns", lambda rows: mined.append(1) or mine(rows))
    monkeypatch.setattr(G, "rule_review_patterns", lambda pats, *rest: used.append(pats) or review(pats, *rest))
    assert M.union_rules(spark, SF_SMALL).count() > 0
    assert len(mined) == 1 and "Aggregate" not in used[0]._jdf.queryExecution().optimizedPlan().toString()


def test_pattern_example_normalises_each_concept_once(spark):
    data = [("b", "Super  Mayor 12"), ("a", "SUPER-MAYOR 7"), ("a", "SUPER-MAYOR 7"), ("c", "super mayor"), ("d", "TAXI 1"),
            (None, "KIOSCO 3"), ("e", None), ("f", "KIOSCO 4")]
    rows = spark.createDataFrame(data, "row_id string, concept string")
    pats = spark.createDataFrame([("MAYOR",), ("TAXI",), ("KIOSCO",), ("NADA",)], "pattern string")
    want = {"MAYOR": "SUPER-MAYOR 7", "TAXI": "TAXI 1", "KIOSCO": "KIOSCO 4", "NADA": ""}
    for given in (rows, G.tokenize(rows)):
        assert dict(map(tuple, G.pattern_example(given, pats).collect())) == want
