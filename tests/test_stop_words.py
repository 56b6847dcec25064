"""Stop words as arguments of mining and of the naive Bayes labeller."""

from ledgerline.operators import mining as M
from ledgerline.operators import model as N


def test_mining_and_labeller_take_stop_words(spark):
    rows = spark.createDataFrame([(str(i), f"ZORK BLIP {w}", "", "", "", "A") for i, w in enumerate(["UNO", "DOS", "TRES", "CUATRO"])],
                                 "row_id string, concept string, reference string, destination string, origin string, label string")
    mined = lambda **kw: {r["pattern"] for r in M.mine_patterns(rows, **kw).collect()}
    assert {"ZORK", "BLIP"} <= mined()
    assert mined(stop_words=("ZORK",)) == {"BLIP"}
    assert M.unmatched_concepts(rows, M.mine_patterns(rows), stop_words=("ZORK", "BLIP")).count() == 4
    amounts = rows.selectExpr("*", "cast(1 as decimal(18,2)) debit", "cast(null as decimal(18,2)) credit")
    tokens = lambda **kw: {t for r in N.with_model_tokens(amounts, "label", **kw).collect() for t in r["tokens"]}
    default = tokens()
    assert {t.upper() for t in default} >= {"ZORK", "BLIP"}
    word = next(t for t in default if t.upper() == "ZORK")
    assert tokens(stop_words=(word,)) == default - {word}
