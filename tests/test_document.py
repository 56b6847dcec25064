"""The per-ledger JSON document (S5) agrees with the SQL-checked queries it is made of."""

import json

import __spark_entry__ as E

from conftest import SF_SMALL


def _rows(spark, name):
    return E.queries()[name](spark, SF_SMALL).collect()


def test_document_matches_component_queries(spark):
    docs = {r["ledger_id"]: json.loads(r["document"]) for r in _rows(spark, "write_document")}
    months = {(r["ledger_id"], r["month"]): r for r in _rows(spark, "month_totals")}
    bal = {(r["ledger_id"], r["month"]): r for r in _rows(spark, "running_balance")}
    bank = {(r["ledger_id"], r["month"]): r for r in _rows(spark, "bank_balance")}
    top = {}
    for r in _rows(spark, "top_movements"):
        top.setdefault((r["ledger_id"], r["month"]), []).append((r["rank"], r["total"], r["concept"]))
    avg = {(r["ledger_id"], r["category"]): r["average"] for r in _rows(spark, "category_average")}
    review = {r["ledger_id"]: r["n_review"] for r in _rows(spark, "review_count") if r["ledger_id"] is not None}

    assert set(docs) == {k[0] for k in months}
    for led, d in docs.items():
        assert d["n_review"] == review[led]
        assert [m["id"] for m in d["months"]] == sorted(m for (l, m) in months if l == led)
        for m in d["months"]:
            ref = months[(led, m["id"])]
            assert m["expense_total"] == ref["expense_total"] and m["income_total"] == ref["income_total"]
            assert m["label"] == ref["label"]
            got = [(t["rank"], t["m"], t["c"]) for t in (m["top_movements"] or [])]
            assert got == sorted(top.get((led, m["id"]), []))
        cross = d["cross"]
        for i, mo in enumerate(cross["months"]):
            assert cross["opening"][i] == bal[(led, mo)]["opening"]
            assert cross["closing"][i] == bal[(led, mo)]["closing"]
        for a in d["account"]:
            assert a["balance"] == bank[(led, a["id"])]["closing"]
        for c, v in (d["averages"] or {}).items():
            assert v == avg[(led, c)]
