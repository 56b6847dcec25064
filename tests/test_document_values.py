"""document_values lists every number that the documents hold, on rows made here."""

import json
from collections import Counter
from datetime import datetime

import pytest

import __spark_entry__ as E

PARTS = [(1, "red gear", "ECONOMY"), (2, "red nut", "ECONOMY"), (3, "blue cog", "PROMO"), (4, "old ring", "SMALL")]
SUPPLIERS = [(1, 1, 10.0), (2, 2, 20.0)]
# part, supplier (ledger), flag, status ('O': card), day, price
LINES = [(1, 1, "A", "O", (1998, 1, 10), 100.0), (1, 1, "A", "F", (1998, 2, 10), 40.0), (2, 1, "A", "O", (1998, 2, 11), 7.0),
         (3, 1, "R", "O", (1998, 1, 12), 500.0), (4, 1, "A", "F", (1998, 1, 13), 9.0),
         (1, 2, "A", "F", (1998, 3, 1), 60.0)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")

    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")

    write("part", [(k, n, "Brand#1", t) for k, n, t in PARTS], "p_partkey long, p_name string, p_brand string, p_type string")
    write("supplier", SUPPLIERS, "s_suppkey long, s_nationkey int, s_acctbal double")
    write("lineitem", [(i, p, s, 1, 1.0, price, 0.0, flag, status, datetime(*day)) for i, (p, s, flag, status, day, price) in enumerate(LINES)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
          "l_returnflag string, l_linestatus string, l_shipdate timestamp")
    return str(d)


@pytest.fixture(scope="module")
def values(spark, tables):
    return E.queries()["document_values"](spark, tables).collect()


def test_cross_tables_are_whole(values):
    """The subcategories and totals of both cross tables, and the card's section totals."""
    got = {s: {(r["ledger_id"], r["key"], r["month"]): r["value"] for r in values if r["section"] == s} for s in {r["section"] for r in values}}
    jan, feb, food = "1998-01", "1998-02", "Supermercado"
    assert got["cross expense sub"] == {("1", f"{food}|gear", jan): 100.0, ("1", f"{food}|gear", feb): 40.0, ("1", f"{food}|nut", jan): 0.0,
                                        ("1", f"{food}|nut", feb): 7.0, ("2", f"{food}|gear", "1998-03"): 60.0}
    assert got["cross expense total"] == {("1", food, None): 147.0, ("1", "Servicios", None): 9.0, ("2", food, None): 60.0}
    assert got["card expense sub"] == {("1", f"{food}|gear", jan): 100.0, ("1", f"{food}|gear", feb): 0.0, ("1", f"{food}|nut", jan): 0.0,
                                       ("1", f"{food}|nut", feb): 7.0}
    assert got["card expense total"] == {("1", food, None): 107.0}
    for part in ("cross", "card"):
        assert got[f"{part} income sub"] == {("1", "Otros ingresos|cog", jan): 500.0, ("1", "Otros ingresos|cog", feb): 0.0}
        assert got[f"{part} income total"] == {("1", "Otros ingresos", None): 500.0}
    assert got["card"] == {("1", "income_total", jan): 500.0, ("1", "income_total", feb): 0.0,
                           ("1", "expense_total", jan): 100.0, ("1", "expense_total", feb): 7.0}
    assert got["cross expense"][("1", "Servicios", jan)] == 9.0                 # a category without subcategories


def _numbers(x, name=""):
    if isinstance(x, dict):
        return [n for k, v in x.items() for n in _numbers(v, k)]
    if isinstance(x, list):
        return [n for v in x for n in _numbers(v, name)]
    return [float(x)] if isinstance(x, int | float) and name not in ("rank", "n") else []      # these are in the movements' keys


def test_every_number_of_the_documents_is_listed(spark, tables, values):
    docs = E.queries()["write_document"](spark, tables).collect()
    assert {r["ledger_id"] for r in docs} == {"1", "2"}
    for r in docs:
        listed = Counter(v["value"] for v in values if v["ledger_id"] == r["ledger_id"] and v["value"] is not None)
        assert listed == Counter(_numbers(json.loads(r["document"])))
