"""Statement reader (S1) on hand-made files: encodings, separators, headers, rejects."""

import os
from datetime import date
from decimal import Decimal as D

from ledgerline.session import scratch_path
from ledgerline.sources.statements import read_statements, source_lines, statement_outcomes


def _write(folder, name, data: bytes):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_reader_layouts_and_rejects(spark):
    folder = scratch_path(spark, "stmt-test").removeprefix("file:")
    # latin-1 bytes, ';' separator, title line with one field, accented header spellings
    _write(folder, "a.csv", "Banco Ñandú\n\nFecha;Descripción;Débito;Crédito;Saldo\n"
                            "05/02/2026;CAFÉ ALVEAR;1.234,56;;100\n06/02/2026;SALDO ANTERIOR;;;50\n"
                            "07/02/2026;SUELDO;;2000,5;2100,5\n;;;;\n".encode("latin-1"))
    # UTF-8, ',' separator, quoted field holding the separator, serial date, duplicate header forms
    _write(folder, "b.csv", ("Estado\nfecha,concepto,cargo,abono,Saldo,SALDO\n"
                             '46173,"PAGO, TARJETA",10.5,,1,2\n').encode("utf-8"))
    # no date column: the whole file is rejected
    _write(folder, "c.csv", "concepto|cargo|abono\nX|1|2\n".encode("utf-8"))
    # tab separator, reference column
    _write(folder, "d.csv", "fecha\tdetalle\tegreso\tingreso\tref\n1/3/2026\tLUZ\t99\t\t7\n".encode("utf-8"))
    rows, rejects = read_statements(spark, folder)
    got = {(os.path.basename(r["path"]), r["concept"]): r for r in rows.collect()}
    rej = sorted((os.path.basename(r["path"]), r["reason"]) for r in rejects.collect())

    assert ("a.csv", "CAFÉ ALVEAR") not in got                     # "1.234,56" cannot be read: row rejected
    assert ("a.csv", "SALDO ANTERIOR") not in got                  # balance line dropped
    s = got[("a.csv", "SUELDO")]
    assert (s["date"], s["debit"], s["credit"], s["balance"]) == (date(2026, 2, 7), D("0.00"), D("2000.50"), D("2100.50"))
    p = got[("b.csv", "PAGO, TARJETA")]
    assert (p["date"], p["debit"], p["balance"]) == (date(2026, 5, 31), D("10.50"), D("2.00"))   # later 'saldo' wins
    l = got[("d.csv", "LUZ")]
    assert (l["date"], l["debit"], l["reference"]) == (date(2026, 3, 1), D("99.00"), "7")
    assert len(got) == 3
    # in a file that cannot be mapped every line is a reject
    assert rej == [("a.csv", "unreadable amount"), ("c.csv", "no date or amount column"), ("c.csv", "no date or amount column")]


def test_file_without_separator_is_rejected(spark):
    folder = scratch_path(spark, "stmt-test2").removeprefix("file:")
    _write(folder, "x.csv", b"just one field per line\nanother\n")
    rows, rejects = read_statements(spark, folder)
    assert rows.count() == 0
    assert [(r["reason"], r["line_no"]) for r in rejects.orderBy("line_no").collect()] == [("no date or amount column", i) for i in (0, 1)]


def test_no_line_is_lost(spark):
    """Dates with times and two-digit years, quoted line breaks, stray quotes, junk: each line has one outcome,
    however the file is split."""
    folder = scratch_path(spark, "stmt-test3").removeprefix("file:")
    lines = ["Fecha;Concepto;Débito;Crédito", "05/02/26;UNO;1;", "06/02/2026 10:00;DOS;2;", '07/02/2026;"TRES', 'en dos; líneas";3;',
             "sin fecha;CUATRO;4;", "08/02/2026;CINCO;1.000,00;", "09/02/2026;TOTAL;;", ";;;", "", "10/02/2026;SEIS"]
    _write(folder, "a.csv", ("\n".join(lines) + "\n").encode())
    _write(folder, "b.csv", ("\r\n".join(lines[:3]) + '\r\n11/02/2026;UN " SUELTO;5;\r\n12/02/2026;SIETE;6;').encode("latin-1"))
    sizes = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in (sizes[0], "30"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            out, _ = statement_outcomes(spark, source_lines(spark.read.text(folder)))
            got = {}
            for r in out.collect():
                got.setdefault(os.path.basename(r["path"]), []).append((r["line_no"], r["outcome"], r["concept"], r["reason"]))
            assert sorted(got["a.csv"]) == [
                (1, "row", "UNO", None), (2, "row", "DOS", None), (3, "row", "TRES\nen dos; líneas", None),
                (5, "reject", "CUATRO", "unreadable date"), (6, "reject", "CINCO", "unreadable amount"), (7, "balance", "TOTAL", None),
                (10, "row", "SEIS", None)]
            assert sorted(got["b.csv"]) == [(1, "row", "UNO", None), (2, "row", "DOS", None), (3, "row", 'UN " SUELTO', None), (4, "row", "SIETE", None)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", sizes[0])
        spark.conf.set("spark.sql.files.openCostInBytes", sizes[1])
