"""M1 / M2: held-out accuracy and calibration, a deterministic small fit, single-row classes, recoding."""

import random
from decimal import Decimal as D

import numpy as np
import pytest

from ledgerline.operators import model as M

SCHEMA = "row_id string, concept string, category string, subcategory string, date date, debit decimal(18,2), credit decimal(18,2)"


def frame(spark, rows):
    return spark.createDataFrame([(i, c, l, "", None, D(a), None) for i, c, l, a in rows], SCHEMA)


def noisy(n, seed):
    """Two thirds of the rows hold a word of their class; the others hold a word whose class is drawn."""
    rnd = random.Random(seed)
    words = {"Salud": "farmacia", "Casa": "alquiler", "Viajes": "pasaje"}
    out = []
    for i in range(n):
        label = rnd.choice(list(words))
        word = words[label] if rnd.random() < 0.66 else rnd.choice(["tienda", "compra"])
        out.append((f"r{i:05d}", f"{word} {rnd.choice(['norte', 'sur', 'oeste'])}", label, rnd.randrange(1, 100)))
    return out


def test_held_out_accuracy_and_calibration(spark):
    rows = noisy(900, 3)
    train, held = rows[:600], rows[600:]
    model = M.train_labeller(frame(spark, train), hashed_terms=1 << 10, max_iter=15)
    got = {r["row_id"]: r for r in M.suggest_labels(model, frame(spark, [(i, c, "", a) for i, c, _, a in held]), threshold=0.82).collect()}
    assert len(got) == len(held)
    hits = [(got[i]["confidence"], got[i]["suggestion"] == label) for i, _, label, _ in held]
    sure, unsure = [h for c, h in hits if c >= 0.82], [h for c, h in hits if c < 0.82]
    assert len(sure) > 150 and np.mean(sure) > 0.97                  # rows with a word of their class
    assert len(unsure) > 50 and np.mean(unsure) < 0.6                # the others are to be reviewed
    assert abs(np.mean([c for c, _ in hits]) - np.mean([h for _, h in hits])) < 0.08
    assert all(r["review"] == (r["confidence"] < 0.82) for r in got.values())


def test_single_row_class_is_not_calibrated(spark):
    rows = [("a1", "farmacia norte", "Salud", 5), ("a2", "farmacia sur", "Salud", 6), ("b1", "alquiler mayo", "Casa", 900), ("x", "alquiler junio", "", 900),
            ("y", None, "pendiente", 5)]
    df = frame(spark, rows)
    model = M.train_labeller(df, hashed_terms=1 << 8, max_iter=10)
    got = {r["row_id"]: tuple(r)[1:] for r in M.suggest_labels(model, df).collect()}
    assert got["x"] == ("Casa", 1.0, False) and set(got) == {"x", "y"} and got["y"][1:] == (1.0, False)
    with pytest.raises(ValueError):
        M.train_labeller(df.where("category = 'Salud'"))


def test_old_labels_are_translated_first(spark):
    rows = [(f"a{i}", "farmacia", "SMALL", 5) for i in range(3)] + [(f"b{i}", "alquiler", "Casa", 900) for i in range(3)]
    recode = spark.createDataFrame([("SMALL", "Salud", "")], "old string, new string, sub string")
    assert M.train_labeller(frame(spark, rows), hashed_terms=1 << 8, max_iter=5, recode=recode).classes == ["Casa", "Salud"]


def test_term_counts_are_damped_and_no_row_goes_to_python(spark, monkeypatch):
    """A slot that holds n occurrences counts 1 + ln(n); neither the fit nor the suggestions need a Python worker."""
    def refuse(*a, **k):
        raise AssertionError("a Python function for each row")
    monkeypatch.setattr(M.F, "udf", refuse)
    rows = [(f"a{i}", "farmacia farmacia farmacia norte", "Salud", 5) for i in range(3)] + [(f"b{i}", "alquiler", "Casa", 900) for i in range(3)]
    df = frame(spark, rows + [("x", "farmacia", "", 5), ("y", None, "", 900)])
    got = {r["row_id"]: r["suggestion"] for r in M.suggest_labels(M.train_labeller(df, hashed_terms=1 << 10, max_iter=5), df).collect()}
    assert got == {"x": "Salud", "y": "Casa"}
    first, empty = [M._term_rows(df.where(f"row_id = '{i}'"), "category", 1 << 10).first() for i in ("a0", "y")]
    # farmacia three times, "farmacia farmacia" twice, norte, "farmacia norte"
    assert sorted(first["_dtf"].values) == pytest.approx(sorted([1 + np.log(3), 1 + np.log(2), 1, 1])) and first["_dtf"].size == 1 << 10
    assert (first["_c"], first["_amt_d"]) == ("Salud", -5.0) and len(empty["_dtf"].values) == 0


def test_sigmoid():
    """Counts drawn from a known sigmoid give it back; few rows give no certainty."""
    m = np.linspace(-4, 4, 81)
    p = 1 / (1 + np.exp(-1.7 * m + 0.4))
    a, b = M.fit_sigmoid([(x, round(1e5 * y), round(1e5 * (1 - y))) for x, y in zip(m, p)])
    assert abs(a + 1.7) < 0.01 and abs(b - 0.4) < 0.01
    a, b = M.fit_sigmoid([(1.0, 2, 0), (-1.0, 0, 2)])
    assert 0.6 < 1 / (1 + np.exp(a + b)) < 0.9
