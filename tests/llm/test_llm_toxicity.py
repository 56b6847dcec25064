"""Toxicity: the grammar's clauses, held-out accuracy, copies and edge rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import toxicity as X
from ledgerline.llm.queries import op9_toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def grammar():
    return X.Grammar({"idiot": 4.0, "zork$": 3.0, "zor": 1.0, "zorky": 0.0})


def clause(g, text):
    return X.features(text, g, g.triggers())


def test_clauses(grammar):
    score = lambda t: grammar.clause(X.WORD.findall(t.lower()))
    assert score("an idiot here") == 4.0
    assert score("you idiot") == pytest.approx(4.8)                     # aimed at someone
    assert score("not an idiot") == pytest.approx(1.2)                  # negated
    assert score("she said idiot") < score("she idiot")                 # reported
    assert score("not at all in any way idiot") == 4.0                  # the negation is too far off
    assert score("kill the time") == 0 and score("kill them") > 0       # a threat needs a target
    assert (grammar.insult("zork"), grammar.insult("idiots"), grammar.insult("xzor")) == (3.0, 4.0, 0.0)


def test_whole_clauses_and_word_starts(grammar):
    assert clause(grammar, "aidiot. bzork") == (0, 0, 0, 0)              # inside a word
    one, two = clause(grammar, "a b idiot c"), clause(grammar, "a idiot. b idiot c")
    assert two[2] > one[2] and two[0] > one[0]
    assert clause(grammar, "a idiot, idiot c")[2] == one[2]             # one clause, two insults
    long = "word " * 60_000 + "idiot"
    assert clause(grammar, long)[1] == 4.0                              # whole texts


def test_held_out_accuracy(spark):
    out = op9_toxicity(spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert sum(toxic) / len(toxic) > 0.65 and sum(clean) / len(clean) < 0.02
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def sample_rows():
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"w{chr(97 + i % 23)}x q{chr(97 + i % 19)}y " + ("vilegrub " if bad else "") + f"z{chr(97 + i % 17)}t text n{i}"))
        labels.append((i, int(bad)))
    copied = "some harmless wording that is copied with a mark"
    for i in range(1000, 1100):                                        # a toxic label on copies of one text
        rows.append((i, copied))
        labels.append((i, 1))
    return rows, labels


def test_copies_do_not_make_words_toxic_and_edges(spark):
    rows, labels = sample_rows()
    edge = [(5000, None), (5001, ""), (None, "vilegrub"), (5002, "vilegrub"), (5002, "vilegrub"),
            (5003, "harmless wording copied"), (5004, "a " * 50_000 + "vilegrub")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + edge], "doc_id long, text string, score string")
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (5, 0)], "doc_id long, toxic int")
    got = X.toxicity_scores(docs, lab).collect()
    by = {r["id"]: r["score"] for r in got}
    assert len(got) == len(rows) + len(edge)
    assert by[5002] >= 0.7 and by[None] == by[5002] and by[5004] > 0.5
    assert by[5003] < 0.7 and by[5000] == by[5001] < 0.7
    kept = {r["doc_id"] for r in X.drop_toxic(docs, lab).collect()}
    assert kept == {i for i, s in by.items() if i is None or s < 0.7}


def test_no_labels_one_class_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in X.toxicity_scores(docs, none).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert [r["score"] for r in X.toxicity_scores(docs, one).collect()] == [1.0, 1.0]
    assert X.toxicity_scores(docs.limit(0), one).count() == 0


def test_training_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(X, "FIT_ROWS", 200)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    n = X.training_rows(docs, labels, "doc_id", "doc_id", "toxic").count()
    assert 100 < n < 300


def test_few_toxic_texts_still_rank_the_others(spark):
    rows = sample_rows()[0][:200]
    words = ("vilegrub", "snarfling", "dreckzot")
    docs = [(i, t.replace("vilegrub", words[i // 4 % 3] + " " + words[(i // 4 + 1) % 3])) for i, t in rows]
    labels = [(i, int(i % 4 == 0)) for i, _ in docs if i < 36]           # 9 toxic texts, each word in 6 of them
    labels = [(i, y) for i, y in labels if not y or i < 20] + [(i, 0) for i, _ in docs if 36 <= i < 90 and i % 4]      # 5 of them
    got = {r["id"]: r["score"] for r in X.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string"),
                                                          spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    toxic, clean = ([got[i] for i in range(100, 200) if (i % 4 == 0) == bad] for bad in (True, False))
    assert min(toxic) > max(clean)


def test_the_curve_does_not_overshoot():
    counts = [{"total": 0.0, "best": 0.0, "clauses": 0.0, "density": 0.0, "toxic": 0, "n": 60},
              {"total": 2.25, "best": 7.5, "clauses": 0.75, "density": 5.0, "toxic": 1, "n": 5}]
    w = X.fit_curve(counts)
    line = [sum(r[f] * c for f, c in zip(X.FEATURES, w)) + w[-1] for r in counts]
    assert abs(w).max() < 100 and line[1] > 0 > line[0]
