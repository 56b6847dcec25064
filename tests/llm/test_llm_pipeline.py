"""The pipeline against its operators' brute-force versions, stage by stage."""

import hashlib
import random

import pytest

import corpus_pipeline as P

from conftest import SF_SMALL
from test_llm_decontamination import brute as contaminated
from test_llm_exact_dedup import brute as exact
from test_llm_simhash import brute_components


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents that enter each stage and the last stage's rows."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for name, stage in P.STAGES:
        out.append((name, docs))
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*out, ("end", docs)]


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, stages):
    by = dict(stages)
    want = by["toxicity"].schema.names
    assert all(df.columns == want for name, df in stages[:-1])
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    gone = ids(by["toxicity"]) - ids(by["exact_dedup"])
    assert sum(labels.get(i) == 0 for i in gone) <= 1
    assert ids(by["simhash_dedup"]) == {r[0] for r in exact(rows(by["exact_dedup"]), min) if r[3]}
    assert ids(by["decontamination"]) == {i for i, _, c in brute_components(rows(by["simhash_dedup"])) if i == c}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert ids(by["sentencepiece"]) == {r[0] for r in contaminated(rows(by["decontamination"]), bench, 10) if not r[2]}
    assert ids(by["end"]) == ids(by["sentencepiece"])


def test_run_equals_its_stages(spark, stages):
    digest = lambda df: hashlib.sha256(repr(sorted(map(tuple, df.collect()))).encode()).hexdigest()
    assert digest(P.run(spark, SF_SMALL)) == digest(stages[-1][1])


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def stage(spark, name, rows):
    df = spark.createDataFrame([(*r, "en", "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(P.STAGES)[name](spark, df, SF_SMALL)
    assert out.columns == df.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


def test_exact_dedup_decides_on_rows(spark):
    rows = [(3, "A"), (5, "a"), (5, "b"), (7, "B"), (9, "c"), (9, "c"), (None, "d"), (None, "D"), (None, "d"), (None, "c"), (8, None), (8, "")]
    got = stage(spark, "exact_dedup", rows)
    assert len(got) == 5 and {(i, (t or "").lower()) for i, t in got} == {(3, "a"), (5, "b"), (9, "c"), (None, "d"), (8, "")}


def test_simhash_dedup_decides_on_rows(spark):
    rnd = random.Random(3)
    a, b, c, d = (words(rnd, 60) for _ in range(4))
    rows = [(3, a), (5, a.upper()), (5, b), (7, b.upper()), (9, c), (9, c), (9, c.upper()), (None, d), (None, d), (None, c)]
    got = stage(spark, "simhash_dedup", rows)
    assert sorted((repr(i), t.lower()) for i, t in got) == sorted([("3", a), ("5", b), ("9", c), ("None", d)])


def test_toxicity_and_decontamination_decide_on_rows(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    known = list(docs.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept = {i for i, _ in stage(spark, "toxicity", known)}
    toxic = next(t for i, t in known if i not in kept and labels.get(i) == 1)
    clean = next(t for i, t in known if i in kept and labels.get(i) == 0)
    extra = [(10**6, toxic), (10**6, clean), (None, toxic), (None, clean)]
    got = [r for r in stage(spark, "toxicity", known + extra) if r[0] is None or r[0] == 10**6]
    assert got == sorted([(10**6, clean), (None, clean)], key=repr)
    item = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").first()["text"]
    rows = [(1, item), (1, "clean words"), (None, item), (None, "clean words")]
    assert stage(spark, "decontamination", rows) == sorted([(1, "clean words"), (None, "clean words")], key=repr)


def test_pieces_decode_to_the_text(spark):
    texts = {1: "Two  words\n", 2: "é 語 \U0001f600", 3: "", 4: None}
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in dict(P.STAGES)["sentencepiece"](spark, df, SF_SMALL).collect()}
    assert all(r["lossless"] for r in out.values()) and len(out) == 4
    for i, t in texts.items():
        assert out[i]["decoded_sha256"] == (None if t is None else hashlib.sha256(t.encode()).hexdigest())


def test_pieces_are_written_before_they_are_decoded(spark, monkeypatch):
    """One Python stage is live at a time, and a text goes to it once."""
    import corpus_pipeline as C
    seen, decode = [], C.decode
    monkeypatch.setattr(C, "decode", lambda df, model: seen.append(df) or decode(df, model))
    docs = spark.createDataFrame([(1, "uno dos", "es", "web"), (2, None, "es", "web")], "doc_id long, text string, lang string, source string")
    out = {r["doc_id"]: r for r in C.sentencepiece(spark, docs, "").collect()}
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert out[1]["lossless"] and out[1]["n_pieces"] > 0 and out[2]["pieces"] is None


def test_texts_that_are_no_strings_are_encoded(spark):
    from corpus_pipeline import decode, encode
    from ledgerline.llm.queries import MODEL
    number = spark.createDataFrame([(1, 17), (2, None)], "doc_id long, text long")
    out = {r["doc_id"]: tuple(r) for r in decode(encode(number, MODEL), MODEL).collect()}
    assert out[1][1] == 17 and out[1][3] == "17" and out[2][2:] == (None, None)
