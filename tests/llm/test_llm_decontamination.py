"""Decontamination against a direct search, shards, spans in the original text and edge rows."""

import random
import re

import pytest

from ledgerline.llm import decontamination as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items, window):
    grams = []
    for item, text in items:
        ws = WORD.findall((text or "").translate(LOWER))
        grams += [(item, ws[i:i + window]) for i in range(max(1, len(ws) - window + 1))] if ws else []
    out = []
    for i, text in docs:
        found = list(WORD.finditer((text or "").translate(LOWER)))
        ws, hit, ids = [m.group() for m in found], set(), set()
        for item, g in grams:
            for s in range(len(ws) - len(g) + 1):
                if ws[s:s + len(g)] == g:
                    hit.update(range(s, s + len(g)))
                    ids.add(item)
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][2] == p - 1 and (text[spans[-1][1]:found[p].start()] or p):
                spans[-1] = (spans[-1][0], found[p].end(), p)
            else:
                spans.append((found[p].start(), found[p].end(), p))
        out.append((i, len(ws), len(hit), sorted(str(x) for x in ids if x is not None), [s[:2] for s in spans]))
    return sorted(out, key=repr)


def fixture_rows():
    rnd = random.Random(11)
    words = ["alpha", "Beta", "gamma", "δelta", "x9", "naïve"]
    say = lambda n: rnd.choice([" ", ", ", "\n", " - "]).join(rnd.choice(words) for _ in range(n))
    items = [(1, say(14)), (2, say(4)), (3, None), (4, "... !"), (None, say(13)), (5, say(12)), (5, say(11)), (10, "one"), (6, say(4))]
    texts = [t for _, t in items if t]
    docs = [(i, say(rnd.randrange(30)) + " | " + rnd.choice(texts).upper().replace("Δ", "δ").replace("Ï", "ï") + "; " + say(5)) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "!!"), (None, texts[0]), (103, "ONE"), (103, "ONE"), (103, "ONE"), (104, texts[0] + " " + texts[0]),
             (105, say(20_000) + " " + texts[0])]
    return docs, items


@pytest.mark.parametrize("shard_bytes", [D.SHARD_BYTES, 60])
@pytest.mark.parametrize("window", [10, 5])
def test_against_a_direct_search(spark, shard_bytes, window):
    docs, items = fixture_rows()
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, key string")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, id int")
    out = D.decontaminate(df, bench, window=window, shard_bytes=shard_bytes).collect()
    got = sorted(((r["id"], r["n_words"], r["n_hit"], list(r["items"]), [tuple(s) for s in r["spans"]]) for r in out), key=repr)
    assert got == brute(docs, items, window)


def test_spans_point_into_the_original(spark):
    docs = spark.createDataFrame([(1, "Ünd: THE  quick—Fox\tjumps, over")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "quick—fox jumps")], "item_id long, text string")
    r = D.decontaminate(docs, bench).first()
    assert [("Ünd: THE  quick—Fox\tjumps, over")[s["start"]:s["end"]] for s in r["spans"]] == ["quick—Fox\tjumps"]


def test_empty_tables_and_filter(spark):
    docs, items = fixture_rows()
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert D.decontaminate(df.limit(0), bench).count() == 0
    clean = D.decontaminate(df, bench.limit(0)).collect()
    assert len(clean) == len(docs) and not any(r["n_hit"] for r in clean)
    kept = sorted((r["doc_id"] for r in D.drop_contaminated(df, bench).collect()), key=repr)
    assert kept == sorted((i for i, _, hit, *_ in brute(docs, items, 10) if i is None or not hit), key=repr)
