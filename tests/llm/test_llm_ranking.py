"""Ranked search against direct scoring in whole numbers: tiles, runs, blocks, ties and edge rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import ranking as R

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    docs = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(n > 0 for *_, n in docs), sum(n for *_, n in docs)
    df = Counter(w for _, c, _ in docs for w in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            if n:
                m = 100 - 25 + 25 * n * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w in terms(text) if c[w])
                if s > 0:
                    scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def fixture():
    rnd = random.Random(8)
    words = ["alpha", "Beta", "gamma", "δelta", "x9", "naïve", "und", "the", *(f"w{i}" for i in range(60))]
    say = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(n))
    docs = [(i, say(rnd.randrange(1, 60))) for i in range(150)]
    docs += [(500 + i, docs[3][1]) for i in range(40)] + [(7, docs[3][1])] * 3 + [(None, docs[3][1]), (900, None), (901, ""), (902, "?!"), (903, say(30_000))]
    items = [(i, say(rnd.randrange(1, 30))) for i in range(25)] + [(30, docs[3][1]), (31, None), (32, "nothing here"), (None, "alpha"), (33, "the " * 500)]
    return docs, items


def run(spark, docs, items, **kw):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, id string, score int").repartition(5)
    q = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int")
    return sorted((tuple(r) for r in R.rank_documents(df, q, **kw).select("item", "rank", "id", "score").collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"tile_items": 7, "block_rows": 16}, {"tile_terms": 20, "columns": 5, "block_rows": 50}, {"exact": 1 << 40, "k": 3}])
def test_against_direct_scoring(spark, kw):
    docs, items = fixture()
    assert run(spark, docs, items, **kw) == brute(docs, items, kw.get("k", 20))


def test_runs_stay_exact():
    tile = R.ItemTile([(0, "a", {0: 3, 1: 10**6}), (1, "b", {1: 1, 2: 5})], {"x": 0, "y": 1, "z": 2})
    weights = {0: 20_000, 1: 30_000, 2: 0}
    runs = R.column_runs(tile, weights)
    total = np.zeros((3, 2))
    for at, matrix in runs:
        assert all(sum(int(q) * weights[t] * 10**6 for t, q in zip(at, col)) < R.EXACT for col in matrix.T)
        np.add.at(total, at, matrix)
    assert total.tolist() == [[3, 0], [10**6, 1], [0, 0]]       # a term of weight 0 scores nothing


def test_empty_tables(spark):
    docs, items = fixture()
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []
