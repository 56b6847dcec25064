"""Spelling variants against a direct comparison of all words, the planted errors and edge rows."""

import random
import zlib
from collections import Counter

from ledgerline.llm import spelling as S


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words, ratio=5):
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words)


def rows(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_against_all_pairs(spark):
    rnd = random.Random(4)
    words = {}
    for _ in range(40):
        base = "".join(rnd.choice("abcdeßéÿ") for _ in range(rnd.randrange(6, 11)))
        words[base] = rnd.choice([5, 60, 700, 9000])
        for _ in range(12):
            w = list(rnd.choice([base, *words]))
            at = rnd.randrange(len(w))
            rnd.choice([lambda: w.pop(at), lambda: w.insert(at, rnd.choice("abé")), lambda: w.__setitem__(at, rnd.choice("abcé"))])()
            words.setdefault("".join(w), rnd.choice([5, 5, 6, 60, 700]))
    got = rows(S.spelling_groups(spark.createDataFrame(list(words.items()), "word string, n long")))
    want = brute(words)
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 1 for r in want)


def test_every_near_pair_shares_a_signature():
    rnd = random.Random(5)
    for _ in range(400):
        a = "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 12)))
        at = rnd.randrange(len(a))
        same = a[:at] + rnd.choice("xyz") + a[at + 1:]
        longer = a[:at] + rnd.choice("abxy") + a[at:]
        keys = lambda w, role: {k for k, r in S.signatures_of(w) if r == role}
        assert keys(a, 0) & keys(same, 0)
        assert keys(a, 1) & keys(longer, 2)


def test_counts_and_planted_errors(spark):
    texts = [(1, "Wandern, wandern; Ärger\tÄRGER×x 123wandern!"), (2, "wandern " * 4000), (None, "wandern kurz"), (3, None), (4, ""), (2, "wandern " * 4000)]
    df = spark.createDataFrame([(*t, "w") for t in texts], "doc_id long, text string, word string")
    got = {r["word"]: r["n"] for r in S.word_counts(df, typo_every=3, min_length=4, min_count=1).collect()}
    want = Counter()
    for i, t in texts:
        for r, n in S.counted_runs(t).items():
            key = "" if i is None else str(i)
            h = zlib.crc32(f"{key}:{r}".encode())
            word = r[:h % len(r)] + r[h % len(r) + 1:] if h % 3 == 0 else r
            if len(word) >= 4:
                want[word] += n
    assert got == dict(want)
    assert S.counted_runs("ÄRGER×x Ärger") == {"Ärger×x": 1, "Ärger": 1}
    plain = {r["word"]: r["n"] for r in S.word_counts(df, min_length=4, min_count=2).collect()}
    assert plain["wandern"] == 8004


def test_edges(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert rows(S.spelling_groups(none)) == []
    tie = {"abcdef": 50, "abcdeg": 50, "abcde": 5, "abcdex": 5, "zzzzzz": 5}
    assert rows(S.spelling_groups(spark.createDataFrame(list(tie.items()), "word string, n long"))) == brute(tie)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.spelling_variants(empty, typo_every=199).count() == 0
