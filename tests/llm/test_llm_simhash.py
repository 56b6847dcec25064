"""SimHash near-duplicates against a direct reading of the definition."""

import random
import re

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash as S
from ledgerline.llm.components import connected_components
from ledgerline.llm.queries import op4_simhash_dedup

from conftest import SF_SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_print(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [(i, brute_print(t)) for i, t in rows]
    parent = {p: p for _, p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    known = list(parent)
    for i, a in enumerate(known):
        for b in known[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root(p)] = min(i, least.get(root(p), i))
    return sorted(((i, f"{p:016x}", least.get(root(p))) for i, p in prints), key=repr)


def collected(df):
    return sorted(((r[0], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert collected(op4_simhash_dedup(spark, SF_SMALL)) == brute_components(rows)


def edge_rows():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdeü") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (None, "one two"), (None, "lone"),
            (6, "İ i ß"), (7, "i ß"), (8, " ".join(word() for _ in range(30_000)))]
    for i in range(60):                                   # a dense group of near copies
        copy = list(base)
        copy[rnd.randrange(120)] = word()
        rows.append((100 + i, " ".join(copy)))
    return rows + [(100, rows[10][1]), (3, " \t\n")]      # repeated rows


@pytest.mark.parametrize("bucket", [S.BUCKET_ROWS, 6])    # 6: buckets are cut into parts
def test_edges(spark, monkeypatch, bucket):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    rows = edge_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fingerprint", "2 as id", "3 as root")
    assert collected(S.near_duplicates(df)) == brute_components(rows)


def test_empty_table_and_filter(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0 and S.drop_near_copies(empty).count() == 0
    rows = edge_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")
    kept = sorted((r["doc_id"] for r in S.drop_near_copies(df).collect()), key=repr)
    assert kept == sorted((i for i, _, c in brute_components(rows) if i is None or i == c), key=repr)


@pytest.mark.parametrize("blocks", [6, 7, 8])
def test_every_scheme_finds_the_links_of_all_pairs(spark, monkeypatch, blocks):
    rnd = np.random.default_rng(3)
    centre = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    prints = {int(c) ^ sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 7), replace=False))
              for c in centre for _ in range(12)}
    monkeypatch.setattr(S, "scheme", lambda n, m: (blocks, blocks - m))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = S.near_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), 4)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    rows = list(prints)
    parent = {p: p for p in rows}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(rows):
        for b in rows[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[root(a)] = root(b)
    groups, want = {}, {}
    for p, s in zip(rows, signed):
        groups.setdefault(root(p), []).append(s)
    for members in groups.values():
        if len(members) > 1:
            want.update(dict.fromkeys(members, min(members)))
    assert got == want


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
