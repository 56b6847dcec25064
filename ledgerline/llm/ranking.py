"""Ranked lexical search: term tiles of the queries times impact tiles of the documents, as dense products.

1. The queries are cut into tiles of at most ``TILE_ITEMS`` items and about ``TILE_TERMS`` different terms; a
   tile's vocabulary is what is broadcast (one item with more terms is a tile of its own).  Tiles go one after
   the other and each is freed before the next.
2. One scan of the documents counts each document's terms and its occurrences of the tile's vocabulary: sparse
   rows (id, n, term numbers, occurrences), written once.  N, L and the document frequencies are aggregates
   over all of them.
3. Blocks of ``BLOCK_ROWS`` documents become dense float64 impact matrices over a run of at most
   ``COLUMNS`` terms, multiplied (BLAS) with the matrix of term counts of the items.  All entries are whole
   numbers and every run of terms is chosen such that no item's sum can reach 2^53, so the products are exact
   in any order of summation; the sums of several runs are added as 64-bit integers.
4. A block keeps the k best documents of each item; documents that tie with the k-th are cut by id, so the
   choice does not depend on blocks or tasks.  A window over the tasks' winners gives the ranks.

A term is a maximal run of ASCII letters, digits and non-ASCII characters; only A-Z is lower-cased.  The weight
of a term is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is 75 + ((25 n N) div L), and its score
the sum over the item's terms, repeats included, of weight * ((10^9 tf) div (1000 tf + 12 m)).

Defined cases: a null text has no terms and counts neither in N nor L; an item without terms, or with terms
that no document holds, has no rows; items with equal ids are ranked apart, each with ranks from 1, and a null
item id is a value like any other; rows with equal document ids each take a rank, null document ids come
last among equal scores; empty tables give no rows.  Only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.decontamination import words_of
from ledgerline.session import materialize

TOP = 20
TILE_ITEMS = 256
TILE_TERMS = 1 << 14       # with TILE_ITEMS a dense item matrix of at most 32 MB
BLOCK_ROWS = 1024
COLUMNS = 4096
EXACT = 1 << 53         # whole numbers below it are exact in float64


@dataclass
class ItemTile:
    """Some items: their numbers, ids and the counts of their terms."""
    items: list            # (number, id, {term number: occurrences})
    vocab: dict            # term → term number


def item_tiles(items: DataFrame, id_col: str, text_col: str, tile_items: int, tile_terms: int):
    """Bounded tiles of the query table, one at a time."""
    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    tile = ItemTile([], {})
    for no, r in enumerate(rows.toLocalIterator()):
        terms = Counter(words_of(r["text"]))
        if tile.items and (len(tile.items) >= tile_items or len(tile.vocab.keys() | terms.keys()) > tile_terms):
            yield tile
            tile = ItemTile([], {})
        if terms:
            tile.items.append((no, r["id"], {tile.vocab.setdefault(t, len(tile.vocab)): n for t, n in terms.items()}))
    if tile.items:
        yield tile


def _sparse(rows: DataFrame, vocab) -> DataFrame:
    """(id, n, terms, tf) of every document with a term; terms of the tile only."""
    def run(batches):
        get = vocab.value.get
        for b in batches:
            kept, n, terms, tf = [], [], [], []
            for i, text in enumerate(b.column(1)):
                words = words_of(text.as_py())
                if not words:
                    continue
                found = Counter(map(get, words))
                found.pop(None, None)
                kept.append(i)
                n.append(len(words))
                terms.append(list(found))
                tf.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(kept, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                 pa.array(tf, pa.list_(pa.int64()))], names=["id", "n", "terms", "tf"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n long, terms array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def column_runs(tile: ItemTile, weights: dict[int, int], columns: int = COLUMNS, exact: int = EXACT):
    """The item matrix in runs of terms: (term numbers, matrix of terms × items).  An impact is below weight * 10^6,
    so a run whose counts times that stay below ``exact`` for every item has exact sums; a count too large for one
    run is spread over several."""
    width = len(tile.items)
    holders: dict[int, list] = {}
    for i, (_, _, counts) in enumerate(tile.items):
        for t, q in counts.items():
            if weights.get(t, 0) > 0:
                holders.setdefault(t, []).append((i, q))
    runs, terms, rows, bound = [], [], [], [0] * width
    def close():
        if terms:
            runs.append((np.array(terms), np.array(rows, dtype=np.float64)))

    for t in sorted(holders):
        most = weights[t] * 10**6
        left = holders[t]
        while left:
            step = [(i, min(q, (exact - 1) // most)) for i, q in left]
            if len(terms) >= columns or any(bound[i] + q * most >= exact for i, q in step):
                close()
                terms, rows, bound = [], [], [0] * width
            row = [0] * width
            for i, q in step:
                row[i] = q
                bound[i] += q * most
            terms.append(t)
            rows.append(row)
            left = [(i, q - s) for (i, q), (_, s) in zip(left, step) if q > s]
    close()
    return runs


class Block:
    """Documents of one dense block: their impacts as (row, term, value)."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int):
        n, terms, tf = (batch.column(c) for c in ("n", "terms", "tf"))
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        m = np.array([75 + 25 * x * n_docs // n_terms for x in n.to_pylist()], dtype=np.int64)
        self.size = len(m)
        self.row = np.repeat(np.arange(self.size), sizes)
        self.term = terms.flatten().to_numpy()
        f = tf.flatten().to_numpy()
        self.impact = weights[self.term] * ((10**9 * f) // (1000 * f + 12 * m[self.row]))

    def scores(self, runs, width: int, n_vocab: int) -> np.ndarray:
        """Documents × items, exact."""
        total = np.zeros((self.size, width), dtype=np.int64)
        for terms, matrix in runs:
            place = np.full(n_vocab, -1)
            place[terms] = np.arange(len(terms))
            at = place[self.term]
            own = at >= 0
            used = np.unique(at[own])                      # columns that some document of the block holds
            dense = np.zeros((self.size, len(used)))
            dense[self.row[own], np.searchsorted(used, at[own])] = self.impact[own]
            total += (dense @ matrix[used]).astype(np.int64)
        return total


def _best(found: pa.Table, k: int) -> pa.Table:
    """The k first of each item by (score, id)."""
    order = pc.sort_indices(found, sort_keys=[("item", "ascending"), ("score", "descending"), ("id", "ascending")])
    found = found.take(order)
    item = found.column("item").to_numpy()
    first = np.flatnonzero(np.diff(item, prepend=-1))
    rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
    return found.filter(pa.array(rank < k))


def _winners(sparse: DataFrame, shared, n_docs: int, n_terms: int, k: int, block_rows: int) -> DataFrame:
    """The k best documents of each item in each task: (item, id, score)."""
    def run(batches):
        runs, weights, width = shared.value
        best, floor = None, np.zeros(width, dtype=np.int64)       # floor: the k-th score so far
        for b in batches:
            for start in range(0, b.num_rows, block_rows):
                part = b.slice(start, block_rows)
                scores = Block(part, weights, n_docs, n_terms).scores(runs, width, len(weights))
                if len(scores) > k:        # below the block's k-th score nothing can win; ties with it can
                    bar = np.maximum(floor, np.partition(scores, len(scores) - k, axis=0)[len(scores) - k])
                else:
                    bar = floor
                row, item = np.nonzero((scores >= bar) & (scores > 0))
                if not len(row):
                    continue
                new = pa.table({"item": pa.array(item, pa.int32()), "id": part.column("id").take(pa.array(row)),
                                "score": pa.array(scores[row, item], pa.int64())})
                best = _best(new if best is None else pa.concat_tables([best, new]), k)
                held, score = best.column("item").to_numpy(), best.column("score").to_numpy()
                last = np.flatnonzero(np.diff(held, append=-1))
                full = np.bincount(held, minlength=width)[held[last]] == k
                floor[held[last[full]]] = score[last[full]]
        if best is not None:
            yield from best.combine_chunks().to_batches()

    return sparse.mapInArrow(run, f"item int, id {dict(sparse.dtypes)['id']}, score long")


def rank_documents(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", k: int = TOP, tile_items: int = TILE_ITEMS, tile_terms: int = TILE_TERMS,
                   block_rows: int = BLOCK_ROWS, columns: int = COLUMNS, exact: int = EXACT) -> DataFrame:
    """For each item its ``k`` best documents with a score above 0: ``item``, ``rank``, ``id``, ``score``."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = items.select(F.col(f"`{item_col}`").alias("item")).schema["item"].dataType
    found = []
    for tile in item_tiles(items, item_col, item_text_col, tile_items, tile_terms):
        vocab = spark.sparkContext.broadcast(tile.vocab)
        sparse = materialize(_sparse(rows, vocab))
        vocab.destroy()
        size = sparse.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        counts = sparse.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect()   # the tile's terms
        weights = {r["t"]: weight(size["docs"], r["df"]) for r in counts}
        runs = column_runs(tile, weights, columns, exact)
        if not runs:
            continue
        dense = np.array([weights.get(t, 0) for t in range(len(tile.vocab))], dtype=np.int64)
        shared = spark.sparkContext.broadcast((runs, dense, len(tile.items)))
        best = materialize(_winners(sparse, shared, size["docs"], size["terms"], k, block_rows))
        shared.destroy()
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        top = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item_id) for i, (_, item_id, _) in enumerate(tile.items)],
                                      f"no int, name {kind.simpleString()}")       # at most tile_items rows
        found.append(top.join(F.broadcast(names), F.col("item") == F.col("no")).select(F.col("name").alias("item"), "rank", "id", "score"))
    if not found:
        empty = rows.limit(0)
        return empty.select(F.lit(None).cast(kind).alias("item"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score"))
    return reduce(DataFrame.unionByName, found)
