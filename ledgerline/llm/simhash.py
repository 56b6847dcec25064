"""SimHash near-duplicates: fingerprints, pivot distance tables, connected components.

1. ``fingerprints``: one 64-bit SimHash per text over word shingles (XXH64, seed 42), in Arrow batches.
2. ``near_links``: pairs of different fingerprints that differ in at most ``max_bits`` bits.  The 64
   bits are cut into b blocks; two such fingerprints agree on at least b - max_bits of them, so
   they meet in the bucket of some combination of that many blocks.  Inside a bucket each
   fingerprint has its row of a pivot distance table: the Hamming distances to ``PIVOTS`` reference
   fingerprints.  By the triangle inequality a pair whose rows differ by more than ``max_bits`` in any
   coordinate cannot link; the survivors are verified bit by bit.
3. Components over fingerprints, then the smallest id of each component.

Equal fingerprints are one node, so exact copies never form pairs.  A bucket gives a spanning forest
of its links, never all pairs: a dense group of near copies costs one link per member.  Buckets over
``BUCKET_ROWS`` are cut into parts, and each pair of parts is a task of its own with at most
``BUCKET_ROWS`` rows, so no task holds an unbounded group and no link is lost.  The number of blocks
follows the number of different fingerprints (``scheme``); every scheme finds the same links.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links like
any other; fewer words than a shingle: the whole sequence is one shingle; rows with a null id take part
in linking and get their component's smallest non-null id (null if there is none); repeated rows give
repeated rows; an empty table gives no rows.  Components read only the id and text columns.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import ROW, by_position, drop_rows, one_per_class, ranked, with_row_key
from ledgerline.llm.components import connected_components
from ledgerline.session import materialize

SEED = 42
BLOCK = 1 << 16          # shingles whose bits are counted at once
PIVOTS = 16
BUCKET_ROWS = 8192
#: the most different fingerprints that a bucket should have on average before another block is cut
MEAN_BUCKET = 64


def simhash64(text: str | None, shingle: int) -> int:
    words = (text or "").encode().lower().split()      # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    starts = [0, *(e + 1 for e in ends)]
    spans = list(zip(starts, ends[shingle - 1:])) or [(0, len(joined))]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(spans), BLOCK):
        h = np.array([digest(joined[s:e], SEED) for s, e in spans[i:i + BLOCK]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(spans)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fingerprint): the 64 bits as a signed long."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        for b in batches:
            fp = pa.array([simhash64(t.as_py(), shingle) for t in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, fingerprint long")


def scheme(distinct: int, max_bits: int) -> tuple[int, int]:
    """(blocks, blocks that must agree) for so many different fingerprints: the fewest blocks with
    buckets of ``MEAN_BUCKET`` fingerprints on average."""
    blocks = max_bits + 2
    while blocks < 2 * max_bits and distinct > MEAN_BUCKET << (64 // blocks * (blocks - max_bits)):
        blocks += 1
    return blocks, blocks - max_bits


def _bucket_keys(blocks: int, agree: int):
    """Per combination: its number and the expression of the bits kept."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    for no, kept in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        yield F.struct(F.lit(no).cast("short").alias("combo"), F.col("fingerprint").bitwiseAND(F.lit(signed)).alias("bits"))


def pivots() -> np.ndarray:
    """Reference fingerprints: XXH64 of 0, 1, 2, ..."""
    return np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(PIVOTS)], dtype=np.uint64)


def pivot_table(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)


def _verified(fp, table, i, j, max_bits):
    """Which of the pairs (i, j) survive the pivot filter and differ in at most max_bits bits."""
    near = np.abs(table[i] - table[j]).max(axis=-1) <= max_bits
    near[near] = np.bitwise_count((fp[i] ^ fp[j])[near] if np.ndim(i) else fp[i] ^ fp[j][near]) <= max_bits
    return near


def forest(fp: np.ndarray, table: np.ndarray, max_bits: int):
    """Links (a, b) of a spanning forest over the links of one bucket: a search that compares each
    reached fingerprint with those not yet reached."""
    left, links = np.arange(len(fp)), []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = _verified(fp, table, x, left, max_bits)
            links += [(x, y) for y in left[near]]
            queue += list(left[near])
            left = left[~near]
    return links


#: buckets up to this size are compared side by side, all buckets of a batch at once
SIDE_BY_SIDE = 12


def bucket_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of one sorted run; ``key`` numbers the buckets."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    of_row = np.repeat(size, size)
    few = np.flatnonzero((of_row > 1) & (of_row <= SIDE_BY_SIDE))
    out_a, out_b = [], []
    k, f = key[few], fp[few]
    t = pivot_table(f)
    for d in range(1, SIDE_BY_SIDE):
        i = np.flatnonzero(k[d:] == k[:-d])
        if not len(i):
            break
        ok = _verified(f, t, i, i + d, max_bits)
        out_a.append(f[i[ok]])
        out_b.append(f[i[ok] + d])
    for s, n in zip(first[size > SIDE_BY_SIDE], size[size > SIDE_BY_SIDE]):
        own = fp[s:s + n]
        for a, b in forest(own, pivot_table(own), max_bits):
            out_a.append(own[[a]])
            out_b.append(own[[b]])
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.uint64)
    return cat(out_a), cat(out_b)


def _links_in_sorted(keys: list[str], max_bits: int):
    """mapInArrow over partitions sorted by ``keys``: the rows of a bucket lie together; the last
    bucket of a batch waits for the next batch."""
    def emit(table: pa.Table):
        cols = [table.column(k).to_numpy() for k in keys]
        new = np.zeros(table.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        a, b = bucket_links(np.cumsum(new), table.column("fingerprint").to_numpy().view(np.uint64), max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            same = np.ones(t.num_rows, bool)
            for k in keys:
                c = t.column(k).to_numpy()
                same &= c == c[-1]
            cut = t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = t.slice(cut)
            if cut:
                yield emit(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield emit(rest)

    return run


def near_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links between different fingerprints of the column ``fingerprint`` that connect
    exactly the same fingerprints as all pairs within ``max_bits`` bits do."""
    n = prints.count()
    blocks, agree = scheme(n, max_bits)
    keyed = prints.select("fingerprint", F.explode(F.array(*_bucket_keys(blocks, agree))).alias("k")).select(
        "k.combo", "k.bits", "fingerprint")
    hot = materialize(keyed.groupBy("combo", "bits").agg(F.count(F.lit(1)).alias("members"))
                      .where(F.col("members") > BUCKET_ROWS))
    out = "a long, b long"
    key = ["combo", "bits"]
    if hot.isEmpty():
        usual = keyed
        parted = None
    else:
        usual = keyed.join(hot, key, "left_anti")
        parts = F.ceil(F.col("members") * 2.5 / BUCKET_ROWS).cast("int")      # of 0.4 buckets on average
        placed = keyed.join(hot, key).select(*key, "fingerprint", parts.alias("parts"),
                                             F.pmod(F.xxhash64("fingerprint"), parts).cast("int").alias("part"))
        parted = placed.select(*key, "fingerprint", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o"))
        parted = parted.select(*key, F.least("part", "o").alias("p"), F.greatest("part", "o").alias("q"), "fingerprint")
    links = (usual.repartition(*key).sortWithinPartitions(*key, "fingerprint")
             .mapInArrow(_links_in_sorted(key, max_bits), out))
    if parted is not None:
        key = [*key, "p", "q"]
        links = links.unionByName(parted.repartition(*key).sortWithinPartitions(*key, "fingerprint")
                                  .mapInArrow(_links_in_sorted(key, max_bits), out))
    return links.distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """One row per row of ``df``: ``id``, ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest id reachable by links of at most ``max_bits`` differing bits."""
    prints = materialize(fingerprints(df, id_col, text_col, shingle))
    nodes = materialize(prints.groupBy("fingerprint").agg(F.min("id").alias("first_id")))
    roots = connected_components(near_links(nodes.select("fingerprint"), max_bits))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(
        "id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                     max_bits: int = 4, lenient: bool = True) -> DataFrame:
    """``df`` with one document of each component (the smallest id); all columns as they were.  ``lenient``: rows with
    a null id and all rows with the smallest id stay; else one row of each component stays, null ids last."""
    keyed = with_row_key(by_position(df))
    id_, text = (f"c{df.columns.index(c)}" for c in (id_col, text_col))
    rows = keyed.select(ranked(F.col(id_)).alias("id"), F.col(text).alias("text"))
    found = near_duplicates(rows, "id", "text", shingle, max_bits)
    if lenient:
        gone = found.where("id.id <> component_id.id").select("id.key")
        return drop_rows(keyed, materialize(gone.distinct())).drop(ROW).toDF(*df.columns)
    kept = found.select("id.key", F.expr("id <=> component_id").alias("kept"))
    return one_per_class(keyed, materialize(kept)).toDF(*df.columns)
