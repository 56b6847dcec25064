"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all non-ASCII characters.  Every
window of ``window`` consecutive words of an item is a pattern; a shorter item is one pattern.  The
automaton runs over word numbers, so each document is scanned once, however many patterns there
are.  Normalisation keeps the byte positions, so hits map back to spans of the original text.

The benchmark is the only thing broadcast and its size is checked: above ``shard_bytes`` of text it is
cut into shards of at most that size (an item over it is a shard of its own), the documents are
scanned once per shard and the hits of a row are merged.

Defined cases: a null or empty text has no words, no hits and no items; a null or wordless item has no
pattern; items with a null id mark words but are not listed; equal ids count once; a word under several
windows counts once; an empty documents or benchmark table gives no rows, or rows without hits.
Only the id and text columns are read.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import keep_rows
from ledgerline.session import materialize

WINDOW = 10
SHARD_BYTES = 1 << 20       # of benchmark text; its windows take about 100 times as much memory

#: byte → byte: A-Z to a-z; separators to a space; digits, a-z and the bytes of non-ASCII characters stay
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))

#: a hit passage: words [first, past) and characters [start, end) of the original text
SPAN = "struct<first:int,past:int,start:int,end:int>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Patterns:
    """The windows of some benchmark items; the automaton is built where it is first used."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            words = words_of(text)
            ids = tuple(self.vocab.setdefault(w, len(self.vocab) + 1) for w in words)
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                self.windows.setdefault(ids[i:i + window], set()).add(item_id)

    def automaton(self):
        a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for ids, items in self.windows.items():
            a.add_word(ids, (len(ids), items))
        a.make_automaton()
        return a


def _merged(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def scan(text: str | None, vocab: dict, automaton):
    """(number of words, merged hit spans in words, ids of the items found)."""
    words = words_of(text)
    ids = tuple(map(vocab.get, words, repeat(0)))
    if not automaton or not any(ids):
        return len(words), [], set()
    spans, items = [], set()
    for last, (n, found) in automaton.iter(ids):
        spans.append((last + 1 - n, last + 1))
        items |= found
    return len(words), _merged(spans), items


def char_spans(text: str, spans) -> list[tuple[int, int]]:
    """Word spans as spans of the original text's characters."""
    raw = text.encode()
    at = np.flatnonzero(np.diff(np.concatenate(([True], np.frombuffer(raw.translate(NORMAL), np.uint8) == 32, [True]))))
    chars = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)))
    return [(int(chars[at[2 * s]]), int(chars[at[2 * e - 1]])) for s, e in spans]


def _scanned(rows: DataFrame, shard) -> DataFrame:
    def run(batches):
        vocab, automaton = shard.value.vocab, shard.value.automaton() if shard.value.windows else None
        for b in batches:
            out = [[], [], []]
            for t in b.column(1):
                text = t.as_py()
                n, spans, items = scan(text, vocab, automaton)
                chars = char_spans(text, spans) if spans else []
                out[0].append(n)
                out[1].append([{"first": f, "past": p, "start": s, "end": e} for (f, p), (s, e) in zip(spans, chars)])
                out[2].append(sorted(str(i) for i in items if i is not None))
            span = pa.list_(pa.struct([(f, pa.int32()) for f in ("first", "past", "start", "end")]))
            kinds = (pa.int64(), span, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, out, kinds)],
                                             names=["id", "key", "n_words", "spans", "items"])

    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, key binary, n_words long, spans array<{SPAN}>, items array<string>")


#: SQL: the sorted union of an array of spans; spans that touch in words are one
UNION = (f"aggregate(array_sort(spans), cast(array() as array<{SPAN}>), (acc, x) -> "
         "if(size(acc) > 0 and x.first <= element_at(acc, -1).past, "
         "concat(slice(acc, 1, size(acc) - 1), array(named_struct('first', element_at(acc, -1).first, "
         "'past', greatest(element_at(acc, -1).past, x.past), 'start', element_at(acc, -1).start, "
         "'end', greatest(element_at(acc, -1).end, x.end)))), concat(acc, array(x))))")


def _shards(benchmark: DataFrame, item_col: str, text_col: str, shard_bytes: int):
    """Bounded runs of benchmark items, one at a time."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"),
                             F.col(f"`{text_col}`").cast("string").alias("text"))
    shard, held = [], 0
    for r in items.toLocalIterator():
        n = len((r["text"] or "").encode())
        if shard and held + n > shard_bytes:
            yield shard
            shard, held = [], 0
        shard.append((r["item"], r["text"]))
        held += n
    yield shard


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_words``, ``n_hit``, ``items`` (sorted ids of the items with
    occurring windows), ``spans`` (hit passages as character spans of the original text)."""
    sc = df.sparkSession.sparkContext
    text = F.col(f"`{text_col}`").cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    scans = []
    for no, items in enumerate(_shards(benchmark, item_col, item_text_col, shard_bytes)):
        if no == 1:      # more than one shard: equal rows find each other again by id and content
            rows = rows.withColumn("key", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
        scans.append(sc.broadcast(Patterns(items, window)))
    if "key" not in rows.columns:
        rows = rows.withColumn("key", F.lit(None).cast("binary"))
    found = _scanned(rows, scans[0])
    if len(scans) > 1:
        for s in scans[1:]:
            found = found.unionByName(_scanned(rows, s))
        found = found.groupBy("id", "key", "n_words").agg(
            F.count(F.lit(1)).alias("n"), F.flatten(F.collect_set("spans")).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        found = found.withColumn("spans", F.expr(UNION)).withColumn(
            "copy", F.explode(F.sequence(F.lit(1), (F.col("n") / len(scans)).cast("int"))))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.past - x.first)")
    spans = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    return found.select("id", "n_words", n_hit.alias("n_hit"), "items", spans.alias("spans"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      lenient: bool = True, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``df`` without the rows that hold a benchmark window; all columns as they were.  ``lenient``: rows with a
    null id stay.  Rows are dropped where they are scanned; what survives a shard of the benchmark is written and
    meets the next, so one shard is live at a time."""
    sc, shard = df.sparkSession.sparkContext, None
    for items in _shards(benchmark, item_col, item_text_col, shard_bytes):
        if shard is not None:
            df = materialize(df)
            shard.unpersist()
        shard = sc.broadcast(Patterns(items, window))

        def make_test(shard=shard):
            vocab, automaton = shard.value.vocab, shard.value.automaton() if shard.value.windows else None
            return lambda id_, text: lenient and id_ is None or not scan(text, vocab, automaton)[1]

        df = keep_rows(df, [id_col, text_col], make_test)
    return df
