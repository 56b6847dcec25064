"""Spelling variants by PartEnum signatures over letter multisets.

A word's letter multiset is a binary vector with a bit for each (letter, occurrence).  One inserted or deleted
letter changes one bit, a replaced letter two, so words one edit apart lie at Hamming distance at most two:

* equal lengths: at most two bits differ.  The bits are dealt into ``PARTS`` parts by letter; at most two parts
  differ, so some choice of ``PARTS`` - 2 parts is the same in both.  Every choice is a signature;
* lengths apart by one: one bit differs; of two parts one is the same, and each is a signature.

An edit also leaves either the first or the last half of the (shorter) word as it is, so each signature is issued
once with each half: a partition of the word in two, of which one part is at distance zero.  That keeps
anagrams, which share all signatures, from meeting.  Signatures are 64-bit hashes and meet in one equi-join;
the join condition verifies the edit distance, so a collision costs a comparison and no result.  A signature that
many words share is an ordinary skewed join key, which adaptive execution splits.

Words are counted over whole texts with a Counter for each run of batches, so a word that a third of all texts
hold moves once per task.

Defined cases: a null text has no words; a null id is written as the empty text in the hash of ``typo_every``;
repeated rows count again; of near words with equal counts the smallest in code-point order is the form; an empty
table gives no rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PARTS = 4
MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5               # a form occurs at least so many times as often as its variant
HELD_WORDS = 1 << 18    # words that a task counts before it hands them on


def counted_runs(text: str | None) -> Counter:
    """The runs of letters of a text, A-Z lower-cased, with their occurrences."""
    return Counter(RUN.findall((text or "").encode().translate(LOWER).decode()))


def with_typo(doc_id: str, run: str, every: int | None) -> str:
    """``run``, or without one letter if the hash of (document, run) is a multiple of ``every``."""
    if every is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
                min_count: int = MIN_COUNT, typo_every: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``min_length`` code points and ``min_count`` occurrences in all texts.
    ``typo_every`` plants typing errors in the runs, as ``with_typo`` says."""
    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for r, n in counted_runs(text.as_py()).items():
                    if len(r) >= min_length:        # an error only shortens a run
                        word = with_typo(doc_id, r, typo_every)
                        if len(word) >= min_length:
                            held[word] += n
            if len(held) > HELD_WORDS:
                yield rows(held)
                held = Counter()
        yield rows(held)

    texts = df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    counted = texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def dealt(word: str, parts: int) -> list[str]:
    """The sorted letters of a word, dealt into parts by letter (any fixed rule will do)."""
    out = [""] * parts
    for c in sorted(word):
        out[(ord(c) * 40503 >> 8) % parts] += c
    return out


def halves(word: str, size: int) -> tuple[str, str]:
    """What an edit at the other end leaves of a word whose shorter partner (or itself) has ``size`` letters."""
    first = size // 2
    return "<" + word[:first], ">" + word[len(word) - (size - first):]


def signatures_of(word: str, parts: int = PARTS) -> list[tuple[str, int]]:
    """(signature, role): role 0 meets words of its length, role 1 (the shorter) meets role 2 (the longer)."""
    n, many, two = len(word), dealt(word, parts), dealt(word, 2)
    chosen = ["|".join([str(c), *(many[p] for p in c)]) for c in combinations(range(parts), parts - 2)]
    same = [(f"={n}{half}{c}", 0) for c in chosen for half in halves(word, n)]
    return same + [(f"+{size}{half}{p}|{two[p]}", role) for role, size in ((1, n), (2, n - 1)) for p in range(2) for half in halves(word, size)]


def signatures(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """(key, role, word, n) for each signature of each word."""
    def run(batches):
        for b in batches:
            found = [signatures_of(w, parts) for w in b.column(0).to_pylist()]
            at = pa.array([i for i, s in enumerate(found) for _ in s], pa.int64())
            keys = [xxhash.xxh64_intdigest(k) - (1 << 63) for s in found for k, _ in s]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([r for s in found for _, r in s], pa.int8()),
                                              b.column(0).take(at), b.column(1).take(at)], names=["key", "role", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "key long, role byte, word string, n long")


def near_pairs(words: DataFrame, parts: int = PARTS) -> DataFrame:
    """Each unordered pair of words exactly one edit apart, once: (a, a_n, b, b_n)."""
    s = materialize(signatures(words, parts))
    left = s.where("role < 2").select("key", "role", F.col("word").alias("a"), F.col("n").alias("a_n"))
    right = s.where("role <> 1").select(F.col("key").alias("key2"), F.col("role").alias("role2"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    meet = (F.col("key") == F.col("key2")) & F.when(F.col("role") == 0, (F.col("role2") == 0) & (F.col("a") < F.col("b"))).otherwise(F.col("role2") == 2)
    # a merge join whatever the estimates say: adaptive execution splits its skewed keys
    return left.join(right.hint("merge"), meet & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of forms.  Pointers double their reach with each round, and counts grow by
    ``RATIO`` along a chain, so a handful of rounds is enough."""
    step = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = step.select(F.col("word").alias("at"), F.col("root").alias("next"))
        moved = materialize(step.join(on, F.col("root") == F.col("at"), "left")
                            .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def spelling_groups(words: DataFrame, ratio: int = RATIO, parts: int = PARTS) -> DataFrame:
    """For each row of ``words`` (word, n; words differ): ``word``, ``form`` (its near word of largest n, if that is
    at least ``ratio`` times its own), ``root`` (the last of the chain of forms), ``n``, ``n_near``, ``form_n``."""
    words = materialize(words)
    pairs = near_pairs(words, parts)
    ends = [F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"{y}_n").alias("n")) for x, y in (("a", "b"), ("b", "a"))]
    near = (pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.word", "e.other", "e.n").groupBy("word")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), F.col("other").alias("other"))).alias("best")))
    found = words.join(near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")), "word", "left")
    is_form = F.col("other_n") >= ratio * F.col("n")
    found = materialize(found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                     F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int | None = None) -> DataFrame:
    """``spelling_groups`` of the words of a corpus."""
    return spelling_groups(word_counts(df, id_col, text_col, typo_every=typo_every))
