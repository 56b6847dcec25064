"""Quality by perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over characters (order ``ORDER``) of lower-cased text with white space runs as one space.

* Counting: tasks count the n-grams of the trusted texts in Arrow batches; the counts are summed by n-gram.
* Estimation is joins between count tables that are partitioned by n-gram: lower orders count the different left
  neighbours, each order has three discounts from its counts of counts, and every n-gram is joined to
  its context (total and interpolation weight) and to its suffix (the next lower probability).
* Scoring: the n-gram table is cut into shards of about ``SHARD_ROWS`` rows by the two characters before the
  last, which an n-gram, its suffixes and their contexts share; orders 1 and 2 are in every shard.  Each
  shard is collected to the driver, broadcast and looked up for the n-grams of all documents (an open hash
  table in the tasks); the partial log-probabilities of a document are summed.  No text moves, but all
  shards are live together, so memory grows with the model once it is larger than one shard.
* Thresholds: every ``FOLD``-th trusted id (by a hash) is kept out of the counts; the perplexity quantiles of
  these documents, per language, are what unseen clean text looks like.  A document is kept between its
  language's low and high quantile, bounds included.  A quantile is a value of the held-out documents, by rank (to
  one in ``ACCURACY``; exact below that many documents).

Trusted ids are broadcast up to ``BROADCAST_IDS`` and joined by a shuffle beyond.  The text of every other trusted id is counted.

Defined cases: a null text, or one of white space only, has no characters, a null perplexity and is not kept;
NUL counts as white space; characters from U+1000 on are folded to 4,095 codes; rows with a null id are scored
but never trusted; a null language is a language; a language with under ``MIN_DOCS`` held-out trusted documents takes
the quantiles of all languages; without any counted trusted text there is no perplexity and nothing is kept, and
without a held-out trusted document all trusted ones set the quantiles; an id that is repeated
is scored per row, and is trusted in each; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize

ORDER = 5
BITS = 12                       # of a character code
SLICE_BYTES = 4 << 20           # of text that is worked on at once
SHARD_ROWS = 1 << 20
BROADCAST_IDS = 1_000_000
FOLD = 5                        # one of so many trusted ids is for the thresholds
LOW, HIGH = 0.005, 0.995        # quantiles of held-out trusted perplexity
ACCURACY = 10_000
MIN_DOCS = 20
HASH_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mask(k: int) -> int:
    return (1 << BITS * k) - 1


# ---- n-grams of texts

def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code of the n-gram ending at each character, characters per text); before a text all codes are 0."""
    clean = [" ".join((t or "").lower().replace("\0", " ").split()) for t in texts]
    lens = np.fromiter(map(len, clean), np.int64, len(clean))
    pad = "\0" * (ORDER - 1)
    c = np.frombuffer("".join(pad + t for t in clean).encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.where(c > mask(1), c % mask(1) + 1, c)
    gram = c.copy()
    for back in range(1, ORDER):
        gram[back:] |= c[:-back] << BITS * back
    return gram[c > 0], lens


def _slices(column: pa.Array):
    """Runs of rows with at most SLICE_BYTES of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > SLICE_BYTES:
            yield start, i
            start, held = i, 0
        held += n
    if sizes:
        yield start, len(sizes)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """(gram, n) over the one text column."""
    def run(batches):
        for b in batches:
            for i, j in _slices(b.column(0)):
                gram, n = np.unique(_codes(b.column(0).slice(i, j - i).to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


# ---- estimation

def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts from the counts of counts; a plain 0.5 where they cannot be estimated or are not
    positive (a context with nothing held back would give what it has not seen no probability)."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    own = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5)
    return tuple(d if d > 0 else 0.5 for d in own)


def _key(order: int, gram: Column) -> Column:
    return gram + F.lit(order << BITS * ORDER)


def _pair_shard(gram: Column, shards: int) -> Column:
    pair = gram.bitwiseAND(F.lit(mask(2)))
    return ((pair * 40503 + F.shiftright(pair, 7)) % shards).cast("int")


def train(counts: DataFrame) -> tuple[DataFrame, float]:
    """(key, value, pair) of the model and the log-probability of an unknown character.

    A key >= 0 is order << 60 | n-gram with its log-probability, a key < 0 the complement of order << 60 |
    context with the log of its interpolation weight; ``pair`` are the last two context characters, null for
    rows that belong to every shard."""
    tables = {ORDER: materialize(counts)}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = materialize(tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask(k))).alias("gram"))
                                .agg(F.count(F.lit(1)).alias("n")))
    prob, rows, unknown = None, [], 0.0
    for k in range(1, ORDER + 1):
        t = tables[k]
        seen = t.agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)], F.sum("n"), F.count_if(F.col("n") > 2), F.count(F.lit(1))).first()
        d1, d2, d3 = discounts(*seen[:4])
        left = F.col("n") - F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        if k == 1:
            gamma = (d1 * seen[0] + d2 * seen[1] + d3 * seen[5]) / seen[4] / (seen[6] + 1)
            unknown = float(np.log(gamma))
            prob = t.select("gram", (left / seen[4] + gamma).alias("p"))
        else:
            context = F.shiftright("gram", BITS)
            ctx = t.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), (
                F.count_if(F.col("n") == 1) * d1 + F.count_if(F.col("n") == 2) * d2 + F.count_if(F.col("n") > 2) * d3).alias("held"))
            ctx = materialize(ctx.select("context", "total", (F.col("held") / F.col("total")).alias("gamma")))
            lower = prob.select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            joined = (t.withColumn("context", context).join(ctx, "context")
                      .withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask(k - 1)))).join(lower, "suffix"))
            prob = joined.select("gram", (left / F.col("total") + F.col("gamma") * F.col("lower")).alias("p"))
            pair = F.col("context").bitwiseAND(F.lit(mask(2))) if k > 2 else F.lit(None).cast("long")
            rows.append(ctx.select(F.bitwise_not(_key(k, F.col("context"))).alias("key"), F.log("gamma").alias("value"), pair.alias("pair")))
        prob = materialize(prob)
        pair = F.shiftright("gram", BITS).bitwiseAND(F.lit(mask(2))) if k > 2 else F.lit(None).cast("long")
        rows.append(prob.select(_key(k, F.col("gram")).alias("key"), F.log("p").alias("value"), pair.alias("pair")))
    model = rows[0]
    for r in rows[1:]:
        model = model.unionByName(r)
    return materialize(model), unknown


# ---- scoring

class Table:
    """An open hash table from keys other than 0 to float32, as arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, np.int64), np.zeros(1 << self.bits, np.float32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[at] == 0
            self.key[at[free]] = keys[todo[free]]         # of several the last stays
            placed = self.key[at] == keys[todo]
            self.value[at[placed]] = values[todo[placed]]
            todo, at = todo[~placed], (at[~placed] + 1) % len(self.key)

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * HASH_FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value or 0)."""
        at = self._slot(keys)
        held = self.key[at]
        found = held == keys
        value = np.where(found, self.value[at], np.float32(0))
        open_ = np.flatnonzero(~found & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.key)
            held = self.key[at[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = True
            value[open_[hit]] = self.value[at[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return found, value


def log_probs(gram: np.ndarray, table: Table, unknown: float) -> np.ndarray:
    """The log-probability of each character given those before it."""
    out, live = np.zeros(len(gram)), np.arange(len(gram))
    for k in range(ORDER, 0, -1):
        own = gram[live]
        found, value = table.find((own & mask(k)) + (k << BITS * ORDER))
        out[live] += value
        live, own = live[~found], own[~found]
        if k > 1:
            out[live] += table.find(~((own >> BITS & mask(k - 1)) + (k << BITS * ORDER)))[1]
    out[live] += unknown
    return out


def _shard(model: DataFrame, no: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    own = model.where(F.col("pair").isNull() | (_pair_shard(F.col("pair"), shards) == no)).select("key", F.col("value").cast("float"))
    t = own.toArrow()
    return t.column("key").to_numpy(), t.column("value").to_numpy()


def score(rows: DataFrame, model: DataFrame, unknown: float) -> DataFrame:
    """``rows`` (id, lang, text) as (id, lang, n_chars, log_prob)."""
    sc = rows.sparkSession.sparkContext
    shards = max(1, -(-model.count() // SHARD_ROWS))
    kind = dict(rows.dtypes)
    parts = []
    for no in range(shards):
        shared = sc.broadcast(_shard(model, no, shards))         # about SHARD_ROWS rows

        def run(batches, shared=shared, no=no):
            table = Table(*shared.value)
            for b in batches:
                n_chars, log_prob = [], []
                for i, j in _slices(b.column(2)):
                    gram, lens = _codes(b.column(2).slice(i, j - i).to_pylist())
                    text = np.repeat(np.arange(len(lens)), lens)
                    if shards > 1:
                        pair = gram >> BITS & mask(2)
                        own = (pair * 40503 + (pair >> 7)) % shards == no
                        gram, text = gram[own], text[own]
                    n_chars += lens.tolist()
                    log_prob += np.bincount(text, log_probs(gram, table, unknown), len(lens)).tolist()
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n_chars, pa.int64()),
                                                  pa.array(log_prob, pa.float64())], names=["id", "lang", "same", "n_chars", "log_prob"])

        # equal rows meet again by id and content when there are several shards
        same = F.xxhash64("text", "lang") if shards > 1 else F.lit(None).cast("long")
        parts.append(rows.withColumn("same", same).mapInArrow(
            run, f"id {kind['id']}, lang {kind['lang']}, same long, n_chars long, log_prob double"))
    out = parts[0]
    if shards > 1:
        for p in parts[1:]:
            out = out.unionByName(p)
        out = out.groupBy("id", "lang", "same", "n_chars").agg(F.sum("log_prob").alias("log_prob"), F.count(F.lit(1)).alias("rows"))
        copies = (F.col("rows") / shards).cast("int")
        out = out.withColumn("log_prob", F.col("log_prob") / copies).withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    return out.select("id", "lang", "n_chars", "log_prob")


def quality(df: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per row of ``df``: ``id``, ``lang``, ``n_chars``, ``perplexity`` (per character), the thresholds ``least`` and
    ``most`` of its language and ``kept``.  ``trusted`` has one column, the ids of the trusted documents."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = trusted.toDF("id").where("id is not null").distinct()
    ids = materialize(ids.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLD)) == 0))
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    counts = materialize(ngram_counts(rows.join(side, "id").where("not fold").select("text")))
    none = F.lit(None).cast("double")
    if counts.isEmpty():
        n = F.lit(None).cast("long")
        return rows.select("id", "lang", n.alias("n_chars"), none.alias("perplexity"), none.alias("least"), none.alias("most"),
                           F.lit(False).alias("kept"))
    scored = score(rows, *train(counts))
    per_char = F.when(F.col("n_chars") > 0, F.exp(-F.col("log_prob") / F.col("n_chars")))
    scored = materialize(scored.withColumn("perplexity", per_char))
    own = scored.join(side, "id").where("perplexity is not null")
    bounds = (F.percentile_approx("perplexity", [low, high], ACCURACY).alias("q"), F.count(F.lit(1)).alias("n"))
    by_lang = materialize(own.where("fold").groupBy(F.col("lang").alias("l")).agg(*bounds).where(F.col("n") >= MIN_DOCS))
    overall = own.where("fold").agg(*bounds).first()["q"] or own.agg(*bounds).first()["q"]
    out = scored.join(by_lang, scored["lang"].eqNullSafe(by_lang["l"]), "left")
    least = F.coalesce(F.col("q")[0], F.lit(float(overall[0])))
    most = F.coalesce(F.col("q")[1], F.lit(float(overall[1])))
    kept = F.coalesce(F.col("perplexity").between(F.col("least"), F.col("most")), F.lit(False))
    return out.select("id", "lang", "n_chars", "perplexity", least.alias("least"), most.alias("most")).withColumn("kept", kept)
