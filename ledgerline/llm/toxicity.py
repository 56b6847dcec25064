"""Toxicity by a weighted finite-state grammar over clauses.

Four small transducers read the words of a clause in step and are composed as one product machine:

* insult: a word of the learned lexicon has its weight;
* threat: a verb of harm opens a threat, which counts when a target follows in the clause;
* target: an addressed or named person raises what the clause holds;
* negation and reported speech: a negation weakens the next ``NEGATION_SPAN`` words, a reporting verb or an
  opening quote weakens the rest of the clause.

The score of a clause is what the machine has summed at its end; only whole clauses count.  The features of a
document (sum, best clause, number of matched clauses, sum per 100 words) go through a logistic curve.

What is learned, and from what: labels of rows in the given training set only; text, never label, language,
source or id, enters a score.  (1) The lexicon: words and word beginnings, with the log-odds of the share
of toxic and of other training texts that hold them; a word takes the weight of its longest entry.  Texts
that are equal but for case and white space count once, so copies don't make words look toxic.  Every entry
that passes the odds test (``MIN_TEXTS``, ``MIN_ODDS``, ``MIN_Z``) is kept; of fewer than ``FEW_TOXIC`` toxic texts no entry
could be certain, so those are kept too that ``FEW_TEXTS`` hold and that chance explains badly (``FEW_CHANCE``).  (2) The curve, from counts per rounded
feature vector.  The training set is a sample of at most about ``FIT_ROWS`` labelled rows (all below that), chosen by
a hash of the id; that bounds its broadcast and the lexicon's.  Scoring covers every row and whole texts.

Defined cases: a null or empty text has no clause and the score of a text without matches; null ids, labels
or toxic marks are no training rows; an id labelled twice is toxic if any label says so; with no toxic or
no other training text every score is the share of toxic ones (0 without any label); repeated rows are
scored each; an empty table gives no rows.  Only the id, text and label columns are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import keep_rows
from ledgerline.session import materialize

FIT_ROWS = 100_000
THRESHOLD = 0.7
NEGATION_SPAN = 3
PREFIXES = range(4, 9)
MIN_ODDS = 2.0          # log-odds of an entry of the lexicon, at least
MIN_TEXTS = 5           # training texts that hold it, at least
MIN_Z = 3.0             # its log-odds over their standard error, at least
FEW_TOXIC = 15          # below so many toxic training texts, an entry also passes with
FEW_TEXTS = 2           # so many toxic texts that hold it, and
FEW_CHANCE = 0.02       # this chance, at most, of as many among the texts that hold it

# fixed word lists of the grammar
THREATS = ("kill destroy hurt beat shoot stab burn hang strangle "
           "töte töten schlage verprügle erschieße tuer frapper détruire brûler matar golpear quemar destruir").split()
TARGETS = ("you your yours he him she her they them people "
           "du dich dir euch ihr sie tu toi vous ton votre usted ustedes tú ti vosotros").split()
NEGATIONS = "not no never none without isn't aren't don't nicht kein keine nie ne pas jamais sans nunca jamás sin ni".split()
REPORTS = ("said says say told tells wrote writes called calls reported quoted claims claimed "
           "sagte sagt schrieb nannte dit disait écrit dijo dice escribió llamó").split()

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“«„]")
CLAUSE_END = re.compile(r"[.!?;:\n|]")
FEATURES = ("total", "best", "clauses", "density")
FEATURE_TYPE = ", ".join(f"{f} double" for f in FEATURES)


def words_in(text: str) -> set[str]:
    return {w for w in WORD.findall(text.lower()) if w[0].isalpha()}


def content_key(text: str) -> bytes:
    """Digest of a text's words: copies differ in case and white space only."""
    return hashlib.md5(" ".join(text.lower().split()).encode()).digest()


@dataclass
class Grammar:
    """The learned lexicon with the fixed lists, as one product machine."""
    weights: dict[str, float]                 # beginnings, and whole words with a final '$'
    classes: dict[str, str] = field(init=False)

    def __post_init__(self):
        self.classes = {}
        for name, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)):
            self.classes.update(dict.fromkeys(words, name))
        self.classes.update(dict.fromkeys("\"“«„", "report"))

    def insult(self, word: str) -> float:
        """The weight of the longest entry of a word."""
        whole = self.weights.get(word + "$")
        if whole is not None:
            return whole
        for n in range(min(len(word), PREFIXES[-1]), PREFIXES[0] - 1, -1):
            w = self.weights.get(word[:n])
            if w is not None:
                return w
        return 0.0

    def triggers(self):
        """Automaton over what may start a matched clause."""
        a = ahocorasick.Automaton()
        for entry in [*(e for e, w in self.weights.items() if w > 0), *(t + "$" for t in THREATS)]:
            a.add_word(entry.rstrip("$"), len(entry.rstrip("$")))
        if len(a):
            a.make_automaton()
        return a

    def clause(self, words: list[str]) -> float:
        """Run the product machine over one clause: (negated for, reported, threat open, target seen)."""
        negated, reported, threat, aimed, total = 0, False, 0.0, False, 0.0
        for w in words:
            kind = self.classes.get(w)
            factor = (0.3 if negated else 1.0) * (0.5 if reported else 1.0)
            negated = max(0, negated - 1)
            if kind == "negation":
                negated = NEGATION_SPAN
            elif kind == "report":
                reported = True
            elif kind == "threat":
                threat = 3.0 * factor
            elif kind == "target":
                aimed = True
                total, threat = total + threat, 0.0
            total += max(0.0, self.insult(w)) * factor if w[0].isalpha() else 0.0
        return total * (1.2 if aimed else 1.0)


def features(text: str | None, grammar: Grammar, triggers) -> tuple[float, float, float, float]:
    """(sum of clause scores, best clause, matched clauses, sum per 100 words), damped and rounded."""
    low = (text or "").lower()
    scores = []
    done = 0                                    # end of the last clause scored
    for last, n in triggers.iter(low) if len(triggers) else ():
        first = last + 1 - n
        if last < done or first and low[first - 1].isalpha():
            continue
        end = CLAUSE_END.search(low, last)
        end = end.start() if end else len(low)
        start = max(done, *(low.rfind(c, done, first) + 1 for c in ".!?;:\n|"))
        value = grammar.clause(WORD.findall(low, start, end))
        done = end
        if value > 0:
            scores.append(value)
    total = sum(scores)
    rounded = lambda x, step: round(x / step) * step
    return (rounded(np.log1p(total), 0.25), rounded(min(max(scores, default=0.0), 12.0), 0.5),
            rounded(np.log1p(len(scores)), 0.25), rounded(np.log1p(100 * total / (low.count(" ") + 1)), 0.25))


def training_rows(df: DataFrame, labels: DataFrame, id_col: str, label_id_col: str, toxic_col: str) -> DataFrame:
    """(id, toxic) of at most about FIT_ROWS labelled ids, by a hash of the id; a written table."""
    known = labels.select(F.col(f"`{label_id_col}`").alias("id"), F.col(f"`{toxic_col}`").cast("int").alias("toxic"))
    known = known.where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known)
    n = known.count()
    if n > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < (FIT_ROWS << 20) // n)
    return known


def _texts(rows: DataFrame, train: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(train), "id")      # bounded by FIT_ROWS


def one_per_text(rows: DataFrame, train: DataFrame) -> DataFrame:
    """Of training copies with the same label, the one with the smallest id."""
    def run(batches):
        for b in batches:
            keys = pa.array([content_key(t.as_py() or "") for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), keys], names=["id", "toxic", "content"])

    kind = dict(rows.dtypes)["id"]
    drawn = _texts(rows, train).select("id", "text", "toxic").mapInArrow(run, f"id {kind}, toxic int, content binary")
    return materialize(drawn.groupBy("content", "toxic").agg(F.min("id").alias("id")).select("id", "toxic"))


def learn_lexicon(rows: DataFrame, train: DataFrame) -> dict[str, float]:
    """Entries with their log-odds, from the training texts in ``train`` (id, toxic)."""
    size = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        return {}

    def run(batches):
        for b in batches:
            seen = (Counter(), Counter())
            for text, toxic in zip(b.column(0), b.column(1)):
                seen[toxic.as_py()].update(words_in(text.as_py() or ""))
            words = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(
                pa.array([s[w] for w in words], pa.int64()) for s in (seen[1], seen[0]))], names=["word", "a", "b"])

    counted = (_texts(rows, train.where("toxic in (0, 1)")).select("text", "toxic")
               .mapInArrow(run, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    entry = F.explode(F.concat(
        F.array(F.concat("word", F.lit("$"))),
        F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n <= F.length("word")),
                    lambda n: F.substring(F.col("word"), F.lit(1), n))))
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    entries = materialize(counted.select(entry.alias("entry"), "a", "b").groupBy("entry")
                          .agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
                          .where((F.col("a") + F.col("b")) >= (FEW_TEXTS if n1 < FEW_TOXIC else MIN_TEXTS)).withColumn("odds", odds))
    error = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    passed = (F.col("a") >= MIN_TEXTS) & (F.col("odds") >= MIN_Z * error)
    if n1 < FEW_TOXIC:      # binomial: share ** a * (a + b over a)
        chance = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("a")), F.lit(1.0), lambda p, i: p * (n1 / (n1 + n0)) * (F.col("b") + i) / i)
        passed = passed | F.when(F.col("a") >= FEW_TEXTS, chance <= FEW_CHANCE)
    strong = entries.where(passed & (F.col("odds") >= MIN_ODDS)).collect()
    held = {r["entry"]: r["a"] for r in strong}
    # a beginning that one longer entry accounts for says nothing of its own
    covered = {e[:n] for e, a in held.items() for n in PREFIXES if n < len(e) and a >= 0.9 * held.get(e[:n], a + a)}
    weights = {r["entry"]: float(min(r["odds"], 6.0)) for r in strong if r["entry"] not in covered}
    begins = [e for e in weights if not e.endswith("$")]
    if begins:     # longer entries below a kept beginning may say less: they override it
        kept = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"begin": pa.array(begins, pa.string())})))       # from Arrow: no Python worker reads it
        prefix = F.explode(F.transform(F.filter(F.array(*map(F.lit, PREFIXES)), lambda n: n < F.length("entry")),
                                       lambda n: F.substring(F.col("entry"), F.lit(1), n)))
        weak = (entries.where(F.col("odds") < MIN_ODDS).select("entry", "odds", prefix.alias("begin"))
                .join(kept, "begin").select("entry", "odds").distinct().collect())
        weights.update({r["entry"]: float(max(r["odds"], 0.0)) for r in weak})
    return weights


def document_features(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The features of every row in place of its text."""
    rest = [c for c in rows.columns if c != "text"]
    shared = rows.sparkSession.sparkContext.broadcast(weights)        # entries of at most FIT_ROWS texts

    def run(batches):
        grammar = Grammar(shared.value)
        triggers = grammar.triggers()
        for b in batches:
            found = [features(t.as_py(), grammar, triggers) for t in b.column("text")]
            cols = [pa.array([f[i] for f in found], pa.float64()) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*map(b.column, rest), *cols], names=[*rest, *FEATURES])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rest) + f", {FEATURE_TYPE}")


def fit_curve(counts: list, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps over (features..., toxic, n); the intercept comes last."""
    if not counts:
        return np.array([0.0] * len(FEATURES) + [-np.inf])
    x = np.array([[*(r[f] for f in FEATURES), 1.0] for r in counts])
    y = np.array([float(r["toxic"] == 1) for r in counts])
    n = np.array([float(r["n"]) for r in counts])
    share = (n * y).sum() / n.sum()
    if share in (0.0, 1.0):
        return np.array([0.0] * len(FEATURES) + [np.inf if share else -np.inf])
    w = np.array([0.0] * len(FEATURES) + [np.log(share / (1 - share))])
    penalty = np.diag([ridge] * len(FEATURES) + [0.0])

    def loss(w):
        z = x @ w
        return (n * (np.logaddexp(0, z) - y * z)).sum() + w @ penalty @ w / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)),
                               x.T @ (n * (y - p)) - penalty @ w)
        size = 1.0          # a whole step may overshoot where the classes are set apart, and never come back
        while size > 1e-6 and loss(w + size * step) > loss(w) + 1e-9:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w


def fit(rows: DataFrame, labels: DataFrame, id_col: str, label_id_col: str, toxic_col: str):
    """(lexicon, curve) learned from the labelled ones of ``rows`` (id, text)."""
    distinct = one_per_text(rows, training_rows(rows, labels, id_col, label_id_col, toxic_col))
    weights = learn_lexicon(rows, distinct)
    found = document_features(_texts(rows, distinct).select("id", "text", "toxic"), weights)
    counts = found.groupBy(*FEATURES, "toxic").agg(F.count(F.lit(1)).alias("n")).collect()       # rounded: a bounded grid
    return weights, fit_curve(counts)


def toxicity_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_id_col: str = "doc_id", toxic_col: str = "toxic") -> DataFrame:
    """One row per row of ``df``: ``id``, ``score`` in [0, 1] and the features; ``labels`` holds the ids to
    learn from."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    weights, w = fit(rows, labels, id_col, label_id_col, toxic_col)
    if np.isinf(w[-1]):
        score = F.lit(float(w[-1] > 0))
    else:
        line = sum((F.col(f) * float(c) for f, c in zip(FEATURES, w)), F.lit(float(w[-1])))
        score = 1 / (1 + F.exp(-line))
    return document_features(rows, weights).select("id", score.alias("score"), *FEATURES)


def drop_toxic(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
               lenient: bool = True, label_id_col: str = "doc_id", toxic_col: str = "toxic") -> DataFrame:
    """``df`` without the rows scored at ``threshold`` or more; all columns as they were.  ``lenient``: rows with a
    null id stay.  A row is dropped where it is scored; nothing is shuffled."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    weights, w = fit(rows, labels, id_col, label_id_col, toxic_col)
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def make_test():
        grammar = Grammar(shared.value)
        triggers = grammar.triggers()

        def test(id_, text):
            if lenient and id_ is None:
                return True
            line = w[-1] if np.isinf(w[-1]) else sum((f * c for f, c in zip(features(text, grammar, triggers), w)), w[-1])
            return 1 / (1 + np.exp(-line)) < threshold
        return test

    return keep_rows(df, [id_col, text_col], make_test)
