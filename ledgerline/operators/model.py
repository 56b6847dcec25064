"""Text + amount labeller (M1, M2) and its SQL-checkable stand-in.

M1/M2 use ``pyspark.ml``: the model text (P15) as tokens plus bigrams → HashingTF (sublinear) → IDF,
with the standardised amount, into linear support vector machines, one class against the others.  Their margins become
probabilities by a sigmoid for each class, fitted on rows that the machine has not seen.

M2b is a multinomial naive Bayes with add-one smoothing on the same tokens, written as joins and
aggregates: training is a (class, token) count; scoring joins each row's tokens to those counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.constants import MODEL_CONFIDENCE_MIN, MODEL_STOP_WORDS
from ledgerline.functions.labels import recode_category
from ledgerline.functions.numbers import signed_amount
from ledgerline.functions.predicates import is_training_row, needs_label
from ledgerline.functions.text import model_text
from ledgerline.session import materialize

#: width of the hashed term space of M1; terms that share a slot add up, none is dropped
HASHED_TERMS = 1 << 13
PARALLEL_FITS = 8
FOLDS = 2
SMALL_CLASS = 1000      # rows of a class up to which its folds are dealt in turn
TEXT_COLS = ("concept", "reference", "destination", "origin")


def with_model_tokens(df: DataFrame, label: str = "category", stop_words=MODEL_STOP_WORDS) -> DataFrame:
    cols = [c if c in df.columns else F.lit("") for c in TEXT_COLS]
    return (df.withColumn("_text", model_text(*cols, stop_words=stop_words))
              .withColumn("tokens", F.filter(F.split("_text", " "), lambda t: t != ""))
              .withColumn("amount", signed_amount("credit", "debit")))


# ---- M2b: naive Bayes ------------------------------------------------------------------------

def nb_labeller(df: DataFrame, label: str = "category", threshold: float = MODEL_CONFIDENCE_MIN,
                stop_words=MODEL_STOP_WORDS) -> DataFrame:
    """Train on labelled rows (F8), suggest for rows needing a label.

    score(row, c) = log(docs_c / docs) + Σ_t log((n_ct + 1) / (tokens_c + V)) over the row's known
    tokens; suggestion = arg max (ties by name); confidence = its softmax probability (4 dp);
    review = confidence < threshold.  Output: row_id, suggestion, confidence, review.

    Scores depend on the token list alone, so each distinct list is scored once and joined back.  A class that
    holds none of a list's k known tokens scores a + k·b: those are summarised per k, and only classes that
    hold some token are listed per list.  So no class count is limited and none comes to the driver.
    """
    return nb_suggest(df, materialize(nb_counts(df, label, stop_words=stop_words)), label, threshold, stop_words)


def nb_counts(df: DataFrame, label: str = "category", recode: DataFrame | None = None, stop_words=MODEL_STOP_WORDS) -> DataFrame:
    """What M2b learns from the labelled rows (F8): (class c, token t, occurrences n), and the class's rows at a null token.
    Counts of several batches add up.  With ``recode``, old labels are translated first (P11 c)."""
    d = with_model_tokens(recode_category(df, recode, "any", label=label) if recode is not None else df, label, stop_words)
    one = F.array(F.lit(None).cast("string"))
    return (d.where(is_training_row(label)).select(F.col(label).alias("c"), F.explode(F.concat(one, "tokens")).alias("t"))
             .groupBy("c", "t").agg(F.count(F.lit(1)).alias("n")))


def nb_suggest(df: DataFrame, learned: DataFrame, label: str = "category", threshold: float = MODEL_CONFIDENCE_MIN,
               stop_words=MODEL_STOP_WORDS) -> DataFrame:
    """M2b's scoring of the rows of ``df`` that need a label, by the counts of ``nb_counts``."""
    pred = with_model_tokens(df, label, stop_words).where(needs_label(label)).select("row_id", "tokens")
    pred = materialize(pred)            # read several times below
    counts, docs = learned.where("t is not null"), learned.where("t is null").select("c", F.col("n").alias("docs"))
    vocab = counts.select("t").distinct()
    tok = counts.groupBy("c").agg(F.sum("n").alias("tok"))
    v, total_docs = vocab.count(), docs.agg(F.sum("docs")).first()[0] or 0         # two numbers to the driver
    params = docs.join(tok, "c", "left").select(
        "c", F.log(F.col("docs") / total_docs).alias("a"), (-F.log(F.coalesce("tok", F.lit(0)) + v)).alias("b"))

    lists = pred.select("tokens").distinct()
    known = lists.select("tokens", F.explode("tokens").alias("t")).join(vocab, "t", "left_semi")
    sizes = lists.join(known.groupBy("tokens").agg(F.count(F.lit(1)).alias("k")), "tokens", "left").select(
        "tokens", F.coalesce("k", F.lit(0)).alias("k"))
    sizes = materialize(sizes)
    longest = sizes.agg(F.max("k")).first()[0] or 0
    base = params.select("c", "a", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(longest).cast("long"))).alias("k"))
    base = materialize(base.select("k", "c", (F.col("a") + F.col("k") * F.col("b")).alias("base")))
    plain = base.groupBy("k").agg(F.max("base").alias("top"), F.min_by("c", F.struct((-F.col("base")).alias("s"), "c")).alias("top_c"))
    sums = base.join(plain.select("k", "top"), "k").groupBy("k").agg(F.sum(F.exp(F.col("base") - F.col("top"))).alias("mass"))
    plain = plain.join(sums, "k")

    held = known.join(counts, "t").groupBy("tokens", "c").agg(F.sum(F.log(F.col("n") + 1)).alias("s"))
    held = held.join(sizes, "tokens").join(base, ["k", "c"]).select("tokens", "c", "base", (F.col("base") + F.col("s")).alias("score"))
    best = held.groupBy("tokens").agg(F.max("score").alias("score"), F.min_by("c", F.struct((-F.col("score")).alias("s"), "c")).alias("best_c"))
    # classes that hold tokens count with their own score instead of the plain one, all relative to the best
    all_ = sizes.join(plain, "k").join(best, "tokens", "left")
    from_held = F.col("score").isNotNull() & ((F.col("score") > F.col("top")) | ((F.col("score") == F.col("top")) & (F.col("best_c") < F.col("top_c"))))
    tops = all_.select("tokens", F.when(from_held, F.col("score")).otherwise(F.col("top")).alias("mx"),
                       F.when(from_held, F.col("best_c")).otherwise(F.col("top_c")).alias("suggestion"), "top", "mass")
    moved = held.join(tops.select("tokens", "mx"), "tokens").groupBy("tokens").agg(
        F.sum(F.exp(F.col("score") - F.col("mx")) - F.exp(F.col("base") - F.col("mx"))).alias("moved"))
    total = F.col("mass") * F.exp(F.col("top") - F.col("mx")) + F.coalesce("moved", F.lit(0.0))
    scored = tops.join(moved, "tokens", "left").select("tokens", "suggestion", F.round(F.lit(1.0) / total, 4).alias("confidence"))
    return pred.join(scored, "tokens").select("row_id", "suggestion", "confidence", (F.col("confidence") < threshold).alias("review"))


# ---- M1 / M2: calibrated linear machines -------------------------------------------------------

@dataclass
class Labeller:
    """What M1 has learned: the feature stages and, for each fold and class, a linear machine and its sigmoid."""
    features: object
    hashed_terms: int
    classes: list[str]
    machines: dict          # (fold, class number) → LinearSVCModel
    sigmoids: dict          # (fold, class number) → (a, b); empty: not calibrated


def _feature_stages():
    """Damped counts of hashed terms, weighted and of unit length, beside the standardised amount."""
    from pyspark.ml.feature import IDF, Normalizer, StandardScaler, VectorAssembler
    return [
        IDF(inputCol="_dtf", outputCol="_tfidf"),
        Normalizer(inputCol="_tfidf", outputCol="_text_vec"), VectorAssembler(inputCols=["_amt_d"], outputCol="_amt_vec"),
        StandardScaler(inputCol="_amt_vec", outputCol="_amt", withMean=True, withStd=True),
        VectorAssembler(inputCols=["_text_vec", "_amt"], outputCol="features")]


def _with_terms(df: DataFrame, label: str) -> DataFrame:
    from pyspark.ml.feature import NGram
    d = NGram(n=2, inputCol="tokens", outputCol="_bigrams").transform(with_model_tokens(df, label))
    return d.withColumn("terms", F.concat("tokens", "_bigrams")).withColumn("_amt_d", F.col("amount").cast("double"))


def _term_rows(df: DataFrame, label: str, hashed_terms: int) -> DataFrame:
    """row_id, the trimmed label ``_c``, the amount and ``_dtf``: tokens and bigrams, hashed (no vocabulary on the driver, none to
    cut), each slot's count damped to 1 + ln(tf).  The rows are computed once: ``_dtf`` is written as the plain structure below a
    vector, whose values an expression can damp, and read back as a vector, so that no row goes to Python."""
    from pyspark.ml.feature import HashingTF
    d = HashingTF(inputCol="terms", outputCol="_tf", numFeatures=hashed_terms).transform(_with_terms(df, label))
    tf = F.unwrap_udt("_tf")
    d = d.select("row_id", F.trim(label).alias("_c"), "_amt_d",
                 tf.withField("values", F.transform(tf["values"], lambda n: 1 + F.ln(n))).alias("_dtf"))
    schema = T.StructType([T.StructField(f.name, VectorUDT() if f.name == "_dtf" else f.dataType) for f in d.schema])
    return materialize(d, schema)


def _in_folds(d: DataFrame, counts: dict, folds: int) -> DataFrame:
    """``_fold`` by a hash of the row id; the rows of small classes are dealt in turn, so that each fold has some."""
    small = [k for k, n in counts.items() if n <= SMALL_CLASS]
    turn = F.row_number().over(Window.partitionBy("_y").orderBy(F.xxhash64("row_id"), "row_id")) % folds
    few = d.where(F.col("_y").isin(small)).withColumn("_fold", turn.cast("int"))          # at most SMALL_CLASS rows in a partition
    many = d.where(~F.col("_y").isin(small)).withColumn("_fold", F.pmod(F.xxhash64("row_id"), F.lit(folds)).cast("int"))
    return few.unionByName(many)


def fit_sigmoid(counts: list[tuple[float, int, int]]) -> tuple[float, float]:
    """(a, b) of p = 1 / (1 + exp(a * margin + b)) that fits (margin, positives, negatives) best, by Newton steps; targets are
    drawn in by one count on either side, so few rows give no certainty."""
    m, pos, neg = (np.array(x, dtype=float) for x in zip(*counts))
    high, low = (pos.sum() + 1) / (pos.sum() + 2), 1 / (neg.sum() + 2)
    n, t = pos + neg, pos * high + neg * low
    w = np.array([0.0, np.log((neg.sum() + 1) / (pos.sum() + 1))])
    x = np.stack([m, np.ones_like(m)], axis=1)

    def loss(w):
        z = x @ w
        return (t * np.logaddexp(0, z) + (n - t) * np.logaddexp(0, -z)).sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (t - n * p))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w) + 1e-12:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def train_labeller(df: DataFrame, label: str = "category", hashed_terms: int = HASHED_TERMS, recode: DataFrame | None = None,
                   folds: int = FOLDS, max_iter: int = 10) -> Labeller:
    """M1: one linear machine for each class against the others, trained on the labelled rows (F8) outside a fold, and a
    sigmoid for its margins fitted on the rows of that fold.  Needs at least two classes; if a class has a single row
    nothing is calibrated and confidence is 1.  With ``recode``, old labels are translated first (P11 c)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    d = (recode_category(df, recode, "any", label=label) if recode is not None else df).where(is_training_row(label))
    d = _term_rows(d, label, hashed_terms)
    sizes = {r["c"]: r["n"] for r in d.groupBy(F.col("_c").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = sorted(sizes)
    if len(classes) < 2:
        raise ValueError("at least two labelled classes are needed")
    number = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    d = d.withColumn("_y", number[F.col("_c")])
    stages = Pipeline(stages=_feature_stages()).fit(d)
    calibrated = min(sizes.values()) >= 2
    rows = stages.transform(d).select("row_id", "_y", "features")
    rows = _in_folds(rows, {classes.index(c): n for c, n in sizes.items()}, folds) if calibrated else rows.withColumn("_fold", F.lit(-1))
    rows = materialize(rows)
    tasks = [(f, k) for f in range(folds if calibrated else 1) for k in range(len(classes))]
    others = {f: rows.where(F.col("_fold") != f).cache() for f in {f for f, _ in tasks}}
    sizes_of = {f: d.count() for f, d in others.items()}

    def fit(task):
        f, k = task
        svc = LinearSVC(featuresCol="features", labelCol="_is", maxIter=max_iter, regParam=1.0 / sizes_of[f],
                        rawPredictionCol=f"_raw_{f}_{k}", predictionCol=f"_pred_{f}_{k}")
        return task, svc.fit(others[f].withColumn("_is", (F.col("_y") == k).cast("double")))

    with ThreadPool(PARALLEL_FITS) as pool:     # a fit is many short jobs
        machines, sigmoids = dict(pool.map(fit, tasks)), {}
    for f, d in others.items():
        d.unpersist()
    for f in range(folds if calibrated else 0):
        scored = _margins(rows.where(F.col("_fold") == f), machines, f, len(classes))
        margin = F.explode(F.transform("_m", lambda m, k: F.struct(k.alias("k"), F.round(m, 2).alias("m"))))
        counts = (scored.select("_y", margin.alias("x")).groupBy("x.k", "x.m")
                  .agg(F.count_if(F.col("_y") == F.col("x.k")).alias("p"), F.count_if(F.col("_y") != F.col("x.k")).alias("n")).collect())
        for k in range(len(classes)):       # margins on a grid: a bounded table
            sigmoids[f, k] = fit_sigmoid([(r["m"], r["p"], r["n"]) for r in counts if r["k"] == k])
    return Labeller(stages, hashed_terms, classes, machines, sigmoids)


def _margins(rows: DataFrame, machines: dict, fold: int, n: int) -> DataFrame:
    """``rows`` with the margins of a fold's machines as the array ``_m``."""
    for k in range(n):
        rows = machines[fold, k].transform(rows)
    margins = F.array(*[vector_to_array(f"_raw_{fold}_{k}")[1] for k in range(n)])
    return rows.withColumn("_m", margins).drop(*[f"_{x}_{fold}_{k}" for x in ("raw", "pred") for k in range(n)])


def suggest_labels(model: Labeller, df: DataFrame, label: str = "category", threshold: float = MODEL_CONFIDENCE_MIN) -> DataFrame:
    """M2: the class of the highest probability (ties by name) for rows needing a label (F7), its probability (the mean over the
    folds' machines, each summing to 1) and whether it is to be reviewed."""
    rows = model.features.transform(_term_rows(df.where(needs_label(label)), label, model.hashed_terms)).select("row_id", "features")
    folds = sorted({f for f, _ in model.machines})
    n = len(model.classes)
    shares = []
    for f in folds:
        rows = _margins(rows, model.machines, f, n).withColumnRenamed("_m", f"_m{f}")
        if model.sigmoids:
            p = F.array(*[1 / (1 + F.exp(model.sigmoids[f, k][0] * F.col(f"_m{f}")[k] + model.sigmoids[f, k][1])) for k in range(n)])
            rows = rows.withColumn(f"_p{f}", p)
            shares.append((f"_p{f}", F.aggregate(f"_p{f}", F.lit(0.0), lambda acc, x: acc + x)))
    names = F.array(*[F.lit(c) for c in model.classes])
    if model.sigmoids:
        scores = F.array(*[sum((F.col(p)[k] / total for p, total in shares), F.lit(0.0)) / len(folds) for k in range(n)])
    else:
        scores = F.col(f"_m{folds[0]}")
    best = rows.withColumn("_s", scores).withColumn("_top", F.array_max("_s"))
    conf = F.round("_top", 4) if model.sigmoids else F.lit(1.0)
    return best.select("row_id", F.element_at(names, F.array_position("_s", F.col("_top")).cast("int")).alias("suggestion"),
                       conf.alias("confidence"), (conf < threshold).alias("review"))
