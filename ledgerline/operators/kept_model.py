"""M2b as a model that is kept and learns batch by batch.

What naive Bayes learns are counts, and counts add up: each batch adds its own (class, token) counts as a layer, and the
model is their sum.  So an import costs what its batch costs; the labelled history is not read again.  A batch that is
learned again replaces its counts.  ``compact`` adds layers up, which bounds the table by classes times tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.constants import MODEL_CONFIDENCE_MIN
from ledgerline.operators.model import nb_counts, nb_suggest
from ledgerline.session import materialize
from ledgerline.sources import files
from ledgerline.sources.layers import FAN_IN, Layers


def _added_up(counts: DataFrame) -> DataFrame:
    return counts.groupBy("c", "t").agg(F.sum("n").alias("n"))


class KeptLabeller:
    """The model at ``path``; ``label`` is the learned column, ``recode`` the table of old labels (P11 c)."""

    def __init__(self, spark: SparkSession, path: str, label: str = "category", recode: DataFrame | None = None,
                 threshold: float = MODEL_CONFIDENCE_MIN):
        self.spark, self.path, self.label, self.recode, self.threshold = spark, path.rstrip("/"), label, recode, threshold
        self.layers = Layers(spark, f"{self.path}/counts", "c string, t string, n bigint")

    def learn(self, rows: DataFrame, tag: str) -> None:
        """Take the labelled rows of batch ``tag`` into the model."""
        self.layers.append(nb_counts(rows, self.label, self.recode), tag)

    def counts(self) -> DataFrame:
        return _added_up(self.layers.read())

    def suggest(self, rows: DataFrame) -> DataFrame:
        """Suggestions for the rows that need a label (F7); none while nothing is learned."""
        return nb_suggest(rows, materialize(self.counts()), self.label, self.threshold)

    def after_import(self, rows: DataFrame, tag: str) -> None:
        """For the stream: learn from an imported batch's labels, then write suggestions for its other rows."""
        self.learn(rows, tag)
        self.suggest(rows).write.mode("overwrite").parquet(f"{self.path}/suggestions/batch_id={tag}")

    def suggestions(self) -> DataFrame:
        """What ``after_import`` wrote: (row_id, suggestion, confidence, review, batch_id)."""
        schema = "row_id string, suggestion string, confidence double, review boolean, batch_id string"
        path = f"{self.path}/suggestions"
        return self.spark.read.schema(schema).parquet(path) if files.exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def compact(self, fan_in: int = FAN_IN, keep: tuple[str, ...] = ()) -> str | None:
        return self.layers.compact(fan_in, _added_up, keep)
