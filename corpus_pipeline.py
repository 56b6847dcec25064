"""A training corpus from the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next one's docs.  All but the last return the columns of documents.  A stage decides on rows, not on
ids: where doc_id repeats or is null, each row goes or stays by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.decontamination import drop_contaminated
from ledgerline.llm.exact_dedup import drop_exact_copies
from ledgerline.llm.queries import MODEL, held_out
from ledgerline.llm.simhash import drop_near_copies
from ledgerline.llm.subword import decode, encode
from ledgerline.llm.toxicity import drop_toxic
from ledgerline.session import materialize, scratch_path, text_batches


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go.  Learns from the labels that are not held out."""
    text_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return drop_toxic(docs, labels, lenient=False)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z, one row with the smallest doc_id stays."""
    return drop_exact_copies(docs, lenient=False)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints at 4 or fewer bits, one row with the smallest doc_id stays."""
    text_batches(spark)
    return drop_near_copies(docs, shingle=4, max_bits=4, lenient=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    text_batches(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), lenient=False)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as sampled pieces, reproducible by doc_id, with the digest of the text decoded from them."""
    text_batches(spark)
    # written between the two, so that one Python worker a core is live and not two
    back = decode(materialize(encode(docs, MODEL)), MODEL)
    return back.select("doc_id", "lang", "source", F.size("pieces").alias("n_pieces"), "pieces",
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
                       F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("simhash_dedup", simhash_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: SimHash components, learned toxicity and sampled pieces have no SQL form; tests hold brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
