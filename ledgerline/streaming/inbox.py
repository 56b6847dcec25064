"""Statement inbox as a Structured Streaming job (S6, T1) and incremental month refresh.

A file is identified by path, modification time and length, not by its name alone: banks use the same name every month.
``register_arrivals`` lists the inbox and adds what the manifest of arrivals does not hold yet; the stream reads the
manifest, at most ``max_files`` files in each micro-batch, in name order, and imports the files it names.

Exactly-once comes from the stream checkpoint plus idempotent batch writes.  A micro-batch writes its rows into its own
``batch_id=<tag>`` folder with overwrite, its rejects, and last its run log, one row per file.  A replayed batch
without a run log replaces its own output (its dedupe excludes that folder, so it sees the ledger as it was); one
with a run log is not imported again, only what follows (``after_import``, moving files) is finished.

Nothing is lost silently.  Lines that cannot be read are written beside the ledger, with file, line, raw text and reason.
The run log says of every file what became of it: ``imported``; ``no header`` (it cannot be mapped and stays in the inbox
until it changes); ``unreadable`` (it stays, the others go on, and the next run tries it again); ``changed`` (replaced
since it was listed: its new state is an arrival of its own); ``missing``.  Files of other types are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.operators import aggregates as A
from ledgerline.operators.dedupe import import_statements, import_summary
from ledgerline.session import materialize
from ledgerline.sources import files
from ledgerline.sources.monthly import BatchFolders, MonthLedger
from ledgerline.sources.statements import UNMAPPED, parse_statement_lines, source_lines

#: statement files by ending, in any case
STATEMENT_FILES = "*.{[cC][sS][vV],[tT][xX][tT],[tT][sS][vV]}"
MAX_FILES = 1000
IDENTITY = ["path", "modified", "length"]       # modified: ms since 1970
ARRIVAL = "path string, modified bigint, length bigint"
RUN = f"{ARRIVAL}, status string"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if files.exists(spark, path) else spark.createDataFrame([], schema)


def register_arrivals(spark: SparkSession, inbox: str, manifest: str, runs: str | None = None, max_files: int = MAX_FILES) -> int:
    """Add the inbox files that the manifest does not hold, in name order, ``max_files`` to a manifest file; returns
    their number.  A file that was unreadable in every run so far (``runs``) arrives again."""
    meta = F.col("_metadata")
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", STATEMENT_FILES).option("recursiveFileLookup", "true").load(inbox)
              .select(meta["file_path"].alias("path"), F.unix_millis(meta["file_modification_time"]).alias("modified"), meta["file_size"].alias("length")))
    known = _stored(spark, manifest, ARRIVAL).groupBy(*IDENTITY).agg(F.count(F.lit(1)).alias("times"))
    if runs is not None:
        failed = (_stored(spark, runs, RUN).groupBy(*IDENTITY)
                  .agg(F.count(F.lit(1)).alias("runs"), F.every(F.col("status") == "unreadable").alias("failed")))
        known = known.join(failed, IDENTITY, "left").where("not coalesce(failed, false) or times > runs")
    # names only, and only of new files
    new = materialize(listed.join(known, IDENTITY, "left_anti").withColumn("seq", F.row_number().over(Window.orderBy("path")) - 1))
    n = new.count()
    files.make_folder(spark, manifest)
    for start in range(0, n, max_files):        # one after the other: the stream takes manifest files by age
        new.where((F.col("seq") >= start) & (F.col("seq") < start + max_files)).select(*IDENTITY).coalesce(1).write.mode("append").parquet(manifest)
    return n


def statement_stream(spark: SparkSession, manifest: str) -> DataFrame:
    """The arrivals as a stream, one manifest file to a micro-batch."""
    return spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", 1).parquet(manifest)


def arrived_lines(spark: SparkSession, inbox: str, paths: list[str], ledger_id: str | None = None) -> DataFrame:
    """The lines of some inbox files, as the statement reader takes them.  A flat inbox belongs to the one
    ``ledger_id``; without it the inbox has ledger_id= / file_no= folders."""
    if ledger_id is None:
        text = spark.read.format("text").schema("value string, ledger_id string, file_no int").option("basePath", inbox).load(paths)
        return source_lines(text)
    lines = source_lines(spark.read.text(paths))
    return lines.withColumn("ledger_id", F.lit(ledger_id)).withColumn("file_no", F.lit(None).cast("int"))


def _status(spark: SparkSession, arrival) -> str:
    """What a listed file is now; empty if it is as it was listed."""
    try:
        now = files.state(spark, arrival["path"])
    except Exception:                           # whatever the file system says: this file waits, the others go on
        return "unreadable"
    if now is None:
        return "missing"
    return "" if now == (arrival["modified"], arrival["length"]) else "changed"


def _import(spark: SparkSession, inbox: str, ledger: BatchFolders | MonthLedger, rules: DataFrame, tag: str, arrivals: list, ledger_id: str | None,
            rejects_path: str, runs_path: str) -> None:
    """Import one micro-batch of files and write its run log."""
    found = [(r["path"], r["modified"], r["length"], _status(spark, r)) for r in arrivals]
    log = spark.createDataFrame(found, RUN)     # at most max_files
    usable = [path for path, _, _, status in found if not status]
    if usable:
        rows, rejects = parse_statement_lines(spark, arrived_lines(spark, inbox, usable, ledger_id))
        rejects = materialize(rejects)
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/batch_id={tag}")
        # files are imported in the order of their number, then their name
        stamped = rows.join(F.broadcast(log.select("path", "modified")), "path")
        stmts = materialize(stamped.select(
            "ledger_id", F.struct("file_no", "path").alias("file"), F.concat("modified", F.lit("@"), "path", F.lit("#"), "line_no").alias("row_id"), "date",
            "concept", "debit", "credit", F.col("balance").alias("bank_balance"), "reference"))
        imported = materialize(import_statements(stmts, ledger.known(tag), rules, tag, file_col="file"))
        ledger.append(imported.drop("file"), tag)
        counts = import_summary(stmts, imported, "file").where("file is not null").withColumn("path", F.col("file.path")).drop("file")
        rejected = rejects.groupBy("path").agg(F.count(F.lit(1)).alias("n_rejected"), F.max(F.col("reason") == UNMAPPED).alias("unmapped"))
        log = log.join(counts, "path", "left").join(rejected, "path", "left").na.fill(
            0, ["n_read", "n_new", "n_classified", "n_review", "n_rejected"]).na.fill(False, ["alert", "unmapped"])
        done = F.when(F.col("unmapped"), "no header").otherwise("imported")
        log = log.withColumn("status", F.when(F.col("status") == "", done).otherwise(F.col("status"))).drop("unmapped")
    else:
        log = log.select("*", *[F.lit(0).cast("long").alias(c) for c in ("n_read", "n_new", "n_classified", "n_review")],
                         F.lit(False).alias("alert"), F.lit(0).cast("long").alias("n_rejected"))
    log.coalesce(1).write.mode("overwrite").parquet(f"{runs_path}/batch_id={tag}")


def _archive(spark: SparkSession, done: list, archive: str) -> list[tuple[str, str | None]]:
    """Move imported files to the archive under their modification time and name; (path, new name or null)."""
    moved = []
    for r in done:
        if _status(spark, r):                   # moved before, or replaced by a newer file
            continue
        *folders, name = r["path"].split("/")
        stamp = datetime.fromtimestamp(r["modified"] / 1000, timezone.utc).strftime("%Y%m%d_%H%M%S")
        parts = [p for p in folders if "=" in p]                # ledger_id= and file_no= stay in the name
        moved.append((r["path"], files.move(spark, r["path"], f"{archive}/{'_'.join([stamp, *parts, name])}")))
    return moved


def _process(inbox: str, ledger: BatchFolders | MonthLedger, rules: DataFrame, tag_prefix: str, archive: str | None, rejects_path: str, runs_path: str,
             ledger_id: str | None, after_import: Callable[[DataFrame, str], None] | None):
    def run(batch: DataFrame, epoch: int) -> None:
        spark, tag = batch.sparkSession, f"{tag_prefix}{epoch}"
        if not files.exists(spark, f"{runs_path}/batch_id={tag}/_SUCCESS"):
            _import(spark, inbox, ledger, rules, tag, batch.orderBy("path").collect(), ledger_id, rejects_path, runs_path)   # at most max_files
        log = spark.read.parquet(f"{runs_path}/batch_id={tag}")
        done = log.where("status = 'imported'").orderBy("path").collect()
        if after_import and done:
            after_import(ledger.batch(tag), tag)
        if archive:
            moved = _archive(spark, done, archive)
            spark.createDataFrame(moved, "path string, archived string").coalesce(1).write.mode("append").parquet(f"{runs_path}-moves/batch_id={tag}")
    return run


def import_stream(spark: SparkSession, inbox: str, ledger: str | MonthLedger, rules: DataFrame, checkpoint: str,
                  archive: str | None = None, tag_prefix: str = "stream-", max_files: int = MAX_FILES,
                  ledger_id: str | None = None, rejects_path: str | None = None, runs_path: str | None = None, manifest: str | None = None,
                  after_import: Callable[[DataFrame, str], None] | None = None):
    """Import every statement file arriving in ``inbox`` once (trigger availableNow) into ``ledger``: a folder with
    one ``batch_id=`` folder for each batch, or a ``MonthLedger``, of which only the files of a batch's months are read.

    Beside the ledger (its path + '-rejects', '-runs', '-arrivals', unless given): rejects, the run log (A14 per file) and
    the manifest.  With ``archive``, files are moved there when their batch is written, with a time stamp before their
    name; what was moved, and what could not be, is in the run log's path + '-moves'.  ``after_import`` gets each batch's
    ledger rows and tag, for example ``MonthViews.refresh``; a replayed batch may call it again.  Returns the finished query.
    """
    ledger = BatchFolders(spark, ledger) if isinstance(ledger, str) else ledger
    ledger_path = ledger.path
    manifest, runs_path = manifest or f"{ledger_path}-arrivals", runs_path or f"{ledger_path}-runs"
    register_arrivals(spark, inbox, manifest, runs_path, max_files)
    run = _process(inbox, ledger, rules, tag_prefix, archive, rejects_path or f"{ledger_path}-rejects", runs_path, ledger_id, after_import)
    q = (statement_stream(spark, manifest).writeStream.foreachBatch(run)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_log(spark: SparkSession, runs_path: str) -> DataFrame:
    """A14 of the stream: one row for each file of each batch, with status, counts and the alert (anything to review)."""
    return spark.read.option("basePath", runs_path).parquet(runs_path)


def refresh_months(old_months: DataFrame, ledger_after: DataFrame, touched: DataFrame, **kw) -> DataFrame:
    """Month totals after an import, recomputing only the (ledger, month) pairs the import
    touched; untouched months are kept from the previous result."""
    keys = touched.select("ledger_id", "month").distinct()
    fresh = A.month_totals(ledger_after.join(keys, ["ledger_id", "month"], "left_semi"), **kw)
    kept = old_months.join(keys, ["ledger_id", "month"], "left_anti")
    return kept.unionByName(fresh.select(*old_months.columns))
