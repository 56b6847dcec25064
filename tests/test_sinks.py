"""Sinks and the streaming import: parquet append with observed counts (S3), exactly-once."""

from pyspark.sql import functions as F

from ledgerline.operators.dedupe import import_statements
from ledgerline.plans.labelling import rules
from ledgerline.session import scratch_path
from ledgerline.sources import adapter
from ledgerline.sources.ledger import append_movements
from ledgerline.sources.statements import write_statement_files
from ledgerline.sources import files
from ledgerline.streaming import inbox as inbox_module
from ledgerline.streaming.inbox import import_stream, run_log
from ledgerline.streaming.views import MonthViews

from conftest import SF_SMALL


def test_append_writes_and_counts(spark):
    inc = adapter.incoming_rows(spark, SF_SMALL)
    imported = import_statements(inc, adapter.existing_ledger(spark, SF_SMALL), rules(spark, SF_SMALL), "b1")
    path = scratch_path(spark, "ledger-append")
    rows, c = append_movements(imported, path)
    back = spark.read.parquet(path)
    assert c["added"] == back.count() == imported.count()
    assert c["unclassified"] == back.where("review").count()
    assert back.where((F.col("debit") == 0) | (F.col("credit") == 0)).count() == 0   # zeros stored as null


def test_stream_import_is_exactly_once(spark):
    inbox = write_statement_files(adapter.incoming_rows(spark, SF_SMALL), scratch_path(spark, "inbox"))
    led = scratch_path(spark, "ledger")
    (adapter.existing_ledger(spark, SF_SMALL).drop("batch_id")
        .write.mode("overwrite").parquet(f"{led}/batch_id=initial"))
    ckpt = scratch_path(spark, "ckpt")
    r = rules(spark, SF_SMALL)
    import_stream(spark, inbox, led, r, ckpt)
    first = spark.read.parquet(led).count()
    import_stream(spark, inbox, led, r, ckpt)          # same checkpoint: nothing new to process
    assert spark.read.parquet(led).count() == first
    batch = import_statements(adapter.incoming_rows(spark, SF_SMALL), adapter.existing_ledger(spark, SF_SMALL), r, "x")
    assert first - adapter.existing_ledger(spark, SF_SMALL).count() == batch.count()


def _inbox_file(inbox, name, text):
    import os
    os.makedirs(os.path.dirname(os.path.join(inbox, name)), exist_ok=True)
    with open(os.path.join(inbox, name), "wb") as f:
        f.write(text.encode("latin-1"))


def test_flat_inbox_rejects_and_archive(spark):
    """A flat folder: files by name, rejects beside the ledger, an unreadable file and other types stay."""
    import os
    inbox = scratch_path(spark, "inbox").removeprefix("file:")
    archive = scratch_path(spark, "archive").removeprefix("file:")
    led, ckpt = scratch_path(spark, "ledger"), scratch_path(spark, "ckpt")
    (adapter.existing_ledger(spark, SF_SMALL).drop("batch_id").write.mode("overwrite").parquet(f"{led}/batch_id=initial"))
    head = "Fecha;Concepto;Débito;Crédito;Referencia\n"
    _inbox_file(inbox, "b.csv", head + "02/01/2030;COMPRA RED RING  1 Brand#1;10,00;;R2\n")
    _inbox_file(inbox, "a.CSV", head + "02/01/2030;COMPRA RED RING  1 Brand#1;10,00;;R1\nmal;SIN FECHA;1;;\n")
    _inbox_file(inbox, "bad.csv", "nothing to see\n")
    _inbox_file(inbox, "x.pdf", head)
    seen = []
    r = rules(spark, SF_SMALL)
    import_stream(spark, inbox, led, r, ckpt, archive=archive, ledger_id="1", after_import=lambda rows, tag: seen.append((tag, rows.count())))
    new = spark.read.parquet(led).where("batch_id <> 'initial'").collect()
    assert [(x["ledger_id"], x["reference"]) for x in new] == [("1", "R1")]        # a.CSV comes before b.csv
    assert new[0]["row_id"].endswith("a.CSV#1") and seen == [("stream-0", 1)]
    rejects = spark.read.parquet(f"{led}-rejects").collect()
    assert sorted((os.path.basename(x["path"]), x["line_no"], x["reason"], x["raw"]) for x in rejects) == [
        ("a.CSV", 2, "unreadable date", "mal;SIN FECHA;1;;"), ("bad.csv", 0, "no date or amount column", "nothing to see")]
    names = lambda: sorted(f.split("_", 2)[2] for f in os.listdir(archive) if not f.startswith("."))  # noqa: E731  after yyyyMMdd_HHmmss_
    assert names() == ["a.CSV", "b.csv"]
    assert sorted(f for f in os.listdir(inbox) if not f.startswith(".")) == ["bad.csv", "x.pdf"]
    _inbox_file(inbox, "c.csv", head + "03/01/2030;COMPRA BLUE BOLT  2 Brand#2;20,00;;R3\n")
    import_stream(spark, inbox, led, r, ckpt, archive=archive, ledger_id="1")
    assert spark.read.parquet(led).where("batch_id <> 'initial'").count() == 2     # each file counts once
    assert names() == ["a.CSV", "b.csv", "c.csv"]


HEAD = "Fecha;Concepto;Débito;Crédito;Referencia\n"


def _inbox(spark, initial=True):
    paths = [scratch_path(spark, n).removeprefix("file:") for n in ("inbox", "archive", "ledger", "ckpt")]
    led = adapter.existing_ledger(spark, SF_SMALL).limit(20)
    led.drop("batch_id").write.parquet(f"{paths[2]}/batch_id=initial")
    return paths


def _new_rows(spark, led):
    return sorted(r["reference"] for r in spark.read.parquet(led).where("batch_id <> 'initial'").collect())


def _log(spark, led):
    import os
    return sorted((os.path.basename(r["path"]), r["batch_id"], r["status"], r["n_read"], r["n_new"], r["n_review"], r["n_rejected"], r["alert"])
                  for r in run_log(spark, f"{led}-runs").collect())


def test_reused_file_name_is_imported_again(spark):
    """The monthly statement of the same name: each state of the name is an arrival of its own, archived or not."""
    import os
    r = rules(spark, SF_SMALL).limit(3)
    for with_archive in (True, False):
        inbox, archive, led, ckpt = _inbox(spark)
        views = MonthViews(spark, f"{led}-views", buckets=1)
        kw = {"archive": archive, "after_import": views.refresh} if with_archive else {}
        _inbox_file(inbox, "mov.csv", HEAD + "02/01/2030;COMPRA RED RING;10,00;;R1\n")
        import_stream(spark, inbox, led, r, ckpt, ledger_id="1", **kw)
        assert _new_rows(spark, led) == ["R1"]
        _inbox_file(inbox, "mov.csv", HEAD + "02/02/2030;NADA CONOCIDO;7000,00;;R2\nmal;X;1;;\n")
        import_stream(spark, inbox, led, r, ckpt, ledger_id="1", **kw)
        assert _new_rows(spark, led) == ["R1", "R2"]
        assert len({x["row_id"] for x in spark.read.parquet(led).where("batch_id <> 'initial'").collect()}) == 2
        assert [x[:5] + x[6:7] for x in _log(spark, led)] == [("mov.csv", "stream-0", "imported", 1, 1, 0), ("mov.csv", "stream-1", "imported", 1, 1, 1)]
        if with_archive:
            assert {m["month"] for m in views.month_totals().collect()} == {"2030-01", "2030-02"}
            assert sorted(f.split("_", 2)[2].split("~")[0] for f in os.listdir(archive) if not f.startswith(".")) == ["mov.csv"] * 2


def test_unreadable_and_vanished_files_do_not_stop_the_others(spark, monkeypatch):
    import os
    inbox, archive, led, ckpt = _inbox(spark)
    r = rules(spark, SF_SMALL)
    for n in "abc":
        _inbox_file(inbox, f"{n}.csv", HEAD + f"02/01/2030;COMPRA RED RING {n};10,00;;{n}\n")
    state, listed = files.state, inbox_module.register_arrivals

    def broken(s, uri):
        if uri.endswith("b.csv"):
            raise OSError("broken disk")
        return state(s, uri)

    def and_one_vanishes(*a, **kw):
        n = listed(*a, **kw)
        os.remove(os.path.join(inbox, "c.csv"))
        return n
    with monkeypatch.context() as m:
        m.setattr(files, "state", broken)
        m.setattr(inbox_module, "register_arrivals", and_one_vanishes)
        import_stream(spark, inbox, led, r, ckpt, archive=archive, ledger_id="1")
    assert _new_rows(spark, led) == ["a"]
    assert [x[:3] for x in _log(spark, led)] == [("a.csv", "stream-0", "imported"), ("b.csv", "stream-0", "unreadable"), ("c.csv", "stream-0", "missing")]
    with monkeypatch.context() as m:            # the file can be read again, but not moved
        m.setattr(files, "move", lambda *a: None)
        import_stream(spark, inbox, led, r, ckpt, archive=archive, ledger_id="1")
    assert _new_rows(spark, led) == ["a", "b"]
    moves = {os.path.basename(x["path"]): x["archived"] for x in spark.read.parquet(f"{led}-runs-moves").collect()}
    assert moves["a.csv"] is not None and moves["b.csv"] is None and os.path.exists(os.path.join(inbox, "b.csv"))


def test_interrupted_batch_is_finished(spark):
    """After the run log is written a replay imports nothing again, but finishes what follows."""
    inbox, archive, led, ckpt = _inbox(spark)
    r, calls = rules(spark, SF_SMALL), []
    _inbox_file(inbox, "a.csv", HEAD + "02/01/2030;COMPRA RED RING;10,00;;R1\n02/01/2030;COMPRA RED RING;10,00;;R1\n")

    def after(rows, tag):
        calls.append((tag, rows.count()))
        if len(calls) == 1:
            raise RuntimeError("lost")
    try:
        import_stream(spark, inbox, led, r, ckpt, archive=archive, ledger_id="1", after_import=after)
    except Exception as e:
        assert "lost" in str(e)
    import_stream(spark, inbox, led, r, ckpt, archive=archive, ledger_id="1", after_import=after)
    assert calls == [("stream-0", 2)] * 2 and _new_rows(spark, led) == ["R1", "R1"]
    assert len(_log(spark, led)) == 1


def test_batches_follow_name_order(spark):
    inbox, archive, led, ckpt = _inbox(spark)
    for n in "cab":
        _inbox_file(inbox, f"{n}.csv", HEAD + f"02/01/2030;COMPRA RED RING;10,00;;{n}\n")
    import_stream(spark, inbox, led, rules(spark, SF_SMALL), ckpt, ledger_id="1", max_files=1)
    assert [x[:2] for x in _log(spark, led)] == [(f"{n}.csv", f"stream-{i}") for i, n in enumerate("abc")]
    assert _new_rows(spark, led) == ["a"]       # one key: the first file by name has it
