"""WARC: round trips with magic and whole records inside payloads, small splits, revisits and edge rows."""

import hashlib
import random

import pytest

from ledgerline.llm import warc as A


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) by the definition."""
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = max(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ref = first.get(html or "") if len(raw) >= 1000 else i
        again = ref is not None and ref != i
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", ref if again else None))
    return sorted(out, key=repr)


def record(i, payload):
    body = f"HTTP/1.1 200 OK\r\n\r\n{payload}"
    return (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body.encode())}\r\n\r\n"
            f"{body}\r\n\r\n")


def hostile_rows():
    rnd = random.Random(5)
    long = "é" * 700
    rows = [(1, "http://a/", None), (2, None, ""), (3, "http://a/\r\nX: y", "x\r\n\r\n"), (4, "u", "WARC/1.1\r\n"), (5, "u", "WARC/1.1\r\n" * 3 + "end"),
            (6, "u", record(77, "inner") + "tail"), (7, "u", record(78, record(79, "twice"))), (8, "u", "a" + record(80, "x")[:-2]),
            (9, "u", long), (12, "u", long), (10, "u", long), (None, "u", long), (11, "u", "é" * 400), (13, "u", "é" * 400),
            (14, "u", "WARC/1.1\r\nContent-Length: 99999999\r\n\r\nfar"), (15, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
            (16, "u", "z" * 30_000 + record(81, "deep") * 40), (17, "u", "q" * 1000), (17, "u", "q" * 1000), (18, "u", "WARC/1.1\r")]
    rows += [(100 + i, "u", "".join(rnd.choice(["WARC/1.1\r\n", "ab", record(500 + i, "f"), "\r\n\r\n"]) for _ in range(rnd.randrange(9))))
             for i in range(60)]
    return rows


@pytest.fixture()
def split_bytes(spark, request):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("split_bytes", ["128m", "5000"], indirect=True)
def test_round_trip(spark, tmp_path, split_bytes):
    rows = hostile_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").coalesce(2)
    path = str(tmp_path / "arc")
    A.write_archives(df, path)
    records = A.read_archives(spark, path, payload=True)
    assert sorted((tuple(r) for r in A.page_records(A.read_archives(spark, path)).collect()), key=repr) == brute(rows)
    got = sorted((tuple(r) for r in A.page_records(records).collect()), key=repr)
    assert got == brute(rows)
    held = {r["record_id"]: r["payload"] for r in records.where("type = 'response'").collect()}
    assert bytes(held["<urn:page:7>"]).decode() == rows[6][2]
    assert sum(1 for r in records.collect() if r["offset"] == 0) == 2          # the first record of each file
    assert all(hashlib.sha1(r["payload"]).hexdigest() == r["payload_sha1"] for r in records.collect())
    uri = next(r["uri"] for r in records.collect() if r["record_id"] == "<urn:page:3>")
    assert uri == "http://a/%0D%0AX: y"


def test_foreign_files(spark, tmp_path):
    good = record(1, "one").encode() + record(2, "two").encode()
    binary = b"\xff\x00WARC/1.1\r\n\xfe"
    head = f"WARC/1.1\r\nContent-Length: {len(binary)}\r\nWARC-Type: resource\r\n\r\n".encode()
    (tmp_path / "a.warc").write_bytes(good + head + binary + b"\r\n\r\n")
    (tmp_path / "junk.warc").write_bytes(b"junk " + good)
    (tmp_path / "cut.warc").write_bytes(good[:-9])
    (tmp_path / "empty.warc").write_bytes(b"")
    out = A.read_archives(spark, str(tmp_path), payload=True).collect()
    by = sorted((r["file"].rsplit("/", 1)[1], r["offset"], r["type"], bytes(r["payload"])) for r in out)
    assert [(f, t, p) for f, _, t, p in by] == [
        ("a.warc", "response", b"one"), ("a.warc", "response", b"two"), ("a.warc", "resource", binary), ("cut.warc", "response", b"one")]


def test_versions_mixed(spark, tmp_path):
    inner = record(8, "inside").replace("WARC/1.1", "WARC/1.0")
    old = record(1, "one").replace("WARC/1.1", "WARC/1.0")
    texts = {"old.warc": old + record(2, "").replace("WARC/1.1", "WARC/1.0"),
             "mixed.warc": record(3, f"a {inner} b WARC/1.1\r\n WARC/1.x") + old + record(4, "WARC/1."),
             "next.warc": old.replace("WARC/1.0", "WARC/1.2"), "junk.warc": "junk " + old, "cut.warc": (old + record(5, "five"))[:-9]}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    (tmp_path / "empty.warc").write_text("")
    records = A.read_archives(spark, str(tmp_path), payload=True)
    got = sorted((r["file"].rsplit("/", 1)[1], bytes(r["payload"]).decode()) for r in records.collect())
    assert got == sorted([("old.warc", "one"), ("old.warc", ""), ("mixed.warc", f"a {inner} b WARC/1.1\r\n WARC/1.x"), ("mixed.warc", "one"),
                          ("mixed.warc", "WARC/1."), ("cut.warc", "one")])
    left = {r["file"].rsplit("/", 1)[1]: r["last_offset"] for r in A.unverified_files(spark, str(tmp_path), records).collect()}
    assert left == {"next.warc": None, "junk.warc": None, "cut.warc": 0}


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    A.write_archives(df, str(tmp_path / "none"))
    assert A.page_records(A.read_archives(spark, str(tmp_path / "none"))).count() == 0
