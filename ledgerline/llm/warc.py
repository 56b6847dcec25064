"""WARC archives: writing, and reading by boundary-chain verification.

Archives are plain WARC files; 1.1 is written, 1.0 and 1.1 are read, also mixed in one file.  They are read by Spark's text
source cut at the record magic up to its minor version, so one file is read by many tasks; a cut says nothing about truth,
since the magic may stand inside a payload.  Every cut that is followed by a version and a readable header is a candidate record with a byte offset and the offset
of its successor (header + Content-Length + two line ends).  Byte offsets come from the lengths of the pieces:
a running sum per split, plus the sum of the splits before it.

Verification: within a split, candidates whose successor is the very next candidate are one run; a run is
cut wherever some other candidate points into it.  The heads of the runs and their exits are the links of
the chain, and pointer jumping from offset 0 of each file (each round doubles the distance) marks the heads that
are reachable.  Candidates of other runs are text inside payloads.  So the number of rounds follows
the number of splits and of false candidates, not of records.

Pieces inside a verified record are joined to it again, so a payload that holds magic, or whole records, comes
back as it was.  What is kept of the pieces is narrow: lengths, header fields, the digest of the piece and, for a
record that is one piece, length and digest of its payload.  That table is written once in the shared folder and
all rounds read it; a lost executor repeats single tasks.  Text is read a second time only for what needs it:
records of several pieces, and payloads if they are asked for; it is found by the digest of the piece.

Records: response (or the type of a foreign record) with an HTTP head and the payload; of records with equal
payloads of at least ``REVISIT_BYTES`` bytes the largest page_id is the response, and the others are revisit
records that name it and hold no payload.

Defined cases: a null html is an empty payload; a null url or page_id gives an empty field and reads back as
null; line ends in a url are percent-encoded; rows that share the largest page_id of their payload are all
responses; a null page_id is never the one that stays unless all are null, in which case all are responses;
an empty table gives an empty archive; a file that does not begin with a record has no verified record
(``unverified_files`` names such files and those whose chain breaks off); a record cut off by the end of its file is left out (its successor lies past the end).  Only the id, url and html
columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.session import materialize

CUT = "WARC/1."
MAGIC = f"{CUT}1\r\n"
END = "\r\n\r\n"
REVISIT_BYTES = 1000
DATE = "2026-01-01T00:00:00Z"


def _plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, payload) with ``refers_to`` where an equal payload stands elsewhere."""
    key = F.unhex(F.sha2(F.col("payload").cast("binary"), 256))
    keyed = pages.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", key.alias("key"))
    groups = keyed.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    shared = materialize(groups.where("n > 1 and refers_to is not null").select("key", "refers_to"))
    again = keyed.join(shared, "key").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()
    again = materialize(again).select(F.col("page_id").alias("r_page"), F.col("key").alias("r_key"), "refers_to")
    same = F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("key") == F.col("r_key"))
    return pages.withColumn("key", key).join(again, same, "left").select("page_id", "url", "payload", "refers_to")


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit("\r\n"))


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One WARC file per task under ``path``."""
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                      F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = _plan_records(pages)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    again = F.col("refers_to").isNotNull()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}"
    body = F.concat(F.lit(http), F.when(again, F.lit("")).otherwise(F.col("payload")))
    header = F.concat(
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", name(F.col("page_id"))), _line("WARC-Target-URI", url), _line("WARC-Date", DATE),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("payload").cast("binary")))),
        F.when(again, F.concat(_line("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                               _line("WARC-Refers-To", name(F.col("refers_to"))))).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"))
    record = F.concat(F.lit(MAGIC), header, _line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """The text between magics, in order within each split."""
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("file_size"), F.monotonically_increasing_id().alias("seq"), F.col("value").alias("text"))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha1(text.cast("binary")))


def _payload(body: Column) -> Column:
    """What follows the HTTP head of a record body, if it has one."""
    http = F.octet_length(F.substring_index(body.cast("string"), END, 1)) + len(END)
    has_http = F.substring(body, 1, 5) == F.lit("HTTP/").cast("binary")
    return F.when(has_http, F.substring(body, http + 1, F.octet_length(body))).otherwise(body)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Lengths, digests and header fields of the pieces; ``payload_bytes`` and ``payload_sha1`` where the piece is a
    whole record."""
    versioned = F.substring("text", 1, 3).isin("0\r\n", "1\r\n")
    head = F.when(versioned & F.contains("text", F.lit(END)), F.substring_index("text", END, 1))
    rows = _scan(spark, path).withColumn("head", head).withColumn("content_length", F.expr(
        r"try_cast(nullif(regexp_extract(head, '(?im)^Content-Length:[ \t]*([0-9]+)[ \t]*\r?$', 1), '') as bigint)"))
    raw = F.col("text").cast("binary")
    rows = rows.withColumn("bytes", F.octet_length("text").cast("long")).withColumn("head_bytes", F.octet_length("head").cast("long"))
    whole = F.col("bytes") == F.col("head_bytes") + F.col("content_length") + 2 * len(END)
    body = F.substring(raw, (F.col("head_bytes") + len(END) + 1).cast("int"), F.col("content_length").cast("int"))
    payload = _payload(F.when(whole, body))
    return materialize(rows.select(
        "file", "block", "file_size", "seq", "bytes", "head_bytes", "content_length", _sha(F.col("text")).alias("sha"),
        F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("payload_sha1"),
        _field("WARC-Type").alias("type"), _field("WARC-Record-ID").alias("record_id"), _field("WARC-Target-URI").alias("uri"),
        _field("WARC-Payload-Digest").alias("digest"), _field("WARC-Refers-To").alias("refers_to")))


def _raw(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(sha, raw) of the pieces whose digests are in ``wanted``, from a second scan."""
    wanted = materialize(wanted.select("sha").distinct())
    rows = _scan(spark, path).select(_sha(F.col("text")).alias("sha"), F.col("text").cast("binary").alias("raw"))
    return rows.join(wanted, "sha", "left_semi").groupBy("sha").agg(F.first("raw").alias("raw"))


def _with_offsets(pieces: DataFrame) -> DataFrame:
    """The offset of the magic before each piece (negative for what stands before the first) and, for
    candidates, the offset of the successor."""
    step = len(CUT)
    own = W.partitionBy("file", "block").orderBy("seq")
    local = pieces.withColumn("before", F.sum(F.col("bytes") + step).over(own.rowsBetween(W.unboundedPreceding, -1)))
    splits = pieces.groupBy("file", "block").agg(F.sum(F.col("bytes") + step).alias("size"))
    base = splits.select("file", "block", F.coalesce(F.sum("size").over(
        W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    offset = F.col("base") + F.coalesce("before", F.lit(0)) - step
    out = local.join(base, ["file", "block"]).withColumn("offset", offset)
    after = F.col("offset") + step + F.col("head_bytes") + len(END) + F.col("content_length") + len(END)
    return out.withColumn("next", F.when((F.col("offset") >= 0) & (after <= F.col("file_size")), after))


def _reachable(heads: DataFrame) -> DataFrame:
    """(file, head) of the heads that the chain from offset 0 reaches; ``heads`` has (file, head, exit)."""
    now = materialize(heads.select("file", "head", F.col("exit").alias("jump"), (F.col("head") == 0).alias("reached")))
    count = now.where("reached").count()
    while count:
        landed = now.where("reached and jump is not null").select("file", F.col("jump").alias("head"), F.lit(True).alias("hit")).distinct()
        ahead = now.select("file", F.col("head").alias("jump"), F.col("jump").alias("jump2"))
        nxt = (now.join(landed, ["file", "head"], "left").join(ahead, ["file", "jump"], "left")
               .select("file", "head", F.col("jump2").alias("jump"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")))
        now = materialize(nxt)
        more = now.where("reached").count()
        if more == count:
            break
        count = more
    return now.where("reached").select("file", "head")


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """One row per verified record of the archives under ``path``: ``file``, ``offset``, ``type``, ``record_id``,
    ``uri``, ``digest`` and ``refers_to`` as in the header, ``payload_bytes`` and ``payload_sha1`` of what it holds (without
    the HTTP head) and, if asked for, the ``payload`` itself (binary)."""
    pieces = _pieces(spark, path)
    at = materialize(_with_offsets(pieces.select("file", "block", "file_size", "seq", "bytes", "head_bytes", "content_length")))
    own = W.partitionBy("file", "block").orderBy("seq")
    cands = at.where("next is not null").withColumn("chained", F.lead("offset").over(own).eqNullSafe(F.col("next")))
    cands = cands.withColumn("starts", ~F.coalesce(F.lag("chained").over(own), F.lit(False)))
    targets = cands.where(~F.col("chained")).select("file", F.col("next").alias("offset"), F.lit(True).alias("aimed")).distinct()
    runs = cands.join(targets, ["file", "offset"], "left").withColumn(
        "head", F.last(F.when(F.col("starts") | F.col("aimed"), F.col("offset")), ignorenulls=True).over(own))
    runs = materialize(runs.select("file", "block", "seq", "offset", "next", "head"))
    heads = runs.groupBy("file", "head").agg(F.max("next").alias("exit"))
    true = runs.join(_reachable(heads), ["file", "head"], "left_semi").select("file", "block", "seq", "offset")
    records = materialize(true.join(pieces.drop("file_size", "bytes"), ["file", "block", "seq"]))
    fields = ["file", "offset", "type", "record_id", "uri", "digest", "refers_to"]
    single, several = records.where("payload_bytes is not null"), records.where("payload_bytes is null")
    out = single
    if payload:
        raw = single.join(_raw(spark, path, single), "sha")
        body = F.substring(F.col("raw"), (F.col("head_bytes") + len(END) + 1).cast("int"), F.col("content_length").cast("int"))
        out = raw.withColumn("payload", _payload(body))
    facts = ["payload_bytes", "payload_sha1", *["payload"] * payload]
    out = out.select(*fields, *facts)
    if several.isEmpty():
        return out
    # the pieces after a record's own first piece belong to the last verified record before them
    marks = at.join(records.select("file", "offset", F.lit(True).alias("verified")), ["file", "offset"], "left")
    last = marks.groupBy("file", "block").agg(F.max(F.when(F.col("verified"), F.col("offset"))).alias("last"))
    carry = last.select("file", "block", F.last("last", ignorenulls=True).over(
        W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)).alias("carry"))
    owner = F.coalesce(F.last(F.when(F.col("verified"), F.col("offset")), ignorenulls=True).over(own), "carry")
    owned = marks.join(carry, ["file", "block"]).select("file", "block", "seq", F.col("offset").alias("at"), owner.alias("offset"))
    parts = owned.join(several.select("file", "offset"), ["file", "offset"], "left_semi").join(
        pieces.select("file", "block", "seq", "sha"), ["file", "block", "seq"])
    parts = materialize(parts.select("file", "offset", "at", "sha"))
    joined = (parts.join(_raw(spark, path, parts), "sha").groupBy("file", "offset")
              .agg(F.array_sort(F.collect_list(F.struct("at", "raw"))).alias("parts")))
    text = F.expr("aggregate(parts, cast('' as binary), (b, p) -> if(length(b) = 0, p.raw, "
                  f"concat(b, cast('{CUT}' as binary), p.raw)))")
    body = F.substring(F.col("text"), (F.col("head_bytes") + len(END) + 1).cast("int"), F.col("content_length").cast("int"))
    mended = several.drop("payload_bytes", "payload_sha1").join(joined.withColumn("text", text).drop("parts"), ["file", "offset"])
    mended = mended.withColumn("payload", _payload(body)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    return out.unionByName(mended.withColumn("payload_sha1", F.sha1("payload")).select(*fields, *facts))


def unverified_files(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """The files under ``path`` that ``records`` (of ``read_archives``) does not account for to their end: ``file``,
    ``file_size`` and ``last_offset``, that of the last verified record (null: none).  Empty files have nothing to verify."""
    at = _with_offsets(_pieces(spark, path)).select("file", "offset", "next", "file_size")
    ends = records.select("file", "offset").join(at.drop("file_size"), ["file", "offset"]).groupBy("file").agg(
        F.max("offset").alias("last_offset"), F.max("next").alias("end"))
    sizes = at.groupBy("file").agg(F.max("file_size").alias("file_size"))
    return sizes.join(ends, "file", "left").where("end is null or end < file_size").select("file", "file_size", "last_offset")


def page_of(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(-?[0-9]+)>$", 1), F.lit("")).cast("long")


def page_records(records: DataFrame) -> DataFrame:
    """Of records as ``write_archives`` writes them: ``page_id``, ``payload_bytes`` and ``payload_digest`` of the full
    payload, ``record_type`` and ``refers_to``.  A revisit finds its payload by the record it refers to."""
    rows = materialize(records.select(
        page_of(F.col("record_id")).alias("page_id"), F.col("type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"),
        F.regexp_replace("digest", "^sha1:", "").alias("named"), "payload_bytes", F.col("payload_sha1").alias("payload_digest")))
    own = rows.where("record_type <> 'revisit'")
    named = own.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("named"), "payload_bytes", "payload_digest").distinct()
    again = rows.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(named, ["refers_to", "named"])
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(*cols).unionByName(again.select(*cols))
