"""Bank statements of unknown layout (S1, P1, P2) and the fixture writer for them.

Statements are read by the text source, so a big file is split over many tasks.  Line numbers are a running
count per split plus the lines of the splits before it; every per-file decision (encoding, separator, header
line, column mapping) is a small aggregate joined back by path.  A quoted field may hold separators and line
breaks.  Every non-blank line after a file's header ends as a movement, a balance line or a reject.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.constants import COLUMN_ALIASES, HEADER_KEYWORDS, STATEMENT_SEPARATORS
from ledgerline.functions.dates import parse_date
from ledgerline.functions.numbers import parse_bank_amount
from ledgerline.functions.predicates import is_balance_line
from ledgerline.functions.text import norm_header, strip
from ledgerline.session import materialize

FIELDS = tuple(COLUMN_ALIASES)          # date, concept, debit, credit, balance, reference

UNMAPPED, BAD_DATE, BAD_AMOUNT = "no date or amount column", "unreadable date", "unreadable amount"


def _field_pattern(sep: str) -> str:
    """One field with the separator before it: quoted (doubled quotes inside) or up to the next separator."""
    return rf'\{sep}("[^"]*+(?:""[^"]*+)*+"|[^\{sep}]*+)' if sep != "\t" else '\t("[^"]*+(?:""[^"]*+)*+"|[^\t]*+)'


def _fields(line, sep_idx):
    """The fields of a line under its file's separator; a quoted field loses its quotes and
    doubled quotes inside become one."""
    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), sep_idx + 1)

    def unquote(x):
        quoted = x.startswith('"') & x.endswith('"') & (F.length(x) >= 2)
        return F.when(quoted, F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x)
    found = F.regexp_extract_all(F.concat(pick(STATEMENT_SEPARATORS), line), pick(map(_field_pattern, STATEMENT_SEPARATORS)), F.lit(1))
    # a line without quotes is what lies between its separators: no pattern needed
    plain = F.split(line, pick([s if s == "\t" else rf"\{s}" for s in STATEMENT_SEPARATORS]), -1)
    return F.when(line.contains('"'), F.transform(found, unquote)).otherwise(plain)


def _field_count(line, i):
    """The number of fields of a line under separator ``i``."""
    sep = STATEMENT_SEPARATORS[i]
    plain = F.length(line) - F.length(F.replace(line, F.lit(sep), F.lit(""))) + 1
    return F.when(line.contains('"') & line.contains(sep), F.size(_fields(line, F.lit(i)))).otherwise(plain)


def source_lines(text: DataFrame) -> DataFrame:
    """What the reader needs of a text source (batch or stream): path, block and size of the split's file, line."""
    extra = [c for c in text.columns if c not in ("value", "path", "block")]
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), *extra, "value")


def _numbered(lines: DataFrame, extra: list[str]) -> DataFrame:
    """path, extra, line_no, line of the logical lines: decoded per file, quoted line breaks joined."""
    seq = materialize(lines.withColumn("seq", F.monotonically_increasing_id())
                      .withColumn("quotes", F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))))
    own = W.partitionBy("path", "block").orderBy("seq")
    splits = seq.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("quotes").alias("q"),
                                              F.min(F.is_valid_utf8("value")).alias("utf8"))
    before, file = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("path")
    splits = splits.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
                           F.coalesce(F.sum("q").over(before), F.lit(0)).alias("q0"),
                           F.min("utf8").over(file).alias("utf8"), (F.sum("q").over(file) % 2 == 0).alias("balanced"))
    line = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    quotes_before = F.col("q0") + F.coalesce(F.sum("quotes").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = seq.join(splits, ["path", "block"]).select(
        "path", "block", *extra, "seq", (F.col("n0") + F.row_number().over(own) - 1).cast("int").alias("line_no"), line.alias("line"),
        # an odd number of quotes in a file is no quoting: its lines stand alone
        (~F.col("balanced") | (quotes_before % 2 == 0)).alias("starts"))
    rows = materialize(rows)
    if rows.where("not starts").isEmpty():
        return rows.select("path", *extra, "line_no", "line")
    first = F.when(F.col("starts"), F.col("line_no"))
    carried = rows.groupBy("path", "block").agg(F.max(first).alias("top")).select(
        "path", "block", F.last("top", ignorenulls=True).over(before).alias("carry"))
    record = F.coalesce(F.last(first, ignorenulls=True).over(own), "carry")
    # only records of several lines are grouped: the starts that continuations point to, and those
    rest = rows.join(carried, ["path", "block"]).withColumn("record", record).where("not starts")
    heads = rest.select("path", F.col("record").alias("line_no")).distinct()
    several = (rest.select("path", "record", "line_no", "line")
               .unionByName(rows.join(heads, ["path", "line_no"], "left_semi").select("path", F.col("line_no").alias("record"), "line_no", "line"))
               .groupBy("path", F.col("record").alias("line_no"))
               .agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("whole")))
    joined = rows.where("starts").join(several, ["path", "line_no"], "left")
    return joined.select("path", *extra, "line_no", F.coalesce("whole", "line").alias("line"))


def _alias_table(spark: SparkSession) -> DataFrame:
    rows = [(field, k, a) for field, aliases in COLUMN_ALIASES.items() for k, a in enumerate(aliases)]
    return spark.createDataFrame(rows, "field string, alias_ord int, alias string").select(
        "field", "alias_ord", norm_header("alias").alias("norm"))


def read_statements(spark: SparkSession, path: str, glob: str | None = None, with_mapping: bool = False,
                    signed: bool = False):
    """S1 over a folder: see ``parse_statement_lines``."""
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return parse_statement_lines(spark, source_lines(reader.text(path)), with_mapping, signed)


def parse_statement_lines(spark: SparkSession, source: DataFrame, with_mapping: bool = False, signed: bool = False):
    """Statement files, as ``source_lines`` gives them → (rows, rejects).

    rows: path (+ partition columns), line_no, date, concept, debit, credit, balance, reference.
    rejects: path (+ partition columns), line_no, raw, reason — a line whose date or amount cannot be read, and
    every line of a file without a date or an amount column.
    """
    out, mapping = statement_outcomes(spark, source, signed)
    keys = [c for c in out.columns if c not in (*FIELDS, "line_no", "outcome", "raw", "reason")]
    rows = out.where("outcome = 'row'").select(*keys, "line_no", *FIELDS)
    rejects = out.where("outcome = 'reject'").select(*keys, "line_no", "raw", "reason")
    return (rows, rejects, mapping) if with_mapping else (rows, rejects)


def statement_outcomes(spark: SparkSession, source: DataFrame, signed: bool = False):
    """Every non-blank line after its file's header as one row: path (+ partition columns), line_no, the typed
    FIELDS, outcome (row, balance or reject), raw and reason; and the column mapping per file.

    Separator: of , ; TAB |, the one whose most common field count (> 2) holds on the most lines; ties in list
    order.  Header: the first line mentioning a header keyword (else the first line).  Columns: P2 alias mapping.
    Lines whose fields are all blank are blank.
    """
    extra = [c for c in source.columns if c not in ("path", "block", "value")]
    lines = materialize(_numbered(source, extra).where(strip("line") != ""))

    per_sep = lines.select("path", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _field_count(F.col("line"), i).alias("n")) for i in range(len(STATEMENT_SEPARATORS))])).alias("s"))
    score = (per_sep.where(F.col("s.n") > 2).groupBy("path", "s.i", "s.n").agg(F.count(F.lit(1)).alias("lines"))
                    .groupBy("path", "i").agg(F.max("lines").alias("score")))
    per_file = score.groupBy("path").agg(
        F.max_by("i", F.struct(F.col("score"), -F.col("i"))).alias("sep_idx"))

    parsed = lines.join(per_file, "path", "left").withColumn(
        "fields", F.when(F.col("sep_idx").isNull(), F.array("line")).otherwise(_fields(F.col("line"), F.col("sep_idx"))))
    joined = F.lower(F.array_join(F.col("fields"), " "))
    has_kw = F.lit(False)
    for k in HEADER_KEYWORDS:
        has_kw = has_kw | joined.contains(k)
    header_line = parsed.groupBy("path").agg(
        F.coalesce(F.min(F.when(has_kw, F.col("line_no"))), F.min("line_no")).alias("header_line"))
    parsed = parsed.join(header_line, "path")

    heads = (parsed.where(F.col("line_no") == F.col("header_line"))
             .select("path", F.posexplode("fields").alias("pos", "name")).where(F.col("name").isNotNull())
             .select("path", "pos", norm_header("name").alias("norm"))
             .groupBy("path", "norm").agg(F.max("pos").alias("pos")))        # equal normal forms: later wins
    mapping = (heads.join(F.broadcast(_alias_table(spark)), "norm")
               .groupBy("path", "field").agg(F.min_by("pos", "alias_ord").alias("pos"))
               .groupBy("path").pivot("field", list(FIELDS)).agg(F.first("pos")))
    mapping = materialize(mapping)
    usable = F.col("date").isNotNull() & (F.col("debit").isNotNull() | F.col("credit").isNotNull())

    blank = F.size(F.filter("fields", lambda x: strip(F.coalesce(x, F.lit(""))) != "")) == 0
    places = mapping.select("path", usable.alias("_usable"), *[F.col(f).alias(f"_{f}") for f in FIELDS])
    data = parsed.where(~blank).join(places, "path", "left").withColumn("_usable", F.coalesce("_usable", F.lit(False)))
    # in a file without a usable mapping no line is known to be a header: all of them are rejects
    data = data.where((F.col("line_no") > F.col("header_line")) | ~F.col("_usable"))

    def field(f):
        return F.when(F.col(f"_{f}").isNotNull(), F.try_element_at("fields", F.col(f"_{f}") + 1))

    typed = data.select(
        "path", *extra, "line_no", "_usable",
        parse_date(field("date")).alias("date"),
        F.coalesce(field("concept"), F.lit("")).alias("concept"),
        *[parse_bank_amount(field(f), signed).alias(f) for f in ("debit", "credit", "balance")],
        F.coalesce(field("reference"), F.lit("")).alias("reference"), F.col("line").alias("raw"))
    unreadable = F.col("debit").isNull() | F.col("credit").isNull() | F.col("balance").isNull()
    balance = F.col("_usable") & is_balance_line("concept")
    reason = (F.when(~F.col("_usable"), UNMAPPED).when(balance, F.lit(None))
               .when(F.col("date").isNull(), BAD_DATE).when(unreadable, BAD_AMOUNT))
    outcome = F.when(balance, "balance").when(F.col("reason").isNotNull(), "reject").otherwise("row")
    return typed.withColumn("reason", reason).withColumn("outcome", outcome).drop("_usable"), mapping


# ---- fixture writer: incoming rows → raw statement files --------------------------------------

LATIN1_LAYOUT = 3

# header spellings per layout (fixed test layouts: aliases of COLUMN_ALIASES in other spellings)
_HEADERS = (
    ("Fecha", "Concepto", "Débito", "Crédito", "Saldo", "Referencia"),
    ("FECHA", "Descripción", "Cargo", "Abono", "Saldo final", "Ref"),
    ("date", "detalle", "monto débito", "monto crédito", "balance", "nro operacion"),
    ("Fecha", "Descripción", "Egreso", "Ingreso", "Saldo", "Operación"),
)


def write_statement_files(rows: DataFrame, path: str) -> str:
    """Write incoming rows (ledger_id, file_no, row_id, copy_no, date, concept, debit, credit,
    bank_balance, reference) as one text statement per (ledger, file), laid out by ``layout = (ledger + file)
    mod 4``: separator , ; TAB |, header spelling (layout 3 in ISO-8859-1), columns rotated by the layout,
    day-first, serial-number, two-digit-year or timed dates, a title line, an account line with fewer fields and a
    'SALDO ANTERIOR' line before the movements, and after them a line without a readable date and one
    without a readable amount.  References of rows of line number 5 are
    quoted and end in a line break and the layout's separator (not in layout 3).  Written partitioned by ledger_id / file_no, each statement sorted by line number."""
    layout = ((F.col("ledger_id").cast("int") + F.col("file_no")) % 4).cast("int")
    sep = F.element_at(F.array(*[F.lit(s) for s in STATEMENT_SEPARATORS]), layout + 1)
    serial = F.datediff(F.col("date"), F.lit("1899-12-30").cast("date")).cast("string")
    date_txt = (F.when(layout == 0, F.date_format("date", "d/M/yyyy")).when(layout == 1, serial)
                 .when(layout == 2, F.date_format("date", "dd/MM/yy")).otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss")))

    def quoted(c):
        return F.concat(F.lit('"'), c, F.lit('"'))

    def money(c):
        txt = F.coalesce(F.col(c).cast("string"), F.lit(""))
        # layout 0 (comma separator) writes decimal commas inside quotes
        return F.when(layout == 0, quoted(F.regexp_replace(txt, r"\.", ","))).otherwise(txt)

    def line(*cells):
        cells = F.array(*cells)
        n = len(FIELDS)
        return F.call_function("array_join", F.concat(F.slice(cells, layout + 1, n - layout), F.slice(cells, F.lit(1), layout)), sep)

    broken = (F.substring("row_id", 14, 2) == "05") & (layout != LATIN1_LAYOUT)
    reference = F.when(broken, quoted(F.concat("reference", F.lit("\n"), sep))).otherwise(F.col("reference"))
    body = rows.select(
        "ledger_id", "file_no",
        F.lit(1).alias("line_no"),          # movements follow the lead lines; their order is free
        line(date_txt, F.col("concept"), money("debit"), money("credit"), money("bank_balance"), reference).alias("value"))
    files = rows.groupBy("ledger_id", "file_no").agg(F.min("date").alias("_d"))
    names = F.split(F.element_at(F.array(*[F.lit("\u0001".join(h)) for h in _HEADERS]), layout + 1), "\u0001")
    empty, day = F.lit(""), F.date_format("_d", "d/M/yyyy")
    around = files.select("ledger_id", "file_no", F.explode(F.array(*[
        F.struct(F.lit(no).alias("line_no"), value.alias("value")) for no, value in (
            (-3, F.lit("Estado de cuenta")),
            (-2, F.concat(F.lit("Cuenta"), sep, F.col("ledger_id"))),
            (-1, line(*[names[i] for i in range(len(FIELDS))])),
            (0, line(day, F.lit("SALDO ANTERIOR"), empty, empty, F.lit('"1.000,00"'), empty)),
            (2, line(F.lit("31/31/2001"), F.lit("COMPRA SIN FECHA"), F.lit("1"), empty, empty, empty)),
            (3, line(day, F.lit("COMPRA SIN MONTO"), F.lit('"1.000,00"'), empty, empty, empty)))])).alias("l"))
    lines = (around.select("ledger_id", "file_no", "l.line_no", "l.value").unionByName(body)
             .withColumn("_latin1", layout == LATIN1_LAYOUT)
             .repartition("ledger_id", "file_no").sortWithinPartitions("ledger_id", "file_no", "line_no")
             .drop("line_no"))
    # one layout is written in ISO-8859-1 (its header has accents): the CSV writer with one column, no quoting and
    # an unused delimiter writes each line as is; the others are plain text
    lines.where(~F.col("_latin1")).drop("_latin1").write.mode("append").partitionBy("ledger_id", "file_no").text(path)
    (lines.where("_latin1").drop("_latin1")
          .write.mode("append").partitionBy("ledger_id", "file_no")
          .option("sep", "\u0001").option("quote", "\u0000").option("escape", "\u0000")
          .option("encoding", "ISO-8859-1").option("emptyValue", "").csv(path))
    return path
