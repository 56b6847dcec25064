"""Adapter: the driver's TPC-H-like tables → ledger inputs (FIXTURES.md §3).

``movements`` is the canonical ledger table: one ledger per supplier nation.
Everything else here (rules, recode map, legacy labels, incoming statement files)
is *derived* from the same tables by fixed rules, so every query's work grows with
the data.  Joins carry no broadcast hints: Spark broadcasts a side only when its
estimated size is under ``spark.sql.autoBroadcastJoinThreshold`` and AQE re-plans
on the real shuffle sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# cut-offs of the derived inputs (FIXTURES §3)
LEDGER_BEFORE = "2001-01-01"      # existing ledger: rows before this date
INCOMING_FROM = "2000-07-01"      # incoming statements: rows from this date (overlap is re-imported)
CUTOVER_YEAR = 1999               # legacy labels are rebuilt / reclassified from this year on
FIRST_YEAR = 1995                 # first year of the data (the reader's min_year)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Fixture only: the driver's test file is a single row group, so one split however many cores there are;
    its rows are dealt round-robin to at least one partition per core.  Inputs with enough splits (any large
    table) are read as they are."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def _lpad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter rows with the helper columns other derived inputs need."""
    l = spread(_read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"))
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    s = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey)
    word2 = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    price = (F.col("l_extendedprice").cast(MONEY)
             * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))).cast(MONEY)
    ship = F.col("l_shipdate").cast("date")
    return j.select(
        F.col("s_nationkey").cast("string").alias("ledger_id"),
        F.when(F.col("l_linestatus") == "F", "Caja de Ahorro").otherwise("Tarjeta de crédito").alias("origin"),
        F.when(F.col("l_returnflag") == "A", "Gastos").when(F.col("l_returnflag") == "R", "Ingresos")
         .otherwise("").alias("kind"),
        F.when(F.col("p_type") == "ECONOMY", "Supermercado").when(F.col("p_type") == "SMALL", "Servicios")
         .when(F.col("p_type") == "MEDIUM", "Salud").when(F.col("p_type") == "PROMO", "Otros ingresos")
         .when(F.col("p_type") == "STANDARD", "No va").otherwise("").alias("category"),
        F.when(word2.isin("ring", "bolt"), "").otherwise(word2).alias("subcategory"),
        ship.alias("date"),
        F.concat(F.lit("COMPRA "), F.upper("p_name"), F.lit("  "), F.col("p_partkey").cast("string"),
                 F.lit(" "), F.col("p_brand")).alias("concept"),
        F.when(F.col("l_returnflag") != "R", price).alias("debit"),
        F.when(F.col("l_returnflag") == "R", price).alias("credit"),
        F.when((F.col("l_linenumber") == 1) & (F.month(ship) % 3 != 0),
               F.col("l_extendedprice").cast(MONEY)).alias("bank_balance"),
        F.concat(_lpad(F.col("l_orderkey"), 12), F.lit("-"), _lpad(F.col("l_linenumber"), 2), F.lit("-"),
                 _lpad(F.col("l_partkey"), 12), F.lit("-"), _lpad(F.col("l_suppkey"), 12)).alias("row_id"),
        F.col("l_quantity").alias("_quantity"),
        F.col("l_linenumber").alias("_linenumber"),
        F.col("p_type").alias("_ptype"),
        F.col("p_name").alias("_pname"),
        F.col("l_linestatus").alias("_linestatus"),
    )


MOVEMENT_COLUMNS = ("ledger_id", "row_id", "batch_id", "kind", "origin", "category", "subcategory", "date",
                    "concept", "debit", "credit", "bank_balance", "reference", "destination", "review")


def with_canonical(df: DataFrame) -> DataFrame:
    return (df.withColumn("batch_id", F.year("date").cast("string"))
              .withColumn("reference", F.lit(""))
              .withColumn("destination", F.lit(""))
              .withColumn("review", F.col("category") == ""))


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §1.2 canonical ledger table built from lineitem ⋈ part ⋈ supplier."""
    return with_canonical(base_rows(spark, sf_dir)).select(*MOVEMENT_COLUMNS)


def opening_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening balance per ledger: the summed supplier account balances of the nation."""
    s = _read(spark, sf_dir, "supplier")
    return (s.groupBy(F.col("s_nationkey").cast("string").alias("ledger_id"))
             .agg(F.sum(F.col("s_acctbal").cast(MONEY)).cast(MONEY).alias("opening")))


def existing_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements(spark, sf_dir).where(F.col("date") < F.lit(LEDGER_BEFORE).cast("date"))


def incoming_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming statement rows with in-file duplicates: a second copy of rows with quantity 1;
    file number = line number mod 3."""
    b = base_rows(spark, sf_dir).where(F.col("date") >= F.lit(INCOMING_FROM).cast("date"))
    # one pass: rows of quantity 1 explode into two copies
    copies = F.when(F.col("_quantity") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (b.withColumn("copy_no", F.explode(copies))
                 .withColumn("file_no", (F.col("_linenumber") % 3).cast("int"))
                 .select("ledger_id", "row_id", "copy_no", "file_no", "date", "concept", "debit", "credit",
                         "bank_balance", F.concat(F.lit("OP "), "row_id").alias("reference")))


def legacy_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §1.3: ``p_type`` itself is the old label; some rows carry no label; every row of
    line number 7 is an opening / closing marker row."""
    b = base_rows(spark, sf_dir)
    label = F.when((F.col("_ptype") == "LARGE") & (F.col("_linestatus") == "O"), F.lit("")).otherwise(F.col("_ptype"))
    kind = (F.when((F.col("_linenumber") == 7) & (F.col("_linestatus") == "F"), F.lit("Saldo Inicial"))
             .when(F.col("_linenumber") == 7, F.lit("Saldo Final")).otherwise(F.col("kind")))
    return b.select("ledger_id", "row_id", kind.alias("kind"), "origin", label.alias("label"),
                    F.col("subcategory").alias("label2"), "date", "concept", "debit", "credit", "bank_balance",
                    F.concat(F.lit("REF "), "row_id").alias("reference"))


def recode_table(spark: SparkSession) -> DataFrame:
    """Legacy label → (category, sub): misses LARGE, has blank and filled ``sub`` (a parameter table)."""
    rows = [("ECONOMY", "Supermercado", ""), ("SMALL", "Servicios", "Agua"), ("MEDIUM", "Salud", "Farmacia"),
            ("PROMO", "Otros ingresos", None), ("STANDARD", "No va", "")]
    return spark.createDataFrame(rows, "old string, new string, sub string")


# fixed priority rules of FIXTURES §4.2 (ord, pattern, lo, hi, category, subcategory, origin, kind)
PRIORITY_RULES = [
    (1, "RING", None, None, "Aros", "", "", ""),
    (2, "SMALL RING", None, None, "Aros chicos", "", "", ""),
    (3, "BOLT", "1000", "20000", "Bulones", "", "", ""),
    (4, "", "0", "5000", "Compras menores", "", "", ""),
    (5, "RING", None, None, "Aros", "Anillos", "Caja de Ahorro", "Gastos"),
    (6, "GEAR", None, None, "", "", "", ""),          # no category: dropped by load_rules
    (7, None, None, None, "Vacía", "", "", ""),        # neither text nor amount: dropped
]
RULES_SCHEMA = ("ord int, pattern string, lo string, hi string, category string, subcategory string, "
                "origin string, kind string")


def raw_rules(spark: SparkSession, sf_dir: str, with_priority_rules: bool = True) -> DataFrame:
    """The rule sheet: the §4.2 rules plus one rule per ``p_name`` colour word (first word)."""
    part = _read(spark, sf_dir, "part")
    word = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    colours = part.select(word.alias("w")).distinct()
    colour_rules = colours.select(
        (F.lit(100) + F.dense_rank().over(_global_order("w"))).cast("int").alias("ord"),
        F.upper("w").alias("pattern"), F.lit(None).cast("string").alias("lo"),
        F.lit(None).cast("string").alias("hi"), F.concat(F.lit("Tienda "), F.col("w")).alias("category"),
        F.lit("").alias("subcategory"), F.lit("").alias("origin"), F.lit("").alias("kind"))
    if not with_priority_rules:
        return colour_rules
    fixed = spark.createDataFrame(PRIORITY_RULES, RULES_SCHEMA)
    return fixed.unionByName(colour_rules)


def _global_order(col: str):
    # The colour-word table has one row per distinct word (bounded by the vocabulary of p_name),
    # so a single-partition ranking window here is over a few dozen rows.
    from pyspark.sql import Window
    return Window.orderBy(col)


def mining_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled history for the miner (FIXTURES §3 'mining'): the label is the second part-name
    word, or the category where that word is not a subcategory (ring / bolt), so those tokens stay
    impure.  Unlabelled rows are left out, as the miner only reads labelled movements."""
    b = base_rows(spark, sf_dir)
    label = F.when(F.col("subcategory") != "", F.initcap("subcategory")).otherwise(F.col("category"))
    return b.select("ledger_id", "row_id", "date", "concept", label.alias("label")).where(F.col("label") != "")


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated proposals (pattern → category, subcategory, note) for the part-name second words
    other than ring / bolt."""
    w = F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))
    return (_read(spark, sf_dir, "part").select(w.alias("w")).where(~F.col("w").isin("ring", "bolt")).distinct()
            .select(F.upper("w").alias("pattern"), F.lit("Compras").alias("category"),
                    F.initcap("w").alias("subcategory"),
                    F.when(F.col("w") == "gizmo", F.lit("revisar")).otherwise(F.lit("")).alias("note")))


def new_format_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule sheet that is already in the new format, one line for each part: text cells, some blank in the ways of a
    spreadsheet, bounds that are no numbers, and no column for the type."""
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    return _read(spark, sf_dir, "part").select(
        F.when(size % 4 == 0, "NaN").otherwise(F.concat(F.lit("  "), F.col("p_name"), F.lit(" "))).alias("pattern"),
        F.when(size % 2 == 0, size.cast("string")).otherwise("x").alias("lo"),
        F.when(size % 3 == 0, (size + 100).cast("string")).alias("hi"),
        F.when(size % 5 == 0, " none ").when(size % 7 != 0, F.col("p_type")).alias("category"),
        key.alias("subcategory"), F.when(size % 6 != 0, F.col("p_brand")).alias("origin"))
