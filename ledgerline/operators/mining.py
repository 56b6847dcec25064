"""Rule mining and review (G1–G3, J4–J6) and rule migration.

Token statistics shuffle on the token after map-side partial aggregation, so a token present in
every movement costs one pre-aggregated row per task, not one row per movement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.constants import CONCEPT_CHARS, EXAMPLE_CHARS, MINING_MIN_COUNT, MINING_PURITY_PCT, MINING_STOP_WORDS
from ledgerline.functions.numbers import round_ratio
from ledgerline.functions.text import BOUND, clean_num, clean_text, norm_concept, tokens, truncate
from ledgerline.operators.classify import gram_matches
from ledgerline.session import materialize

def tokenize(rows: DataFrame, concept: str = "concept", stop_words=MINING_STOP_WORDS) -> DataFrame:
    """P6 + P7: adds ``norm`` (normalised concept) and ``tokens``."""
    return rows.withColumn("norm", norm_concept(concept)).withColumn("tokens", tokens(F.col("norm"), stop_words))


def mine_patterns(labelled: DataFrame, label: str = "label", min_count: int = MINING_MIN_COUNT,
                  purity_pct: int = MINING_PURITY_PCT, concept: str = "concept", stop_words=MINING_STOP_WORDS) -> DataFrame:
    """G1: per token (counted once per movement): rows per label; keep tokens seen ≥ min_count times
    whose dominant label holds ≥ purity of them.  Output (pattern, label, matches, total, purity).
    ``stop_words`` are never patterns: give those of the own bank and language.

    Tokens depend on the concept only, so rows are first counted per (concept, label) and each
    distinct concept is normalised and tokenised once; its tokens carry the row count as weight.
    """
    grouped = labelled.groupBy(concept, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("_w"))
    t = grouped.select(F.explode(F.array_distinct(tokens(norm_concept(concept), stop_words))).alias("pattern"), "label", "_w")
    per = t.groupBy("pattern", "label").agg(F.sum("_w").alias("n"))
    tok = per.groupBy("pattern").agg(
        F.sum("n").alias("total"),
        F.max_by(F.struct(F.col("label"), F.col("n")), F.struct(F.col("n"), F.col("label"))).alias("_dom"))
    dom = F.col("_dom.n")
    return (tok.where((F.col("total") >= min_count) & (dom * 100 >= F.col("total") * purity_pct))
               .select("pattern", F.col("_dom.label").alias("label"), dom.alias("matches"), "total",
                       round_ratio(dom * 100, F.col("total")).alias("purity")))


def unmatched_concepts(rows: DataFrame, patterns: DataFrame, concept: str = "concept", stop_words=MINING_STOP_WORDS) -> DataFrame:
    """Rows none of whose tokens is a mined pattern.  Decided once per distinct concept
    (tokenise, explode, semi join the patterns), then rows of matched concepts are anti-joined away."""
    concepts = rows.select(concept).distinct()
    matched = (concepts.select(concept, F.explode(tokens(norm_concept(concept), stop_words)).alias("pattern"))
                       .join(patterns.select("pattern"), "pattern", "left_semi").select(concept).distinct())
    return rows.join(matched, concept, "left_anti")


def unmatched_summary(unmatched: DataFrame, label: str = "label", id_col: str = "row_id") -> DataFrame:
    """Per normalised concept: occurrences, most common label (tie ⇒ smallest), first example
    (lowest row id).  Two-level aggregation: (concept, label) counts, then the mode per concept."""
    lvl1 = unmatched.groupBy("norm", F.col(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("_n"), F.min_by(F.col("concept"), F.col(id_col)).alias("_ex"),
        F.min(id_col).alias("_id"))
    return (lvl1.groupBy("norm").agg(
                F.sum("_n").alias("occurrences"),
                F.min_by("_label", F.struct((-F.col("_n")).alias("a"), F.col("_label").alias("b"))).alias("top_label"),
                F.min_by("_ex", "_id").alias("_example"))
            .select(truncate("norm", CONCEPT_CHARS).alias("norm_concept"), "occurrences", "top_label",
                    truncate("_example", EXAMPLE_CHARS).alias("example")))


def pattern_example(rows: DataFrame, patterns: DataFrame, id_col: str = "row_id") -> DataFrame:
    """For each pattern, the first row (lowest id) whose normalised concept contains it; 55 chars.

    Rows are first reduced to distinct concepts (with their first row); these are normalised, unless ``rows`` has a
    ``norm``, and reduced to distinct normalised concepts, which meet the patterns in an equi-join on each pattern's
    rarest gram (``gram_matches``): exact, with no broadcast and no cap on the number of patterns.
    """
    per = rows.groupBy("concept", *(["norm"] if "norm" in rows.columns else [])).agg(F.min(id_col).alias("_id"))
    if "norm" not in per.columns:
        per = per.withColumn("norm", norm_concept("concept"))
    firsts = per.groupBy("norm").agg(F.min("_id").alias("_id"), F.min_by("concept", "_id").alias("_c"))
    pats = patterns.select("pattern")
    hits = gram_matches(firsts, ["norm"], pats)
    best = hits.groupBy("pattern").agg(F.min_by("_c", "_id").alias("_c"))
    return (pats.join(best, "pattern", "left")
            .select("pattern", F.coalesce(truncate("_c", EXAMPLE_CHARS), F.lit("")).alias("example")))


def propose_categories(keys: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Left lookup of a curated proposal (category, subcategory, note) by ``key``; absent ⇒ ''."""
    p = proposals.select(F.col("pattern").alias("_pk"), F.col("category").alias("proposed_category"),
                         F.col("subcategory").alias("proposed_subcategory"), F.col("note"))
    j = keys.join(p, F.col(key) == F.col("_pk"), "left").drop("_pk")
    return j.na.fill("", ["proposed_category", "proposed_subcategory", "note"])


def rule_review_patterns(patterns: DataFrame, rows: DataFrame, proposals: DataFrame) -> DataFrame:
    """G3 (sheet 1): mined patterns with proposal, example and note, numbered by matches, most first."""
    ex = pattern_example(rows, patterns)
    out = propose_categories(patterns.join(ex, "pattern", "left"), proposals, "pattern")
    return sequence(out, [F.col("matches").desc(), F.col("pattern")], "ord")


def rule_review_unmatched(summary: DataFrame, proposals: DataFrame) -> DataFrame:
    """G3 (sheet 2): unmatched concepts with the category proposed for their most common label, numbered by
    occurrences, most first (O4)."""
    s = summary.withColumn("_key", F.upper("top_label"))
    out = propose_categories(s, proposals, "_key").drop("_key", "note")
    return sequence(out, [F.col("occurrences").desc(), F.col("norm_concept"), F.col("example")], "ord")


def union_rules(old_patterns: DataFrame, old_unmatched: DataFrame) -> DataFrame:
    """Pattern sheet ∪ unmatched sheet (rows without category dropped) → one rule table."""
    a = old_patterns.select(F.col("pattern"), F.col("category"), F.col("subcategory"))
    b = old_unmatched.select(F.col("norm_concept").alias("pattern"), F.col("category"), F.col("subcategory"))
    u = a.unionByName(b).where(F.trim(F.coalesce(F.col("category"), F.lit(""))) != "")
    return u.select(F.trim("pattern").alias("pattern"), F.lit(None).cast(BOUND).alias("lo"),
                    F.lit(None).cast(BOUND).alias("hi"), F.trim("category").alias("category"),
                    F.trim(F.coalesce("subcategory", F.lit(""))).alias("subcategory"),
                    F.lit("").alias("origin"), F.lit("").alias("kind"))


def new_format_rules(sheet: DataFrame) -> DataFrame:
    """U1 on a sheet that is already in the new format: rows with a category, as they are, with amounts, origin and type."""
    text = lambda c: clean_text(c) if c in sheet.columns else F.lit("")
    bound = lambda c: clean_num(c) if c in sheet.columns else F.lit(None).cast(BOUND)
    return sheet.where(clean_text("category") != "").select(
        text("pattern").alias("pattern"), bound("lo").alias("lo"), bound("hi").alias("hi"),
        *[text(c).alias(c) for c in ("category", "subcategory", "origin", "kind")])


def migrate_rules(old_patterns: DataFrame | None, old_unmatched: DataFrame | None, new_sheet: DataFrame | None = None) -> DataFrame:
    """U1 (or, if given, the new-format sheet alone) ordered for review (O5): category, longer pattern first, pattern; ``ord`` is the
    sheet position.  The ranking window runs over the rule table only."""
    u = union_rules(old_patterns, old_unmatched) if new_sheet is None else new_format_rules(new_sheet)
    return sequence(u, [F.col("category"), F.length("pattern").desc(), F.col("pattern"), F.col("subcategory")], "ord")


def sequence(df: DataFrame, order, name: str, partitions: int | None = None) -> DataFrame:
    """Consecutive 1-based numbers in ``order`` without a single-partition window: range-partition
    and sort, number rows inside each partition, then add each partition's offset (a running sum
    over one count per partition)."""
    from pyspark.sql import Window as _W
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # materialized once, so both branches below see the same partition ids
    s = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                      .withColumn("_pid", F.spark_partition_id()))
    local = s.withColumn("_rn", F.row_number().over(_W.partitionBy("_pid").orderBy(*order)))
    # one row per partition: the running sum runs over at most `n` rows
    offsets = (s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
                .withColumn("_off", F.sum("_cnt").over(_W.orderBy("_pid").rowsBetween(_W.unboundedPreceding, -1))))
    return (local.join(F.broadcast(offsets.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))), "_pid")
                 .withColumn(name, (F.col("_off") + F.col("_rn")).cast("int")).drop("_pid", "_rn", "_off"))


def taxonomy_from(rows: DataFrame) -> DataFrame:
    """D7 taxonomy (category → sorted distinct non-blank subcategories) derived from labelled rows."""
    return (rows.where(F.col("category") != "").groupBy("category")
                .agg(F.array_sort(F.collect_set(F.when(F.col("subcategory") != "", F.col("subcategory"))))
                     .alias("subcategories")))


def flat_subcategories(taxonomy: DataFrame) -> DataFrame:
    """Distinct subcategories of all categories, with the number of categories."""
    # the taxonomy is a reference table (one row per category), so the un-partitioned count is tiny
    t = taxonomy.withColumn("n_categories", F.count(F.lit(1)).over(Window.partitionBy()))
    return t.select(F.explode("subcategories").alias("subcategory"), "n_categories").distinct()


def category_reference(taxonomy: DataFrame) -> DataFrame:
    """S7 (third output): the category reference — each category with its subcategories, comma
    separated, in name order."""
    return taxonomy.select("category", F.array_join("subcategories", ", ").alias("subcategories"))


def write_rule_review(patterns: DataFrame, unmatched: DataFrame, taxonomy: DataFrame, path: str) -> None:
    """S7 sink: the three review tables as parquet folders under ``path``."""
    patterns.write.mode("overwrite").parquet(f"{path}/patterns")
    unmatched.write.mode("overwrite").parquet(f"{path}/unmatched")
    category_reference(taxonomy).write.mode("overwrite").parquet(f"{path}/categories")
