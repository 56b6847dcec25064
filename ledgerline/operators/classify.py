"""Rule labelling (J2, J2b) and its coverage report (A10).

A movement matches a rule when every condition the rule gives holds: its pattern is a substring of
the upper-cased concept or of the normalised concept (P6), and lo ≤ max(|debit|,|credit|) ≤ hi
(each bound optional, inclusive).  The best match is the first in rule priority (S4).  A blank
concept never matches; no match gives ('Sin clasificar', '', '', '').

Strategies (results are identical, and none has a limit: a form whose bound a rule table exceeds
hands over to ``index``):

* ``case``  — the default up to ``AUTO_CASE_RULES`` rules.  The ranked rules become one CASE WHEN chain
  evaluated per row inside whole-stage codegen: map-only, no shuffle, no join.
* ``index`` — the default above ``AUTO_JOIN_RULES``.  A pattern can only occur in a text that contains its grams, so rules are
  equi-joined with the grams of the distinct concepts on the rarest gram of each pattern, then verified;
  candidates are joined back and the amount bounds and the best priority checked per row.
* ``join``  — the default between.  Distinct concepts ⋈ broadcast(rules) on the substring condition, up to
  ``max_broadcast`` rules; its work is concepts × rules.
* ``distinct`` (J2b) — the CASE chain on distinct (concept, amount) keys, joined back; pays off
  when the same concepts repeat many times and the rule list is long.

The order of rules is a struct of their rank criteria, so no form needs consecutive priorities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.constants import UNCLASSIFIED
from ledgerline.functions.numbers import abs_amount
from ledgerline.functions.text import norm_concept, strip
from ledgerline.session import materialize

MAX_INLINE_RULES = 2_000
AUTO_CASE_RULES = 32
AUTO_JOIN_RULES = 1_000
MAX_BROADCAST_RULES = 200_000
OUT = ("rule_ord", "new_category", "new_subcategory", "new_origin", "new_kind")


def _match_inputs(df: DataFrame, concept, amount: Column) -> DataFrame:
    c = F.coalesce((F.col(concept) if isinstance(concept, str) else concept).cast("string"), F.lit(""))
    return (df.withColumn("_cu", F.upper(c))
              .withColumn("_cn", norm_concept(c))
              .withColumn("_blank", strip(c) == "")
              .withColumn("_amt", amount))


def _rule_condition(pattern: str, lo, hi) -> Column:
    cond = ~F.col("_blank")
    if pattern:
        cond = cond & (F.col("_cu").contains(F.lit(pattern)) | F.col("_cn").contains(F.lit(pattern)))
    if lo is not None:
        cond = cond & (F.col("_amt") >= F.lit(lo))
    if hi is not None:
        cond = cond & (F.col("_amt") <= F.lit(hi))
    return cond


def _rank() -> Column:
    """The order of S4 as one comparable value: more conditions, more outputs, longer pattern, sheet order."""
    return F.struct((-F.col("spec")).alias("a"), (-F.col("outs")).alias("b"), (-F.length("pattern")).alias("c"), F.col("ord").alias("d"),
                    F.col("pattern").alias("e"), F.col("category").alias("f"), F.col("subcategory").alias("g"))


def _fewer_than(rules: DataFrame, limit: int) -> bool:
    return rules.limit(limit + 1).count() <= limit


def _case_labels(rules: DataFrame) -> Column:
    """One struct column with the best rule's outputs (null if none); the caller has checked the row count."""
    expr = None
    for r in rules.orderBy(_rank()).collect():
        out = F.struct(F.lit(r["ord"]).cast("int").alias("o"), F.lit(r["category"]).alias("c"),
                       F.lit(r["subcategory"]).alias("s"), F.lit(r["origin"]).alias("g"), F.lit(r["kind"]).alias("k"))
        cond = _rule_condition(r["pattern"], r["lo"], r["hi"])
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    if expr is None:
        return F.lit(None).cast("struct<o:int,c:string,s:string,g:string,k:string>")
    return expr


def _explode_label(df: DataFrame, col: str = "_best") -> DataFrame:
    b = F.col(col)
    return (df.withColumn("rule_ord", b["o"])
              .withColumn("new_category", F.coalesce(b["c"], F.lit(UNCLASSIFIED)))
              .withColumn("new_subcategory", F.coalesce(b["s"], F.lit("")))
              .withColumn("new_origin", F.coalesce(b["g"], F.lit("")))
              .withColumn("new_kind", F.coalesce(b["k"], F.lit("")))
              .drop(col, "_cu", "_cn", "_blank", "_amt"))


def classify(df: DataFrame, rules: DataFrame, strategy: str = "auto", concept: str = "concept",
             debit: str = "debit", credit: str = "credit", max_inline: int = MAX_INLINE_RULES,
             max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Adds rule_ord, new_category, new_subcategory, new_origin, new_kind to every row.

    ``auto`` picks ``case`` up to ``AUTO_CASE_RULES`` rules (a CASE chain stays inside generated code; a very
    long one exceeds the JVM method size and runs interpreted), ``join`` up to ``AUTO_JOIN_RULES`` and ``index`` above.
    """
    most = {"auto": None, "case": max_inline, "distinct": max_inline, "join": max_broadcast, "index": 0}
    if strategy not in most:
        raise ValueError(strategy)
    if strategy == "auto":
        n = rules.limit(AUTO_JOIN_RULES + 1).count()
        strategy = "case" if n <= AUTO_CASE_RULES else "join" if n <= AUTO_JOIN_RULES else "index"
    elif strategy != "index" and not _fewer_than(rules, most[strategy]):
        strategy = "index"
    if strategy in ("join", "index"):
        return _classify_by_concept(df, rules, concept, debit, credit, pairwise=strategy == "join")
    if strategy == "case":
        m = _match_inputs(df, concept, abs_amount(debit, credit))
        return _explode_label(m.withColumn("_best", _case_labels(rules)))
    # The CASE chain on distinct (concept, amount) keys, joined back
    keys = df.select(F.col(concept).alias("_k_concept"), abs_amount(debit, credit).alias("_k_amt")).distinct()
    keys = _match_inputs(keys, "_k_concept", F.col("_k_amt"))
    best = keys.withColumn("_best", _case_labels(rules)).select("_k_concept", "_k_amt", "_best")
    m = df.withColumn("_m_amt", abs_amount(debit, credit))
    j = m.join(best, F.col(concept).eqNullSafe(F.col("_k_concept")) & (F.col("_m_amt") == F.col("_k_amt")), "left")
    return _explode_label(j.drop("_k_concept", "_k_amt", "_m_amt"))


def _candidate(rank: Column) -> Column:
    """A rule as a candidate of a concept; candidates compare by rank first."""
    return F.struct(rank.alias("priority"), F.col("lo"), F.col("hi"), F.col("ord").alias("o"), F.col("category").alias("c"),
                    F.col("subcategory").alias("s"), F.col("origin").alias("g"), F.col("kind").alias("k"))


def _best_candidates(hits: DataFrame) -> DataFrame:
    """(concept, candidates): those ranked after a concept's best rule without amount bounds can never win."""
    free = F.min(F.when(F.col("rule.lo").isNull() & F.col("rule.hi").isNull(), F.col("rule.priority"))).over(
        Window.partitionBy("_k_concept"))
    hits = hits.withColumn("_free", free).where(F.col("_free").isNull() | (F.col("rule.priority") <= F.col("_free")))
    return hits.groupBy("_k_concept").agg(F.collect_list("rule").alias("_cands"))


def _pick_per_row(df: DataFrame, cand: DataFrame, concept: str, debit: str, credit: str,
                  by_amount: Column | None = None) -> DataFrame:
    """Join each row to its concept's candidate rules; keep the best whose amount bounds hold, or the row's best
    amount-only rule if that ranks before it."""
    m = df.withColumn("_m_amt", abs_amount(debit, credit))
    j = m.join(cand, F.col(concept).eqNullSafe(F.col("_k_concept")), "left")
    best = F.array_min(F.filter("_cands", lambda x: (x["lo"].isNull() | (F.col("_m_amt") >= x["lo"]))
                                & (x["hi"].isNull() | (F.col("_m_amt") <= x["hi"]))))
    if by_amount is not None:
        best = F.least(best, by_amount)                # skips nulls
    j = j.withColumn("_pick", best)
    j = j.withColumn("_best", F.when(F.col("_pick").isNotNull(), F.struct("_pick.o", "_pick.c", "_pick.s", "_pick.g", "_pick.k")))
    return _explode_label(j.drop("_k_concept", "_cands", "_m_amt", "_pick"))


GRAM = 3


def grams_of(c: Column, n: int) -> Column:
    """The n-character substrings of a text."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1)))
    return F.filter(F.transform(starts, lambda i: F.substring(c, i, n)), lambda g: F.length(g) == n)


#: a gram is hot if more texts hold it than this and than one of HOT_SHARE: then there are at most HOT_SHARE times a
#: text's length of hot grams, however large the data
HOT_TEXTS = 10_000
HOT_SHARE = 256


def gram_matches(texts: DataFrame, columns: list[str], patterns: DataFrame, pattern: str = "pattern",
                 hot_texts: int = HOT_TEXTS) -> DataFrame:
    """texts ⋈ patterns where one of the text ``columns`` contains the non-empty pattern, as an equi-join; the rows of
    ``texts`` are distinct.  Patterns under GRAM characters are their own gram.

    A pattern meets the texts at the one of its grams that the fewest texts contain, and the substring is verified.  If
    even that gram is hot, all of the pattern's grams are: it meets the texts that hold its two rarest grams,
    at the pair, and the pair's texts are dealt over as many salts as the rarer gram has times the bound.
    """
    own = patterns.where(F.length(pattern) > 0)
    size = F.least(F.length(pattern), F.lit(GRAM))
    sizes = sorted(own.agg(F.collect_set(size)).first()[0]) or [GRAM]
    texts = materialize(texts)
    bound = max(hot_texts, texts.count() // HOT_SHARE)
    every = F.array_distinct(F.flatten(F.array(*[grams_of(F.col(c), n) for c in columns for n in sizes])))
    starts = F.sequence(F.lit(1), F.length(pattern) - size + 1)
    options = own.select(pattern).distinct().withColumn("_g", F.explode(F.array_distinct(F.transform(
        starts, lambda i: F.substring(F.col(pattern), i, size)))))
    grams = texts.withColumn("_g", F.explode(every))
    held = materialize(grams.join(options.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    # a gram that no text contains counts 0: the pattern's key is then that gram, and it meets no text
    rare = options.join(held, "_g", "left").groupBy(pattern).agg(F.slice(F.array_sort(F.collect_list(
        F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g")))), 1, 2).alias("_rare"))
    first, second = F.get("_rare", F.lit(0)), F.get("_rare", F.lit(1))
    wanted = own.join(rare, pattern).withColumn("_n", first["n"]).withColumn("_a", first["g"]).withColumn("_b", second["g"]).drop("_rare")
    hot = held.where(F.col("_n") > bound)

    cold = wanted.where(F.col("_n") <= bound).drop("_n", "_b").withColumnRenamed("_a", "_g")
    found = grams.join(cold.select("_g").distinct(), "_g", "left_semi").join(cold, "_g").drop("_g")
    if not hot.isEmpty():
        found = found.unionByName(_hot_matches(texts, grams, columns, wanted.where(F.col("_n") > bound), hot, bound))
    inside = F.lit(False)
    for c in columns:
        inside = inside | F.col(c).contains(F.col(pattern))
    return found.where(inside)


def _hot_matches(texts: DataFrame, grams: DataFrame, columns: list[str], wanted: DataFrame, hot: DataFrame, bound: int) -> DataFrame:
    """texts ⋈ wanted patterns (_n, _a, _b: texts of the rarest gram, and the two rarest) of which every gram is hot."""
    salts = F.ceil(F.col("_n") / bound).cast("int")
    key = ["_a", "_b"]          # in the order of the grams; a pattern of one gram has an empty first
    other = F.coalesce("_b", F.lit(""))
    wanted = materialize(wanted.withColumns({"_a": F.least("_a", other), "_b": F.greatest("_a", other)}))
    used = wanted.select(F.explode(F.array(*key)).alias("_g")).distinct()
    hot = F.broadcast(hot.join(used, "_g", "left_semi"))           # bounded, see HOT_SHARE
    own = F.array_sort(F.collect_list(F.struct(F.col("_g").alias("g"), F.col("_n").alias("n"))))
    each = grams.join(hot, "_g").groupBy(*texts.columns).agg(own.alias("_own"))
    single = F.transform("_own", lambda x: F.struct(F.lit("").alias("_a"), x["g"].alias("_b"), x["n"].alias("_n")))
    pairs = F.flatten(F.transform("_own", lambda x, i: F.transform(
        F.slice("_own", i + 2, F.size("_own")),
        lambda y: F.struct(x["g"].alias("_a"), y["g"].alias("_b"), F.least(x["n"], y["n"]).alias("_n")))))
    keys = each.withColumn("_k", F.explode(F.concat(single, pairs))).select(*texts.columns, "_k.*")
    keys = keys.join(wanted.select(*key).distinct(), key, "left_semi")
    keys = keys.withColumn("_salt", F.pmod(F.xxhash64(*columns), salts).cast("int")).drop("_n")
    dealt = wanted.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_n")
    return keys.join(dealt, [*key, "_salt"]).drop(*key, "_salt")


def _amount_only(df: DataFrame, rules: DataFrame, concept: str, debit: str, credit: str):
    """(rows, the best amount-only rule of a row as a candidate).  A few rules are a CASE chain; more are an interval
    tree that the distinct amounts are looked up in."""
    amt = abs_amount(debit, credit)
    blank = strip(F.coalesce(F.col(concept).cast("string"), F.lit(""))) == ""
    own = rules.where(F.col("pattern") == "").select("lo", "hi", _candidate(_rank()).alias("_a_rule"))
    if _fewer_than(own, AUTO_CASE_RULES):
        expr = None
        kind = own.schema["_a_rule"].dataType
        for r in own.orderBy("_a_rule.priority").collect():
            cond = ~blank
            for bound, ok in ((r["lo"], amt >= F.lit(r["lo"])), (r["hi"], amt <= F.lit(r["hi"]))):
                cond = cond & ok if bound is not None else cond
            rule = _literal(r["_a_rule"], kind)
            expr = F.when(cond, rule) if expr is None else expr.when(cond, rule)
        return df, expr
    amounts = df.where(~blank).select(amt.alias("_a_amt")).distinct()
    best = stab_intervals(amounts, "_a_amt", own, "_a_rule").select("_a_amt", F.col("_a_rule").alias("_a_best"))
    rows = df.withColumn("_a_row", amt).join(best, F.col("_a_row") == F.col("_a_amt"), "left").drop("_a_row", "_a_amt")
    return rows, F.when(~blank, F.col("_a_best"))


#: amounts are cents below 2^TOP
TOP = 60


def _nodes(intervals: DataFrame) -> DataFrame:
    """Intervals [lo, hi] of amounts as the nodes (level, node) of a binary tree over the cents: at most two of each
    level, disjoint and together exactly the interval.  A missing bound is the end of the line."""
    first = F.coalesce(F.greatest(F.ceil(F.col("lo") * 100).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))
    past = F.coalesce(F.floor(F.col("hi") * 100).cast("long") + 1, F.lit(1 << TOP))
    at = (intervals.withColumn("_first", first).withColumn("_past", past)
          .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(TOP)))))
    up = F.expr("(_first + shiftleft(1L, _level) - 1) >> _level")           # whole nodes [up, down) lie inside
    down = F.expr("_past >> _level")
    at = at.withColumn("_up", up).withColumn("_down", down).where("_up < _down")
    ends = F.array(F.when(F.col("_up") % 2 == 1, F.col("_up")), F.when(F.col("_down") % 2 == 1, F.col("_down") - 1))
    return (at.withColumn("_node", F.explode(F.filter(ends, lambda x: x.isNotNull())))
              .drop("_first", "_past", "_up", "_down", "lo", "hi"))


#: intervals that one task makes nodes of: a rule table of few bytes is one split, and its nodes are many times its rows
INTERVALS_PER_TASK = 50_000
#: points that one task looks up, each at every level
POINTS_PER_TASK = 20_000


def dealt_intervals(intervals: DataFrame, value: str) -> DataFrame:
    """The distinct intervals (lo, hi) with their least value, dealt over tasks of at most about INTERVALS_PER_TASK."""
    tasks = intervals.count() // INTERVALS_PER_TASK + 1
    return intervals.repartition(tasks, "lo", "hi").groupBy("lo", "hi").agg(F.min(value).alias(value))


def stab_intervals(points: DataFrame, point: str, intervals: DataFrame, value: str) -> DataFrame:
    """Each row of ``points`` (distinct amounts) that lies in some interval (lo, hi, value), with the least value of
    those.  An equi-join: a point's ancestors in the tree meet the intervals' nodes, of which each keeps only its
    least value, so a node is met once however many intervals share it."""
    tree = materialize(_nodes(dealt_intervals(intervals, value)).groupBy("_level", "_node").agg(F.min(value).alias(value)))
    sizes = {r["_level"]: r["count"] for r in tree.groupBy("_level").count().collect()}      # at most TOP + 1
    if not sizes:
        return points.limit(0).withColumn(value, F.lit(None).cast(intervals.schema[value].dataType))
    few, n = [], 0          # the levels of fewest nodes, broadcast: all points meet the same nodes there
    for level in sorted(sizes, key=lambda x: (sizes[x], x)):
        n += sizes[level]
        if n <= MAX_BROADCAST_RULES:
            few.append(level)
    points = points.repartition(points.count() // POINTS_PER_TASK + 1, point)

    def met(levels, nodes):
        above = points.withColumn("_level", F.explode(F.array(*[F.lit(x) for x in levels])))
        above = above.withColumn("_node", F.expr(f"cast(`{point}` * 100 as bigint) >> _level"))
        return above.join(nodes, ["_level", "_node"]).select(point, value)
    parts = [met(levels, nodes) for levels, nodes in (
        (few, F.broadcast(tree.where(F.col("_level").isin(few)))), ([x for x in sizes if x not in few], tree.where(~F.col("_level").isin(few)))) if levels]
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return found.groupBy(point).agg(F.min(value).alias(value))


def _literal(row, kind) -> Column:
    """A collected struct as a literal column of the same type."""
    fields = [(_literal(row[f.name], f.dataType) if hasattr(f.dataType, "fields") else F.lit(row[f.name]).cast(f.dataType)).alias(f.name)
              for f in kind.fields]
    return F.struct(*fields).cast(kind)


def _classify_by_concept(df: DataFrame, rules: DataFrame, concept: str, debit: str, credit: str, pairwise: bool) -> DataFrame:
    """Text conditions depend on the concept only: the distinct concepts meet the text rules, through ``gram_matches``
    or (``pairwise``; the caller has checked their number) through a broadcast of the rules.  Amount-only rules go
    by amount.  Candidates that can never win are dropped per concept; amount bounds and the best priority are then
    checked per row."""
    rows, by_amount = _amount_only(df, rules, concept, debit, credit)
    concepts = _match_inputs(df.select(F.col(concept).alias("_k_concept")).distinct(), "_k_concept", F.lit(None)).where("not _blank")
    concepts = concepts.select("_k_concept", "_cu", "_cn")
    text_rules = rules.where(F.col("pattern") != "").select("pattern", _candidate(_rank()).alias("rule"))
    if pairwise:
        inside = F.col("_cu").contains(F.col("pattern")) | F.col("_cn").contains(F.col("pattern"))
        hits = concepts.join(F.broadcast(text_rules), inside)
    else:
        hits = gram_matches(concepts, ["_cu", "_cn"], text_rules)
    out = _pick_per_row(rows, _best_candidates(hits.select("_k_concept", "rule")), concept, debit, credit, by_amount)
    return out.drop("_a_best")


def rule_coverage(classified: DataFrame) -> DataFrame:
    """A10: total, classified, unclassified and % classified (2 dp, exact)."""
    unc = F.col("new_category") == UNCLASSIFIED
    return (classified.agg(F.count(F.lit(1)).alias("total"), F.count_if(~unc).alias("classified"),
                           F.count_if(unc).alias("unclassified"))
            .withColumn("pct_classified",
                        F.when(F.col("total") > 0,
                               _pct(F.col("classified"), F.col("total")))))


def _pct(a: Column, b: Column) -> Column:
    # 100·a/b rounded half up to 2 dp using integers only
    from ledgerline.functions.numbers import round_ratio
    return round_ratio(a * 10000, b)


def category_distribution(classified: DataFrame) -> DataFrame:
    """A10: rows per assigned category."""
    return classified.groupBy(F.col("new_category").alias("category")).agg(F.count(F.lit(1)).alias("n"))


def top_unclassified(classified: DataFrame, n: int = 10) -> DataFrame:
    """A10 (+O6): the ``n`` most frequent upper/trim concepts left unclassified (ties by text)."""
    from pyspark.sql import Window
    c = (classified.where(F.col("new_category") == UNCLASSIFIED)
         .groupBy(F.upper(F.trim("concept")).alias("concept")).agg(F.count(F.lit(1)).alias("n")))
    # a top-k report (the limit is the feature): orderBy+limit plans as a per-partition top-k and a
    # merge of k rows; the rank window then runs on those k rows only
    top = c.orderBy(F.col("n").desc(), F.col("concept")).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("concept"))))


def rule_specificity(rules: DataFrame) -> DataFrame:
    """A10: rule counts by number of conditions."""
    return rules.groupBy("spec").agg(F.count(F.lit(1)).alias("n_rules"))
