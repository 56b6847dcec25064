"""DuckDB oracle SQL for the registered queries (the driver's correctness gate).

Every statement starts from the FIXTURES.md §3 adapter over the pre-registered driver views and is
written independently of the Spark operators (e.g. the bank-balance recurrence is a recursive CTE,
the cross table a UNION ALL of levels).  Money stays DECIMAL until the last projection.
"""

from __future__ import annotations

from ledgerline.constants import (DEFAULT_INCOME_CATEGORIES, DEFAULT_SYSTEM_CATEGORIES, MONTH_ABBR)
from ledgerline.sources import adapter

REPORT_YEAR = 1998


def _list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


MONEY_EXPR = ("cast(cast(l.l_extendedprice AS decimal(18,2)) * (cast(1 AS decimal(4,2)) - "
              "cast(l.l_discount AS decimal(4,2))) AS decimal(18,2))")

ADAPTER = f"""
base_rows AS (
  SELECT cast(s.s_nationkey AS varchar) AS ledger_id,
    CASE l.l_linestatus WHEN 'F' THEN 'Caja de Ahorro' ELSE 'Tarjeta de crédito' END AS origin,
    CASE l.l_returnflag WHEN 'A' THEN 'Gastos' WHEN 'R' THEN 'Ingresos' ELSE '' END AS kind,
    CASE p.p_type WHEN 'ECONOMY' THEN 'Supermercado' WHEN 'SMALL' THEN 'Servicios' WHEN 'MEDIUM' THEN 'Salud'
         WHEN 'PROMO' THEN 'Otros ingresos' WHEN 'STANDARD' THEN 'No va' ELSE '' END AS category,
    CASE WHEN split_part(p.p_name, ' ', 2) IN ('ring','bolt') THEN '' ELSE split_part(p.p_name, ' ', 2) END AS subcategory,
    cast(l.l_shipdate AS date) AS date,
    'COMPRA ' || upper(p.p_name) || '  ' || cast(p.p_partkey AS varchar) || ' ' || p.p_brand AS concept,
    CASE WHEN l.l_returnflag <> 'R' THEN {MONEY_EXPR} END AS debit,
    CASE WHEN l.l_returnflag =  'R' THEN {MONEY_EXPR} END AS credit,
    CASE WHEN l.l_linenumber = 1 AND month(l.l_shipdate) % 3 <> 0 THEN cast(l.l_extendedprice AS decimal(18,2)) END AS bank_balance,
    lpad(cast(l.l_orderkey AS varchar), 12, '0') || '-' || lpad(cast(l.l_linenumber AS varchar), 2, '0') || '-' ||
    lpad(cast(l.l_partkey AS varchar), 12, '0') || '-' || lpad(cast(l.l_suppkey AS varchar), 12, '0') AS row_id,
    l.l_quantity AS _quantity, l.l_linenumber AS _linenumber, p.p_type AS _ptype, p.p_name AS _pname,
    l.l_linestatus AS _linestatus
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
movements AS (
  SELECT ledger_id, row_id, cast(year(date) AS varchar) AS batch_id, kind, origin, category, subcategory, date,
         concept, debit, credit, bank_balance, '' AS reference, '' AS destination, category = '' AS review
  FROM base_rows
)"""


def _clean(c: str) -> str:
    return f"(CASE WHEN lower(trim(coalesce({c}, ''))) IN ('nan', 'none') THEN '' ELSE trim(coalesce({c}, '')) END)"


LEDGER = f"""
led AS (
  SELECT ledger_id, row_id, date, strftime(date, '%Y-%m') AS month,
    {_clean('kind')} AS kind, {_clean('origin')} AS origin,
    CASE WHEN {_clean('category')} = '' THEN 'Sin clasificar' ELSE {_clean('category')} END AS category,
    {_clean('subcategory')} AS subcategory, trim(coalesce(concept, '')) AS concept, debit, credit, bank_balance,
    coalesce(credit, 0) - coalesce(debit, 0) AS amount
  FROM movements WHERE date IS NOT NULL AND year(date) >= {adapter.FIRST_YEAR}
),
fl AS (
  SELECT *, CASE WHEN category IN ({_list(DEFAULT_SYSTEM_CATEGORIES)}) THEN NULL
                 WHEN kind = 'Ingresos' OR (kind = '' AND category IN ({_list(DEFAULT_INCOME_CATEGORIES)})) THEN 'income'
                 WHEN category <> '' THEN 'expense' END AS flow
  FROM led
)"""

OPENING = """
opening AS (
  SELECT cast(s_nationkey AS varchar) AS ledger_id, cast(sum(cast(s_acctbal AS decimal(18,2))) AS decimal(18,2)) AS opening
  FROM supplier GROUP BY 1
)"""


def label(m: str) -> str:
    return f"([{_list(MONTH_ABBR)}])[cast(substr({m}, 6, 2) AS integer)] || ' ' || substr({m}, 3, 2)"


def q(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([ADAPTER, LEDGER, OPENING, *ctes]) + "\n" + select


MONTHS = """
mt AS (
  SELECT ledger_id, month,
    coalesce(-sum(CASE WHEN flow = 'expense' THEN amount END), 0) AS expense_total,
    coalesce(sum(CASE WHEN flow = 'income' THEN amount END), 0) AS income_total
  FROM fl GROUP BY ledger_id, month
)"""

RUNNING = """
rb0 AS (
  SELECT ledger_id, month, coalesce(sum(CASE WHEN category <> 'No va' THEN amount END), 0) AS net
  FROM led GROUP BY ledger_id, month
),
rb AS (
  SELECT r.ledger_id, r.month, r.net,
    coalesce(o.opening, 0) + sum(r.net) OVER (PARTITION BY r.ledger_id ORDER BY r.month
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS closing
  FROM rb0 r LEFT JOIN opening o ON o.ledger_id = r.ledger_id
)"""

CAT_TOTALS = """
ct AS (
  SELECT ledger_id, month, category, -sum(amount) AS total, count(*) AS n
  FROM fl WHERE flow = 'expense' GROUP BY ledger_id, month, category
)"""

BANK = """
bk_last AS (
  SELECT ledger_id, month, bank_balance,
         row_number() OVER (PARTITION BY ledger_id, month ORDER BY date DESC, row_id DESC) AS rn
  FROM led
),
bk_seq AS (
  SELECT m.ledger_id, m.month, cast(m.net AS decimal(38,2)) AS net,
         cast(nullif(b.bank_balance, 0) AS decimal(38,2)) AS known,
         row_number() OVER (PARTITION BY m.ledger_id ORDER BY m.month) AS i
  FROM (SELECT ledger_id, month, sum(amount) AS net FROM led GROUP BY 1, 2) m
  JOIN bk_last b ON b.ledger_id = m.ledger_id AND b.month = m.month AND b.rn = 1
),
bk(ledger_id, i, month, net, known, opening, closing) AS (
  SELECT ledger_id, i, month, net, known, known - net, known FROM bk_seq WHERE i = 1
  UNION ALL
  SELECT s.ledger_id, s.i, s.month, s.net, s.known,
         CASE WHEN r.closing IS NULL AND s.known IS NOT NULL THEN s.known - s.net ELSE r.closing END,
         CASE WHEN s.known IS NOT NULL THEN s.known WHEN r.closing IS NOT NULL THEN r.closing + s.net END
  FROM bk r JOIN bk_seq s ON s.ledger_id = r.ledger_id AND s.i = r.i + 1
)"""


def _d(x: str, alias: str) -> str:
    return f"cast({x} AS double) AS {alias}"


def _round_ratio(num_cents: str, den: str) -> str:
    return f"cast(sign({num_cents}) * ((2 * abs({num_cents}) + {den}) // (2 * {den})) AS double) / 100"


GROUPS = """
g1 AS (
  SELECT ledger_id, month, category, origin, subcategory, concept, count(*) AS n, max(date) AS d, sum(amount) AS s
  FROM fl WHERE flow = 'expense' GROUP BY ALL
),
grp AS (
  SELECT ledger_id, month, category, origin, subcategory, max(d) AS last_date,
         substr(first(concept ORDER BY n DESC, concept ASC), 1, 60) AS concept, sum(s) AS total, sum(n) AS n
  FROM g1 GROUP BY ledger_id, month, category, origin, subcategory
)"""

CROSS = """
xb AS (
  SELECT ledger_id, month, category, subcategory,
         CASE WHEN flow = 'income' THEN 'income' WHEN flow = 'expense' AND category <> 'Sin clasificar' THEN 'expense' END AS section,
         amount
  FROM {src}
),
xm AS (SELECT DISTINCT ledger_id, month FROM xb),
xf AS (SELECT *, CASE WHEN section = 'income' THEN amount ELSE -amount END AS value FROM xb WHERE section IS NOT NULL),
x_sub AS (
  SELECT k.ledger_id, k.section, 'sub' AS level, k.category, k.subcategory, m.month,
         coalesce(f.value, 0) AS value, cast(NULL AS bigint) AS rank
  FROM (SELECT DISTINCT ledger_id, section, category, subcategory FROM xf WHERE subcategory <> '') k
  JOIN xm m ON m.ledger_id = k.ledger_id
  LEFT JOIN (SELECT ledger_id, section, category, subcategory, month, sum(value) AS value FROM xf GROUP BY ALL) f
    ON f.ledger_id = k.ledger_id AND f.section = k.section AND f.category = k.category
   AND f.subcategory = k.subcategory AND f.month = m.month
),
x_cat AS (
  SELECT k.ledger_id, k.section, 'category' AS level, k.category, cast(NULL AS varchar) AS subcategory, m.month,
         coalesce(f.value, 0) AS value, cast(NULL AS bigint) AS rank
  FROM (SELECT DISTINCT ledger_id, section, category FROM xf) k
  JOIN xm m ON m.ledger_id = k.ledger_id
  LEFT JOIN (SELECT ledger_id, section, category, month, sum(value) AS value FROM xf GROUP BY ALL) f
    ON f.ledger_id = k.ledger_id AND f.section = k.section AND f.category = k.category AND f.month = m.month
),
x_sec AS (
  SELECT m.ledger_id, s.section, 'section' AS level, cast(NULL AS varchar) AS category, cast(NULL AS varchar) AS subcategory,
         m.month, coalesce(f.value, 0) AS value, cast(NULL AS bigint) AS rank
  FROM xm m CROSS JOIN (VALUES ('income'), ('expense')) s(section)
  LEFT JOIN (SELECT ledger_id, section, month, sum(value) AS value FROM xf GROUP BY ALL) f
    ON f.ledger_id = m.ledger_id AND f.section = s.section AND f.month = m.month
),
x_tot AS (
  SELECT ledger_id, section, 'total' AS level, category, cast(NULL AS varchar) AS subcategory, cast(NULL AS varchar) AS month,
         value, row_number() OVER (PARTITION BY ledger_id, section ORDER BY value DESC, category) AS rank
  FROM (SELECT ledger_id, section, category, sum(value) AS value FROM xf GROUP BY ALL)
),
xt AS (SELECT * FROM x_sub UNION ALL SELECT * FROM x_cat UNION ALL SELECT * FROM x_sec UNION ALL SELECT * FROM x_tot)"""

XT_SELECT = ("SELECT ledger_id, section, level, category, subcategory, month, cast(value AS double) AS value, "
             "cast(rank AS bigint) AS rank FROM xt")

LAST12 = """
l12 AS (SELECT ledger_id, month FROM (SELECT ledger_id, month, row_number() OVER (PARTITION BY ledger_id ORDER BY month DESC) AS r FROM mt) WHERE r <= 12),
avgc AS (
  SELECT c.ledger_id, c.category, sum(cast(c.total * 100 AS bigint)) AS cc, count(*) AS n_months
  FROM ct c JOIN l12 USING (ledger_id, month) GROUP BY 1, 2
)"""

TOPCAT = """
tc AS (
  SELECT ledger_id, category, total, row_number() OVER (PARTITION BY ledger_id ORDER BY total DESC, category) AS rank
  FROM (SELECT ledger_id, category, sum(total) AS total FROM ct GROUP BY 1, 2)
)"""

_months_of_year = ", ".join(
    f"cast(sum(CASE WHEN month = '{REPORT_YEAR}-{m:02d}' THEN value END) AS double) AS \"{REPORT_YEAR}-{m:02d}\""
    for m in range(1, 13))

ORACLE = {
    "flagship": q(MONTHS, RUNNING, select=f"""
SELECT m.ledger_id, m.month, {label('m.month')} AS label, {_d('m.income_total', 'income_total')},
       {_d('m.expense_total', 'expense_total')}, {_d('r.closing - r.net', 'opening')}, {_d('r.closing', 'closing')}
FROM mt m JOIN rb r USING (ledger_id, month)"""),
    "month_totals": q(MONTHS, select=f"""
SELECT ledger_id, month, {_d('expense_total', 'expense_total')}, {_d('income_total', 'income_total')},
       {label('month')} AS label FROM mt"""),
    "running_balance": q(RUNNING, select=f"""
SELECT ledger_id, month, {_d('closing - net', 'opening')}, {_d('closing', 'closing')}, {_d('net', 'net')} FROM rb"""),
    "opening_balance": q(RUNNING, select=f"SELECT ledger_id, month, {_d('closing - net', 'opening')} FROM rb"),
    "category_totals": q(CAT_TOTALS, select=f"SELECT ledger_id, month, category, {_d('total', 'total')}, n FROM ct"),
    "subcategory_totals": q(select=f"""
SELECT ledger_id, month, category, subcategory, {_d('-sum(amount)', 'total')}
FROM fl WHERE flow = 'expense' AND subcategory <> '' GROUP BY ledger_id, month, category, subcategory"""),
    "group_movements": q(GROUPS, select=f"""
SELECT ledger_id, month, category, origin, subcategory, cast(last_date AS varchar) AS last_date, {_d('total', 'total')},
       n, concept,
       row_number() OVER (PARTITION BY ledger_id, month, category ORDER BY total, origin, subcategory) AS rank,
       row_number() OVER (PARTITION BY ledger_id, month, category ORDER BY total, origin, subcategory) <= 30 AS shown
FROM grp"""),
    "movement_count": q(select="""
SELECT ledger_id, month, category, count(*) AS n_movements FROM fl WHERE flow = 'expense' GROUP BY 1, 2, 3"""),
    "top_movements": q(GROUPS, select=f"""
SELECT * FROM (
  SELECT ledger_id, month, origin, category, subcategory, cast(last_date AS varchar) AS last_date,
         {_d('total', 'total')}, n, concept,
         row_number() OVER (PARTITION BY ledger_id, month ORDER BY total, origin, category, subcategory) AS rank
  FROM grp WHERE abs(total) > 500) WHERE rank <= 15"""),
    "cross_table": q(CROSS.format(src="fl"), select=XT_SELECT),
    "card_cross_table": q(CROSS.format(src="(SELECT * FROM fl WHERE coalesce(contains(lower(origin), 'tarjeta'), false))"),
                          select=XT_SELECT),
    "cross_table_wide": q(CROSS.format(src="fl"), select=f"""
SELECT ledger_id, section, category, {_months_of_year},
       cast(coalesce(sum(value), 0) AS double) AS total
FROM xt WHERE level = 'category' AND month LIKE '{REPORT_YEAR}%' GROUP BY ledger_id, section, category"""),
    "unclassified_series": q(select=f"""
SELECT ledger_id, month, {_d("-coalesce(sum(CASE WHEN category = 'Sin clasificar' THEN amount END), 0)", 'value')}
FROM led GROUP BY 1, 2"""),
    "unclassified_movements": q(select=f"""
SELECT ledger_id, month, row_id, cast(date AS varchar) AS date, substr(concept, 1, 60) AS concept, {_d('amount', 'amount')}
FROM led WHERE category = 'Sin clasificar'"""),
    "last_n_months": q(MONTHS, select="""
SELECT * FROM (SELECT ledger_id, month, dense_rank() OVER (PARTITION BY ledger_id ORDER BY month DESC) AS rank FROM mt)
WHERE rank <= 12"""),
    "category_average": q(MONTHS, CAT_TOTALS, LAST12, select=f"""
SELECT ledger_id, category, {_round_ratio('cc', 'n_months')} AS average, n_months FROM avgc"""),
    "top_categories": q(CAT_TOTALS, TOPCAT, select=f"""
SELECT ledger_id, category, {_d('total', 'total')}, rank FROM tc WHERE rank <= 8"""),
    "history": q(MONTHS, CAT_TOTALS, TOPCAT, select=f"""
SELECT t.ledger_id, t.category, m.month, {_d('coalesce(c.total, 0)', 'total')}, t.rank
FROM tc t JOIN mt m ON m.ledger_id = t.ledger_id
LEFT JOIN ct c ON c.ledger_id = t.ledger_id AND c.category = t.category AND c.month = m.month
WHERE t.rank <= 8"""),
    "category_trend": q(MONTHS, CAT_TOTALS, select="""
, grid AS (
  SELECT k.ledger_id, k.category, m.month, coalesce(c.total, 0) AS v,
         row_number() OVER (PARTITION BY k.ledger_id, k.category ORDER BY m.month) AS idx
  FROM (SELECT DISTINCT ledger_id, category FROM ct) k JOIN mt m ON m.ledger_id = k.ledger_id
  LEFT JOIN ct c ON c.ledger_id = k.ledger_id AND c.category = k.category AND c.month = m.month
), s AS (
  SELECT ledger_id, category, month, least(idx, 6) AS len,
    cast(sum(v) OVER (PARTITION BY ledger_id, category ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS double) / 3 AS recent,
    cast(coalesce(sum(v) OVER (PARTITION BY ledger_id, category ORDER BY month ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), 0) AS double)
      / greatest(least(idx, 6) - 3, 1) AS older
  FROM grid
)
SELECT c.ledger_id, c.month, c.category, cast(c.total AS double) AS total,
  CASE WHEN s.len < 3 OR s.older = 0 THEN ''
       WHEN (s.recent - s.older) / s.older > 0.15 THEN 'up'
       WHEN (s.recent - s.older) / s.older < -0.15 THEN 'down' ELSE 'flat' END AS trend
FROM ct c JOIN s USING (ledger_id, category, month)"""),
    "trailing_mean": q(MONTHS, select="""
SELECT ledger_id, month, coalesce(cast(sum(expense_total) OVER w AS double) / count(expense_total) OVER w, 0.0) AS trailing_mean
FROM mt WINDOW w AS (PARTITION BY ledger_id ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""),
    "month_vs_average": q(MONTHS, CAT_TOTALS, LAST12, select=f"""
SELECT ledger_id, month, category, total, average,
       CASE WHEN average > 0 THEN total / average ELSE 0.0 END AS ratio,
       CASE WHEN (CASE WHEN average > 0 THEN total / average ELSE 0.0 END) > 1.2 THEN 'bad'
            WHEN (CASE WHEN average > 0 THEN total / average ELSE 0.0 END) > 1.0 THEN 'warn' ELSE 'ok' END AS status,
       least(CASE WHEN average > 0 THEN total / average ELSE 0.0 END, 1.5) / 1.5 * 100 AS bar
FROM (SELECT c.ledger_id, c.month, c.category, cast(c.total AS double) AS total,
             coalesce({_round_ratio('a.cc', 'a.n_months')}, 0.0) AS average
      FROM ct c LEFT JOIN avgc a USING (ledger_id, category))"""),
    "ledger_stats": q(MONTHS, select="""
SELECT ledger_id, cast(sum(expense_total) AS double) / count(*) AS avg_expense,
       cast(sum(income_total) AS double) / count(*) AS avg_income,
       first(month ORDER BY expense_total DESC, month DESC) AS max_month,
       cast(max(expense_total) AS double) AS max_expense,
       first(month ORDER BY expense_total ASC, month DESC) AS min_month,
       cast(min(expense_total) AS double) AS min_expense,
       count(*) AS n_months
FROM mt GROUP BY ledger_id"""),
    "bank_balance": q(BANK, select=f"""
SELECT ledger_id, month, {_d('opening', 'opening')}, {_d('closing', 'closing')}, {_d('net', 'net')} FROM bk"""),
    "balance_delta": q(RUNNING, select=f"""
SELECT ledger_id, month,
  CASE WHEN lag(closing) OVER w IS NOT NULL AND lead(month) OVER w IS NOT NULL
       THEN cast(closing - lag(closing) OVER w AS double) END AS delta,
  CASE WHEN lag(closing) OVER w IS NOT NULL AND lead(month) OVER w IS NOT NULL
       THEN {label('lag(month) OVER w')} END AS prev_label
FROM rb WINDOW w AS (PARTITION BY ledger_id ORDER BY month)"""),
    "last_known_balance": q(BANK, select="""
SELECT ledger_id, month, cast(last_value(closing IGNORE NULLS) OVER (PARTITION BY ledger_id ORDER BY month
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS double) AS last_known FROM bk"""),
    "account_summary": q(MONTHS, BANK, select=f"""
SELECT m.ledger_id, m.month, {label('m.month')} AS label, {_d('m.income_total', 'income_total')},
       {_d('m.expense_total', 'expense_total')}, {_d('b.closing', 'balance')}
FROM mt m LEFT JOIN bk b USING (ledger_id, month)"""),
    "balance_for_month": q(BANK, select="""
SELECT ledger_id, month,
  cast(coalesce(closing, last_value(closing IGNORE NULLS) OVER (PARTITION BY ledger_id ORDER BY month
       ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS double) AS balance,
  closing IS NULL AS is_fallback
FROM bk"""),
    "review_count": q(select="""
SELECT ledger_id, count(*) FILTER (WHERE category = 'Sin clasificar') AS n_review FROM led GROUP BY ROLLUP (ledger_id)"""),
    "active_years": q(select="""
SELECT year, year = max(year) OVER () AS is_default FROM (SELECT DISTINCT substr(month, 1, 4) AS year FROM led)"""),
    "account_accumulated": q(MONTHS, BANK, select="""
SELECT t.ledger_id, cast(t.income_total AS double) AS income_total, cast(t.expense_total AS double) AS expense_total,
       cast(b.last_balance AS double) AS last_balance
FROM (SELECT ledger_id, sum(income_total) AS income_total, sum(expense_total) AS expense_total FROM mt GROUP BY 1) t
LEFT JOIN (SELECT ledger_id, arg_max_null(closing, month) AS last_balance FROM bk GROUP BY 1) b USING (ledger_id)"""),
    "period_summary": q(CROSS.format(src="fl"), RUNNING, select=f"""
SELECT t.ledger_id, cast(t.income_total AS double) AS income_total, cast(t.expense_total AS double) AS expense_total,
       cast(b.opening AS double) AS opening, cast(b.closing AS double) AS closing
FROM (SELECT ledger_id, sum(CASE WHEN section = 'income' THEN value END) AS income_total,
             sum(CASE WHEN section = 'expense' THEN value END) AS expense_total
      FROM xt WHERE level = 'section' AND month LIKE '{REPORT_YEAR}%' GROUP BY 1) t
LEFT JOIN (SELECT ledger_id, arg_min_null(closing - net, month) AS opening, arg_max_null(closing, month) AS closing
           FROM rb WHERE month LIKE '{REPORT_YEAR}%' GROUP BY 1) b USING (ledger_id)"""),
    "non_empty_series": q(CROSS.format(src="fl"), select=f"""
SELECT ledger_id, section, level, category, subcategory, cast(sum(value) AS double) AS total
FROM xt WHERE level IN ('sub', 'category') AND month LIKE '{REPORT_YEAR}%'
GROUP BY ledger_id, section, level, category, subcategory HAVING max(abs(value)) > 0"""),
    "valid_dates": q(select=f"""
SELECT ledger_id, count(*) FILTER (WHERE date IS NOT NULL AND year(date) >= {REPORT_YEAR}) AS kept,
       count(*) FILTER (WHERE NOT (date IS NOT NULL AND year(date) >= {REPORT_YEAR})) AS dropped
FROM movements GROUP BY ledger_id"""),
}


# ---- rule labelling ---------------------------------------------------------------------------

def _norm_sql(c: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(regexp_replace(upper(coalesce({c}, '')), '[.*/-]', ' ', 'g'), "
            f"'[0-9]+', ' ', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))")


def _rule_values() -> str:
    rows = []
    for o, p, lo, hi, c, s, g, k in adapter.PRIORITY_RULES:
        def lit(v):
            return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
        rows.append(f"({o}, {lit(p)}, {lit(lo)}, {lit(hi)}, {lit(c)}, {lit(s)}, {lit(g)}, {lit(k)})")
    return ", ".join(rows)


def _rules_cte(with_priority: bool = True, extra_where: str = "", src: str = "movements",
               id_expr: str = "row_id") -> str:
    fixed = (f"SELECT * FROM (VALUES {_rule_values()}) v(ord, pattern, lo, hi, category, subcategory, origin, kind) "
             "UNION ALL ") if with_priority else ""
    return f"""
raw_rules AS (
  {fixed}SELECT cast(100 + dense_rank() OVER (ORDER BY w) AS integer) AS ord, upper(w) AS pattern,
         cast(NULL AS varchar) AS lo, cast(NULL AS varchar) AS hi, 'Tienda ' || w AS category, '' AS subcategory,
         '' AS origin, '' AS kind
  FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part)
),
rc AS (
  SELECT ord, upper({_clean('pattern')}) AS pattern, try_cast(trim(lo) AS decimal(18,2)) AS lo,
         try_cast(trim(hi) AS decimal(18,2)) AS hi, {_clean('category')} AS category, {_clean('subcategory')} AS subcategory,
         {_clean('origin')} AS origin, {_clean('kind')} AS kind
  FROM raw_rules
),
rk AS (
  SELECT *, row_number() OVER (ORDER BY spec DESC, outs DESC, length(pattern) DESC, ord) AS priority
  FROM (SELECT *, (pattern <> '')::integer + (lo IS NOT NULL OR hi IS NOT NULL)::integer AS spec,
               (subcategory <> '')::integer + (origin <> '')::integer + (kind <> '')::integer AS outs
        FROM rc WHERE category <> '' AND (pattern <> '' OR lo IS NOT NULL OR hi IS NOT NULL) {extra_where})
),
cm AS (
  SELECT *, {id_expr} AS _id, upper(coalesce(concept, '')) AS cu, {_norm_sql('concept')} AS cn,
         trim(coalesce(concept, '')) = '' AS blank,
         greatest(abs(coalesce(debit, 0)), abs(coalesce(credit, 0))) AS amt
  FROM {src}
),
hits AS (
  SELECT m._id, r.ord, r.category, r.subcategory, r.origin, r.kind,
         row_number() OVER (PARTITION BY m._id ORDER BY r.priority) AS rn
  FROM cm m JOIN rk r ON NOT m.blank AND (r.pattern = '' OR contains(m.cu, r.pattern) OR contains(m.cn, r.pattern))
       AND (r.lo IS NULL OR m.amt >= r.lo) AND (r.hi IS NULL OR m.amt <= r.hi)
),
cls AS (
  SELECT m.*, h.ord AS rule_ord, coalesce(h.category, 'Sin clasificar') AS new_category,
         coalesce(h.subcategory, '') AS new_subcategory, coalesce(h.origin, '') AS new_origin,
         coalesce(h.kind, '') AS new_kind
  FROM cm m LEFT JOIN hits h ON h._id = m._id AND h.rn = 1
)"""


_CLS_SELECT = "SELECT ledger_id, row_id, cast(rule_ord AS bigint) AS rule_ord, new_category, new_subcategory, new_origin, new_kind FROM cls"

ORACLE.update({
    "load_rules": q(_rules_cte(), select="""
SELECT priority, cast(ord AS bigint) AS ord, pattern, cast(lo AS double) AS lo, cast(hi AS double) AS hi, category,
       subcategory, origin, kind, cast(spec AS bigint) AS spec, cast(outs AS bigint) AS outs FROM rk"""),
    "classify": q(_rules_cte(), select=_CLS_SELECT),
    "classify_join": q(_rules_cte(), select=_CLS_SELECT),
    "classify_distinct": q(_rules_cte(), select=_CLS_SELECT),
    "rule_coverage": q(_rules_cte(), select=f"""
SELECT count(*) AS total, count(*) FILTER (WHERE new_category <> 'Sin clasificar') AS classified,
       count(*) FILTER (WHERE new_category = 'Sin clasificar') AS unclassified,
       CASE WHEN count(*) > 0 THEN {_round_ratio("(count(*) FILTER (WHERE new_category <> 'Sin clasificar')) * 10000", 'count(*)')} END
         AS pct_classified
FROM cls"""),
    "category_distribution": q(_rules_cte(), select="SELECT new_category AS category, count(*) AS n FROM cls GROUP BY 1"),
    "top_unclassified": q(_rules_cte(False, "AND pattern NOT IN ('RED', 'BLUE')"), select="""
SELECT concept, n, row_number() OVER (ORDER BY n DESC, concept) AS rank FROM (
  SELECT upper(trim(concept)) AS concept, count(*) AS n FROM cls WHERE new_category = 'Sin clasificar' GROUP BY 1
  ORDER BY n DESC, concept LIMIT 10)"""),
    "rule_specificity": q(_rules_cte(), select="SELECT cast(spec AS bigint) AS spec, count(*) AS n_rules FROM rk GROUP BY 1"),
    "abs_amount": q(select="""
SELECT row_id, cast(greatest(abs(coalesce(debit, 0)), abs(coalesce(credit, 0))) AS double) AS abs_amount FROM movements"""),
})


# ---- imports ------------------------------------------------------------------------------------

INCOMING = f"""
inc0 AS (SELECT * FROM base_rows WHERE date >= DATE '{adapter.INCOMING_FROM}'),
incoming AS (
  SELECT ledger_id, row_id, 0 AS copy_no, cast(_linenumber % 3 AS integer) AS file_no, date, concept, debit, credit,
         bank_balance, 'OP ' || row_id AS reference FROM inc0
  UNION ALL
  SELECT ledger_id, row_id, 1 AS copy_no, cast(_linenumber % 3 AS integer) AS file_no, date, concept, debit, credit,
         bank_balance, 'OP ' || row_id AS reference FROM inc0 WHERE _quantity = 1
),
old_ledger AS (SELECT * FROM movements WHERE date < DATE '{adapter.LEDGER_BEFORE}'),
old_keys AS (
  SELECT DISTINCT ledger_id, date AS kd, upper(trim(coalesce(concept, ''))) AS kc, coalesce(debit, 0) AS kdb,
         coalesce(credit, 0) AS kcr FROM old_ledger
)"""


def _keyed(src: str) -> str:
    return (f"(SELECT *, date AS kd, upper(trim(coalesce(concept, ''))) AS kc, coalesce(debit, 0) AS kdb, "
            f"coalesce(credit, 0) AS kcr FROM {src})")


def _anti(src: str) -> str:
    return (f"(SELECT * FROM {_keyed(src)} i WHERE NOT EXISTS (SELECT 1 FROM old_keys o WHERE o.ledger_id = i.ledger_id "
            "AND o.kd = i.kd AND o.kc = i.kc AND o.kdb = i.kdb AND o.kcr = i.kcr))")


def _first_file(src: str) -> str:
    return (f"(SELECT * EXCLUDE (ff) FROM (SELECT *, min(file_no) OVER (PARTITION BY ledger_id, kd, kc, kdb, kcr) AS ff "
            f"FROM {_keyed(src)}) WHERE file_no = ff)")


IMPORTED = """
stmts AS (
  SELECT * REPLACE (trim(coalesce(concept, '')) AS concept) FROM incoming
  WHERE date IS NOT NULL AND upper(trim(coalesce(concept, ''))) NOT IN ('SALDO ANTERIOR', 'SALDO FINAL', 'SALDO INICIAL', 'TOTAL')
),
fresh AS (SELECT * EXCLUDE (kd, kc, kdb, kcr) FROM {anti})
"""

_IMPORT_ROWS = """
SELECT ledger_id, row_id, 'import-1' AS batch_id, new_kind AS kind, new_origin AS origin, new_category AS category,
       new_subcategory AS subcategory, cast(date AS varchar) AS date, concept,
       cast(CASE WHEN debit > 0 THEN debit END AS double) AS debit,
       cast(CASE WHEN credit > 0 THEN credit END AS double) AS credit,
       cast(CASE WHEN bank_balance <> 0 THEN bank_balance END AS double) AS bank_balance,
       new_category = 'Sin clasificar' AS review{extra}
FROM cls"""


def _imported_ctes() -> list[str]:
    fresh = IMPORTED.format(anti=_anti(f"(SELECT * EXCLUDE (kd, kc, kdb, kcr) FROM {_first_file('stmts')})"))
    return [INCOMING, fresh, _rules_cte(src="fresh", id_expr="row_id || '#' || cast(copy_no AS varchar)")]


ORACLE.update({
    "movement_key": q(select="""
SELECT row_id, substr(md5(concat_ws('|', cast(date AS varchar), upper(trim(coalesce(concept, ''))),
       cast(coalesce(debit, 0) AS varchar), cast(coalesce(credit, 0) AS varchar))), 1, 12) AS movement_key
FROM movements"""),
    "new_movements": q(INCOMING, select=f"SELECT ledger_id, row_id, cast(copy_no AS bigint) AS copy_no, cast(file_no AS bigint) AS file_no FROM {_anti('incoming')}"),
    "first_file_wins": q(INCOMING, select=f"SELECT ledger_id, row_id, cast(copy_no AS bigint) AS copy_no, cast(file_no AS bigint) AS file_no FROM {_first_file('incoming')}"),
    "import_statements": q(*_imported_ctes(), select=_IMPORT_ROWS.format(extra=", reference, '' AS destination")),
    "append_movements": q(*_imported_ctes(), select=_IMPORT_ROWS.format(extra=", reference, '' AS destination")),
    "import_summary": q(*_imported_ctes(), select="""
, per_file AS (
  SELECT r.file_no, r.n_read, coalesce(a.n_new, 0) AS n_new, coalesce(a.n_classified, 0) AS n_classified,
         coalesce(a.n_review, 0) AS n_review
  FROM (SELECT file_no, count(*) AS n_read FROM incoming GROUP BY 1) r
  LEFT JOIN (SELECT file_no, count(*) AS n_new, count(*) FILTER (WHERE new_category <> 'Sin clasificar') AS n_classified,
                    count(*) FILTER (WHERE new_category = 'Sin clasificar') AS n_review FROM cls GROUP BY 1) a USING (file_no)
)
SELECT cast(file_no AS bigint) AS file_no, cast(sum(n_read) AS bigint) AS n_read, cast(sum(n_new) AS bigint) AS n_new,
       cast(sum(n_classified) AS bigint) AS n_classified, cast(sum(n_review) AS bigint) AS n_review,
       sum(n_review) > 0 AS alert
FROM per_file GROUP BY ROLLUP (file_no)"""),
    "new_since": q(select="""
SELECT ledger_id, row_id, batch_id FROM movements m
WHERE batch_id = (SELECT max(batch_id) FROM movements x WHERE x.ledger_id = m.ledger_id)"""),
})


# ---- mining, migration, maintenance -------------------------------------------------------------

from ledgerline.constants import KINDS, MINING_STOP_WORDS, ORIGINS  # noqa: E402


def _tokens_sql(norm: str) -> str:
    return (f"list_filter(string_split({norm}, ' '), lambda t: length(t) >= 3 AND NOT list_contains([{_list(MINING_STOP_WORDS)}], t))")


MINING = f"""
mrows AS (
  SELECT ledger_id, row_id, date, concept,
         CASE WHEN subcategory <> '' THEN upper(substr(subcategory, 1, 1)) || lower(substr(subcategory, 2)) ELSE category END AS label
  FROM base_rows
),
mr AS (SELECT *, {_norm_sql('concept')} AS norm, {_tokens_sql(_norm_sql('concept'))} AS tokens FROM mrows WHERE label <> ''),
tk AS (SELECT row_id, label, unnest(list_distinct(tokens)) AS pattern FROM mr),
tper AS (SELECT pattern, label, count(*) AS n FROM tk GROUP BY ALL),
ttok AS (SELECT pattern, sum(n) AS total, max(n) AS dom, first(label ORDER BY n DESC, label DESC) AS label FROM tper GROUP BY pattern),
pats AS (
  SELECT pattern, label, dom AS matches, total, {_round_ratio('dom * 100', 'total')} AS purity
  FROM ttok WHERE total >= 3 AND dom * 100 >= total * 85
),
unm AS (
  SELECT * FROM mr WHERE row_id NOT IN (
    SELECT row_id FROM (SELECT row_id, unnest(tokens) AS t FROM mr) WHERE t IN (SELECT pattern FROM pats))
),
usum AS (
  SELECT substr(norm, 1, 60) AS norm_concept, cast(sum(n) AS bigint) AS occurrences,
         first(label ORDER BY n DESC, label ASC) AS top_label, substr(arg_min(ex, id), 1, 55) AS example
  FROM (SELECT norm, label, count(*) AS n, arg_min(concept, row_id) AS ex, min(row_id) AS id FROM unm GROUP BY norm, label)
  GROUP BY norm
),
allr AS (SELECT row_id, concept, {_norm_sql('concept')} AS norm FROM movements),
pex AS (
  SELECT p.pattern, coalesce(substr(arg_min(a.concept, a.row_id), 1, 55), '') AS example
  FROM pats p LEFT JOIN allr a ON contains(a.norm, p.pattern) GROUP BY p.pattern
),
props AS (
  SELECT DISTINCT upper(w) AS pattern, 'Compras' AS category, upper(substr(w, 1, 1)) || lower(substr(w, 2)) AS subcategory,
         CASE WHEN w = 'gizmo' THEN 'revisar' ELSE '' END AS note
  FROM (SELECT split_part(p_name, ' ', 2) AS w FROM part) WHERE w NOT IN ('ring', 'bolt')
),
rrp AS (
  SELECT p.pattern, p.label, p.matches, p.total, p.purity, e.example,
         coalesce(pr.category, '') AS proposed_category, coalesce(pr.subcategory, '') AS proposed_subcategory,
         coalesce(pr.note, '') AS note
  FROM pats p LEFT JOIN pex e USING (pattern) LEFT JOIN props pr ON pr.pattern = p.pattern
),
rru AS (
  SELECT u.*, coalesce(pr.category, '') AS proposed_category, coalesce(pr.subcategory, '') AS proposed_subcategory
  FROM usum u LEFT JOIN props pr ON pr.pattern = upper(u.top_label)
),
urules AS (
  SELECT trim(pattern) AS pattern, cast(NULL AS double) AS lo, cast(NULL AS double) AS hi, trim(category) AS category,
         trim(coalesce(subcategory, '')) AS subcategory, '' AS origin, '' AS kind
  FROM (SELECT pattern, proposed_category AS category, proposed_subcategory AS subcategory FROM rrp
        UNION ALL SELECT norm_concept, proposed_category, proposed_subcategory FROM rru)
  WHERE trim(coalesce(category, '')) <> ''
)"""

RECODE = """
recode AS (SELECT * FROM (VALUES ('ECONOMY', 'Supermercado', ''), ('SMALL', 'Servicios', 'Agua'),
  ('MEDIUM', 'Salud', 'Farmacia'), ('PROMO', 'Otros ingresos', NULL), ('STANDARD', 'No va', '')) v(old, new, sub)),
legacy AS (
  SELECT ledger_id, row_id,
         CASE WHEN _linenumber = 7 AND _linestatus = 'F' THEN 'Saldo Inicial' WHEN _linenumber = 7 THEN 'Saldo Final'
              ELSE kind END AS kind,
         origin, CASE WHEN _ptype = 'LARGE' AND _linestatus = 'O' THEN '' ELSE _ptype END AS label,
         subcategory AS label2, date, concept, debit, credit, bank_balance
  FROM base_rows
)"""

REBUILD_SRC = f"""
lg AS (
  SELECT ledger_id, row_id, {_clean('kind')} AS kind, {_clean('origin')} AS origin, {_clean('label')} AS label,
         {_clean('label2')} AS label2, date, concept, debit, credit, bank_balance
  FROM legacy WHERE date IS NOT NULL AND year(date) >= {adapter.FIRST_YEAR} AND trim(coalesce(kind, '')) NOT IN ('Saldo Inicial', 'Saldo Final')
)"""

REBUILT = f"""
rebuilt AS (
  SELECT c.ledger_id, c.row_id, c.kind, c.origin,
    CASE WHEN year(c.date) >= {adapter.CUTOVER_YEAR} AND r.old IS NOT NULL THEN r.new
         WHEN year(c.date) >= {adapter.CUTOVER_YEAR} AND c.label = '' THEN c.new_category ELSE c.label END AS category,
    CASE WHEN year(c.date) >= {adapter.CUTOVER_YEAR} AND r.old IS NOT NULL
           THEN CASE WHEN coalesce(r.sub, '') <> '' THEN r.sub ELSE c.label2 END
         WHEN year(c.date) >= {adapter.CUTOVER_YEAR} AND c.label = '' THEN c.new_subcategory ELSE c.label2 END AS subcategory,
    c.date, c.concept, c.debit, c.credit, c.bank_balance,
    year(c.date) >= {adapter.CUTOVER_YEAR} AND c.label = '' AND c.new_category = 'Sin clasificar' AS review
  FROM cls c LEFT JOIN recode r ON r.old = c.label
),
taxo AS (SELECT DISTINCT category, subcategory FROM movements WHERE category <> '')"""

RECLASS_SRC = f"""
rsrc AS (
  SELECT ledger_id, row_id, date, {_clean('concept')} AS concept, debit, credit,
         {_clean('category')} AS old_category, {_clean('subcategory')} AS old_subcategory,
         {_clean('origin')} AS old_origin, {_clean('kind')} AS old_kind
  FROM movements WHERE year(date) >= {adapter.CUTOVER_YEAR}
)"""

RECLASSIFIED = """
rcl AS (
  SELECT *, new_category <> 'Sin clasificar' AS matched,
         new_category <> 'Sin clasificar' AND old_category <> new_category AS category_changed,
         new_category <> 'Sin clasificar' AND new_subcategory <> '' AND old_subcategory <> new_subcategory AS subcategory_changed,
         new_category <> 'Sin clasificar' AND new_origin <> '' AND old_origin <> new_origin AS origin_changed,
         new_category <> 'Sin clasificar' AND new_kind <> '' AND old_kind <> new_kind AS kind_changed
  FROM cls
),
rcl2 AS (
  SELECT *, CASE WHEN category_changed THEN new_category ELSE old_category END AS category,
         CASE WHEN subcategory_changed THEN new_subcategory ELSE old_subcategory END AS subcategory,
         CASE WHEN origin_changed THEN new_origin ELSE old_origin END AS origin,
         CASE WHEN kind_changed THEN new_kind ELSE old_kind END AS kind
  FROM rcl
)"""

_RULE_REVIEW_P = ("SELECT pattern, label, matches, total, purity, example, proposed_category, proposed_subcategory, note, "
                  "row_number() OVER (ORDER BY matches DESC, pattern) AS ord FROM rrp")

ORACLE.update({
    "mine_patterns": q(MINING, select="SELECT pattern, label, matches, total, purity FROM pats"),
    "unmatched_concepts": q(MINING, select="SELECT ledger_id, row_id, norm FROM unm"),
    "unmatched_summary": q(MINING, select="SELECT norm_concept, occurrences, top_label, example FROM usum"),
    "pattern_example": q(MINING, select="SELECT pattern, example FROM pex"),
    "propose_categories": q(MINING, select="""
SELECT p.pattern, p.label, p.matches, p.total, p.purity, coalesce(pr.category, '') AS proposed_category,
       coalesce(pr.subcategory, '') AS proposed_subcategory, coalesce(pr.note, '') AS note
FROM pats p LEFT JOIN props pr USING (pattern)"""),
    "rule_review_patterns": q(MINING, select=_RULE_REVIEW_P),
    "rule_review_unmatched": q(MINING, select="SELECT *, row_number() OVER (ORDER BY occurrences DESC, norm_concept, example) AS ord FROM rru"),
    "union_rules": q(MINING, select="SELECT * FROM urules"),
    "migrate_rules": q(MINING, select="""
SELECT *, row_number() OVER (ORDER BY category, length(pattern) DESC, pattern, subcategory) AS ord FROM urules"""),
    "flat_subcategories": q(select=f"""
SELECT DISTINCT subcategory,
       (SELECT count(DISTINCT category) FROM movements WHERE category <> '') AS n_categories
FROM movements WHERE category <> '' AND subcategory <> ''"""),
    "recode_any_year": q(RECODE, select="""
SELECT l.row_id, CASE WHEN r.old IS NOT NULL THEN r.new ELSE l.label END AS category,
  CASE WHEN coalesce(l.label2, '') = '' THEN coalesce(r.sub, '') ELSE l.label2 END AS subcategory
FROM legacy l LEFT JOIN recode r ON r.old = l.label"""),
    "recode_category": q(RECODE, select=f"""
SELECT l.row_id,
  CASE WHEN r.old IS NOT NULL AND year(l.date) < {adapter.CUTOVER_YEAR} THEN r.new ELSE l.label END AS category,
  CASE WHEN r.old IS NOT NULL AND year(l.date) < {adapter.CUTOVER_YEAR} AND coalesce(r.sub, '') <> '' AND coalesce(l.label2, '') = ''
       THEN r.sub ELSE coalesce(l.label2, '') END AS subcategory
FROM legacy l LEFT JOIN recode r ON r.old = l.label"""),
    "recode_rebuild": q(RECODE, select="""
SELECT l.row_id, CASE WHEN r.old IS NOT NULL THEN r.new ELSE l.label END AS category,
  CASE WHEN r.old IS NOT NULL AND coalesce(r.sub, '') <> '' THEN r.sub ELSE coalesce(l.label2, '') END AS subcategory
FROM legacy l LEFT JOIN recode r ON r.old = l.label"""),
    "reclassify": q(RECLASS_SRC, _rules_cte(src="rsrc"), RECLASSIFIED, select="""
SELECT ledger_id, row_id, matched, category, subcategory, origin, kind, old_category, old_subcategory, old_origin,
       old_kind, category_changed, subcategory_changed, origin_changed, kind_changed FROM rcl2"""),
    "change_counts": q(RECLASS_SRC, _rules_cte(src="rsrc"), RECLASSIFIED, select="""
SELECT count(*) AS rows_seen, count(*) FILTER (WHERE matched) AS matched, count(*) FILTER (WHERE NOT matched) AS untouched,
       count(*) FILTER (WHERE category_changed) AS category_changed, count(*) FILTER (WHERE subcategory_changed) AS subcategory_changed,
       count(*) FILTER (WHERE origin_changed) AS origin_changed, count(*) FILTER (WHERE kind_changed) AS kind_changed
FROM rcl2"""),
    "change_log": q(RECLASS_SRC, _rules_cte(src="rsrc"), RECLASSIFIED, select="""
SELECT ledger_id, row_id, 'category' AS field, old_category AS old_value, category AS new_value FROM rcl2 WHERE category_changed
UNION ALL SELECT ledger_id, row_id, 'subcategory', old_subcategory, subcategory FROM rcl2 WHERE subcategory_changed
UNION ALL SELECT ledger_id, row_id, 'origin', old_origin, origin FROM rcl2 WHERE origin_changed
UNION ALL SELECT ledger_id, row_id, 'kind', old_kind, kind FROM rcl2 WHERE kind_changed"""),
    "reclassified_ledger": q(RECLASS_SRC, _rules_cte(src="rsrc"), RECLASSIFIED, select=f"""
SELECT ledger_id, row_id, cast(date AS varchar) AS date, concept, {_d('debit', 'debit')}, {_d('credit', 'credit')},
       category, subcategory, origin, kind
FROM movements WHERE year(date) < {adapter.CUTOVER_YEAR}
UNION ALL
SELECT ledger_id, row_id, cast(date AS varchar), concept, {_d('debit', 'debit')}, {_d('credit', 'credit')}, category, subcategory, origin, kind
FROM rcl2"""),
    "change_examples": q(RECLASS_SRC, _rules_cte(src="rsrc"), RECLASSIFIED, select="""
SELECT ledger_id, row_id, cast(date AS varchar) AS date, substr(concept, 1, 35) AS concept, concat_ws('; ',
         CASE WHEN category_changed THEN 'category: ' || chr(39) || old_category || chr(39) || ' -> ' || chr(39) || category || chr(39) END,
         CASE WHEN subcategory_changed THEN 'subcategory: ' || chr(39) || old_subcategory || chr(39) || ' -> ' || chr(39) || subcategory || chr(39) END,
         CASE WHEN origin_changed THEN 'origin: ' || chr(39) || old_origin || chr(39) || ' -> ' || chr(39) || origin || chr(39) END,
         CASE WHEN kind_changed THEN 'kind: ' || chr(39) || old_kind || chr(39) || ' -> ' || chr(39) || kind || chr(39) END) AS changes
FROM rcl2 WHERE category_changed OR subcategory_changed OR origin_changed OR kind_changed ORDER BY rcl2.date, row_id LIMIT 15"""),
    "rebuild_ledger": q(RECODE, REBUILD_SRC, _rules_cte(src="lg"), REBUILT, select="""
SELECT ledger_id, row_id, kind, origin, category, subcategory, cast(date AS varchar) AS date, concept,
       cast(debit AS double) AS debit, cast(credit AS double) AS credit, cast(bank_balance AS double) AS bank_balance, review,
       'REF ' || row_id AS reference, '' AS destination
FROM rebuilt"""),
    "write_rule_review": q(MINING, select="""
SELECT 'patterns' AS sheet, pattern AS key FROM rrp UNION ALL SELECT 'unmatched', norm_concept FROM rru
UNION ALL SELECT 'categories', category FROM (SELECT DISTINCT category FROM movements WHERE category <> '')"""),
    "invalid_labels": q(RECODE, REBUILD_SRC, _rules_cte(src="lg"), REBUILT, select=f"""
SELECT * FROM (
  SELECT ledger_id, row_id,
    category <> '' AND category NOT IN (SELECT category FROM taxo) AS bad_category,
    subcategory <> '' AND subcategory NOT IN (SELECT subcategory FROM taxo WHERE subcategory <> '') AS bad_subcategory,
    origin <> '' AND origin NOT IN ({_list(ORIGINS)}) AS bad_origin,
    kind <> '' AND kind NOT IN ({_list(KINDS)}) AS bad_kind
  FROM rebuilt)
WHERE bad_category OR bad_subcategory OR bad_origin OR bad_kind"""),
})


# ---- sources and scalar functions -------------------------------------------------------------

from ledgerline.constants import MODEL_STOP_WORDS, NEEDS_LABEL_TEXTS, TRAINING_EXCLUDED  # noqa: E402

TEXTS = """
tx0 AS (SELECT row_id, _linenumber % 4 AS form, _linenumber % 7 AS spelled, coalesce(debit, credit) AS amt, date FROM base_rows),
texts AS (
  SELECT row_id,
    CASE form WHEN 0 THEN cast(amt AS varchar)
              WHEN 1 THEN '$ ' || replace(cast(amt AS varchar), '.', ',')
              WHEN 2 THEN '-' || cast(amt AS varchar)
              ELSE CASE WHEN amt >= 1000 THEN cast(cast(amt * 100 AS bigint) // 100000 AS varchar) || '.' ||
                        lpad(cast((cast(amt * 100 AS bigint) // 100) % 1000 AS varchar), 3, '0') || ',' ||
                        lpad(cast(cast(amt * 100 AS bigint) % 100 AS varchar), 2, '0') ELSE '' END END AS amount_text,
    CASE spelled WHEN 0 THEN strftime(date, '%-d/%-m/%Y')
              WHEN 1 THEN cast(date_diff('day', DATE '1899-12-30', date) AS varchar)
              WHEN 2 THEN cast(date_diff('day', DATE '1899-12-30', date) AS varchar) || '.75'
              WHEN 3 THEN strftime(date, '%Y-%m-%d')
              WHEN 4 THEN strftime(date, '%d/%m/%y')
              WHEN 5 THEN chr(160) || strftime(date, '%Y-%m-%d') || ' 00:00:00'
              ELSE strftime(date, '%Y/%m/%d') || ' 10:15' END AS date_text,
    amt, date AS true_date
  FROM tx0
)"""


def _p3(t: str) -> str:
    k = f"replace(regexp_replace(coalesce({t}, ''), '[^0-9,.]', '', 'g'), ',', '.')"
    return f"CASE WHEN {k} = '' THEN 0 ELSE try_cast({k} AS decimal(18,2)) END"


def _p4(t: str) -> str:
    k = f"replace(replace(trim(coalesce({t}, '')), '.', ''), ',', '.')"
    return f"coalesce(try_cast({k} AS decimal(18,2)), 0)"


def _model_tokens(x: str) -> str:
    n = _norm_sql(x)
    return (f"array_to_string(list_filter(string_split({n}, ' '), lambda t: length(t) >= 3 AND NOT "
            f"list_contains([{_list(MODEL_STOP_WORDS)}], t)), ' ')")


ORACLE.update({
    "read_statements": q(INCOMING, select="""
SELECT ledger_id, cast(file_no AS bigint) AS file_no, cast(date AS varchar) AS date, concept, substr(row_id, 14, 2) = '05' AND (cast(ledger_id AS integer) + file_no) % 4 <> 3 AS several_lines,
       cast(coalesce(debit, 0) AS double) AS debit, cast(coalesce(credit, 0) AS double) AS credit,
       cast(coalesce(bank_balance, 0) AS double) AS balance, reference FROM incoming"""),
    "parse_bank_amount": q(TEXTS, select=f"SELECT row_id, amount_text, cast({_p3('amount_text')} AS double) AS amount FROM texts"),
    "parse_amount_es": q(TEXTS, select=f"SELECT row_id, amount_text, cast({_p4('amount_text')} AS double) AS amount, "
                         "cast(amt AS double) AS from_decimal, cast(amt AS double) AS from_double FROM texts"),
    # every spelling is one the reader accepts: the date it was written from comes back
    "parse_date": q(TEXTS, select="SELECT row_id, date_text, cast(true_date AS varchar) AS date FROM texts"),
    "read_ledger": q(select=f"""
SELECT ledger_id, row_id, cast(date AS varchar) AS date, month, kind, origin, category, subcategory, concept,
       {_d('debit', 'debit')}, {_d('credit', 'credit')}, {_d('bank_balance', 'bank_balance')}, {_d('amount', 'amount')} FROM led"""),
    "norm_header": q(select="""
SELECT p_partkey, regexp_replace(translate(lower(trim(concat_ws(' ', p_name, p_brand))), 'áéíóú', 'aeiou'), '[^a-z0-9]', '', 'g') AS norm
FROM part"""),
    "norm_concept": q(select="SELECT row_id, " + _norm_sql(
        "CASE WHEN substr(row_id, 14, 2) IN ('02', '04', '06') THEN replace(concept, ' ', chr(160)) ELSE concept END")
        + " AS norm FROM movements"),
    "tokens": q(select=f"SELECT row_id, array_to_string({_tokens_sql(_norm_sql('concept'))}, ' ') AS tokens FROM movements"),
    "signed_amount": q(select="SELECT row_id, cast(coalesce(credit, 0) - coalesce(debit, 0) AS double) AS amount FROM movements"),
    "month_labels": q(select=f"SELECT month, {label('month')} AS label FROM (SELECT DISTINCT strftime(date, '%Y-%m') AS month FROM movements)"),
    "clean_text": q(RECODE, select=f"""
SELECT row_id, {_clean("CASE WHEN label = '' THEN 'nan' WHEN label = 'PROMO' THEN ' None ' ELSE ' ' || label END")} AS label
FROM legacy"""),
    "model_text": q(select="SELECT row_id, " + _model_tokens("concat_ws(' ', concept, reference, destination, origin)")
                    + " AS text FROM movements"),
    "truncate_concept": q(select="SELECT row_id, substr(concept, 1, 20) AS short FROM movements"),
    "drop_balance_lines": q(INCOMING, select="SELECT DISTINCT ledger_id, cast(file_no AS bigint) AS file_no, cast(1 AS bigint) AS balance_lines FROM incoming"),
    "drop_marker_kinds": q(RECODE, select="""
SELECT row_id, kind FROM legacy WHERE trim(coalesce(kind, '')) NOT IN ('Saldo Inicial', 'Saldo Final')"""),
    "card_subset": q(select="SELECT row_id, origin FROM movements WHERE coalesce(contains(lower(origin), 'tarjeta'), false)"),
    "needs_label": q(RECODE, select=f"""
SELECT row_id, label FROM legacy WHERE trim(coalesce(label, '')) = '' OR upper(trim(coalesce(label, ''))) IN ({_list(NEEDS_LABEL_TEXTS)})"""),
    "training_rows": q(select=f"""
SELECT category, count(*) AS n FROM movements
WHERE trim(coalesce(category, '')) <> '' AND trim(coalesce(category, '')) NOT IN ({_list(TRAINING_EXCLUDED)})
  AND upper(trim(coalesce(category, ''))) NOT IN ({_list(NEEDS_LABEL_TEXTS)})
GROUP BY category"""),
    "from_year": q(select=f"SELECT ledger_id, count(*) AS n FROM movements WHERE year(date) >= {adapter.CUTOVER_YEAR} GROUP BY 1"),
})


# ---- outputs and streaming ---------------------------------------------------------------------

ORACLE.update({
    "map_columns": q(INCOMING, select="""
SELECT f.ledger_id, cast(f.file_no AS bigint) AS file_no, v.field,
       cast((v.pos - (cast(f.ledger_id AS integer) + f.file_no) % 4 + 6) % 6 AS bigint) AS pos
FROM (SELECT DISTINCT ledger_id, file_no FROM incoming) f
CROSS JOIN (VALUES ('date', 0), ('concept', 1), ('debit', 2), ('credit', 3), ('balance', 4), ('reference', 5)) v(field, pos)"""),
    "import_stream": q(*_imported_ctes(), select="""
SELECT ledger_id, reference, new_kind AS kind, new_origin AS origin, new_category AS category,
       new_subcategory AS subcategory, cast(date AS varchar) AS date, concept,
       cast(CASE WHEN debit > 0 THEN debit END AS double) AS debit,
       cast(CASE WHEN credit > 0 THEN credit END AS double) AS credit,
       cast(CASE WHEN bank_balance <> 0 THEN bank_balance END AS double) AS bank_balance,
       new_category = 'Sin clasificar' AS review
FROM cls"""),
    "refresh_months": q(*_imported_ctes(), select=f"""
, after AS (
  SELECT ledger_id, date, kind, category, debit, credit FROM old_ledger
  UNION ALL SELECT ledger_id, date, new_kind, new_category, CASE WHEN debit > 0 THEN debit END,
                   CASE WHEN credit > 0 THEN credit END FROM cls
), al AS (
  SELECT ledger_id, strftime(date, '%Y-%m') AS month,
         CASE WHEN {_clean('category')} = '' THEN 'Sin clasificar' ELSE {_clean('category')} END AS category,
         {_clean('kind')} AS kind, coalesce(credit, 0) - coalesce(debit, 0) AS amount
  FROM after WHERE date IS NOT NULL AND year(date) >= {adapter.FIRST_YEAR}
), af AS (
  SELECT *, CASE WHEN category IN ({_list(DEFAULT_SYSTEM_CATEGORIES)}) THEN NULL
                 WHEN kind = 'Ingresos' OR (kind = '' AND category IN ({_list(DEFAULT_INCOME_CATEGORIES)})) THEN 'income'
                 WHEN category <> '' THEN 'expense' END AS flow
  FROM al
)
SELECT ledger_id, month, cast(coalesce(-sum(CASE WHEN flow = 'expense' THEN amount END), 0) AS double) AS expense_total,
       cast(coalesce(sum(CASE WHEN flow = 'income' THEN amount END), 0) AS double) AS income_total,
       {label('month')} AS label
FROM af GROUP BY ledger_id, month"""),
})


# ---- labeller (naive Bayes) --------------------------------------------------------------------

def _model_token_list(x: str) -> str:
    n = _norm_sql(x)
    return (f"list_filter(string_split({n}, ' '), lambda t: length(t) >= 3 AND NOT "
            f"list_contains([{_list(MODEL_STOP_WORDS)}], t))")


_F8 = (f"trim(coalesce(category, '')) <> '' AND trim(coalesce(category, '')) NOT IN ({_list(TRAINING_EXCLUDED)}) "
       f"AND upper(trim(coalesce(category, ''))) NOT IN ({_list(NEEDS_LABEL_TEXTS)})")
_F7 = f"trim(coalesce(category, '')) = '' OR upper(trim(coalesce(category, ''))) IN ({_list(NEEDS_LABEL_TEXTS)})"

ORACLE.update({
    "nb_labeller": q(select=f"""
, mt0 AS (SELECT row_id, category, {_model_token_list("concat_ws(' ', concept, reference, destination, origin)")} AS toks FROM movements),
train AS (SELECT category AS c, toks FROM mt0 WHERE {_F8}),
pred AS (SELECT row_id, toks FROM mt0 WHERE {_F7}),
tt AS (SELECT c, unnest(toks) AS t FROM train),
cnt AS (SELECT c, t, count(*) AS n FROM tt GROUP BY ALL),
vocab AS (SELECT DISTINCT t FROM cnt),
ncls AS (SELECT d.c, d.docs, coalesce(k.tok, 0) AS tok
         FROM (SELECT c, count(*) AS docs FROM train GROUP BY 1) d LEFT JOIN (SELECT c, count(*) AS tok FROM tt GROUP BY 1) k USING (c)),
pt AS (SELECT row_id, unnest(toks) AS t FROM pred),
known AS (SELECT * FROM pt WHERE t IN (SELECT t FROM vocab)),
kk AS (SELECT row_id, count(*) AS k FROM known GROUP BY 1),
sp AS (SELECT kn.row_id, cn.c, sum(ln(cn.n + 1)) AS s FROM known kn JOIN cnt cn USING (t) GROUP BY ALL),
sc AS (
  SELECT p.row_id, c.c,
         ln(c.docs / (SELECT sum(docs) FROM ncls)) + coalesce(kk.k, 0) * -ln(c.tok + (SELECT count(*) FROM vocab))
         + coalesce(sp.s, 0.0) AS score
  FROM pred p CROSS JOIN ncls c LEFT JOIN kk USING (row_id) LEFT JOIN sp ON sp.row_id = p.row_id AND sp.c = c.c
),
top AS (SELECT row_id, first(c ORDER BY score DESC, c ASC) AS suggestion, max(score) AS mx FROM sc GROUP BY 1),
conf AS (SELECT t.row_id, t.suggestion, round(1.0 / sum(exp(s.score - t.mx)), 4) AS confidence
         FROM top t JOIN sc s USING (row_id) GROUP BY t.row_id, t.suggestion)
SELECT row_id, suggestion, confidence, confidence < 0.82 AS review FROM conf"""),
})

ORACLE["statement_rejects"] = q(INCOMING, select="""
SELECT DISTINCT ledger_id, cast(file_no AS bigint) AS file_no, v.reason, v.line
FROM incoming, (VALUES ('unreadable date', 'COMPRA SIN FECHA'), ('unreadable amount', 'COMPRA SIN MONTO')) v(reason, line)""")

ORACLE["statement_outcomes"] = q(INCOMING, select="""
SELECT ledger_id, cast(file_no AS bigint) AS file_no, count(*) + 3 AS n_lines, count(*) AS n_rows, 1 AS n_balance, 2 AS n_rejects
FROM incoming GROUP BY ledger_id, file_no""")

ORACLE["category_reference"] = q(select=f"""
SELECT category, coalesce(array_to_string(list_sort(list(DISTINCT subcategory) FILTER (WHERE subcategory <> '')), ', '), '')
       AS subcategories
FROM movements WHERE category <> '' GROUP BY category""")

_CARD = "(SELECT * FROM fl WHERE coalesce(contains(lower(origin), 'tarjeta'), false))"
_CARD_CROSS = CROSS.format(src=_CARD)
for _old, _new in (("xb", "yb"), ("xm", "ym"), ("xf", "yf"), ("x_", "y_"), ("xt", "yt")):        # the same tables under other names
    _CARD_CROSS = _CARD_CROSS.replace(_old, _new)
ORACLE["document_values"] = q(MONTHS, RUNNING, CAT_TOTALS, LAST12, TOPCAT, GROUPS, BANK, CROSS.format(src="fl"), _CARD_CROSS, select=f"""
SELECT ledger_id, 'months' AS section, 'expense_total' AS key, month, {_d('expense_total', 'value')} FROM mt
UNION ALL SELECT ledger_id, 'months', 'income_total', month, {_d('income_total', 'value')} FROM mt
UNION ALL SELECT ledger_id, 'cross', 'closing', month, {_d('closing', 'value')} FROM rb
UNION ALL SELECT ledger_id, 'cross', 'opening', month, {_d('closing - net', 'value')} FROM rb
UNION ALL SELECT ledger_id, 'cross', 'unclassified', month, {_d("-coalesce(sum(CASE WHEN category = 'Sin clasificar' THEN amount END), 0)", 'value')}
          FROM led GROUP BY ledger_id, month
UNION ALL SELECT ledger_id, 'cross', section || '_total', month, {_d('value', 'value')} FROM xt WHERE level = 'section'
UNION ALL SELECT ledger_id, 'card', section || '_total', month, {_d('value', 'value')} FROM yt WHERE level = 'section'
UNION ALL SELECT ledger_id, 'history', 'expense', month, {_d('expense_total', 'value')} FROM mt
UNION ALL SELECT ledger_id, 'history', 'income', month, {_d('income_total', 'value')} FROM mt
UNION ALL SELECT t.ledger_id, 'history by category', t.category, m.month, {_d('coalesce(c.total, 0)', 'value')}
          FROM tc t JOIN mt m ON m.ledger_id = t.ledger_id
          LEFT JOIN ct c ON c.ledger_id = t.ledger_id AND c.category = t.category AND c.month = m.month WHERE t.rank <= 8
UNION ALL SELECT ledger_id, 'averages', category, NULL, {_round_ratio('cc', 'n_months')} FROM avgc
UNION ALL SELECT ledger_id, 'n_review', '', NULL, cast(count(*) FILTER (WHERE category = 'Sin clasificar') AS double) FROM led GROUP BY ledger_id
UNION ALL SELECT ledger_id, 'account', 'income', month, {_d('income_total', 'value')} FROM mt
UNION ALL SELECT ledger_id, 'account', 'expense', month, {_d('expense_total', 'value')} FROM mt
UNION ALL SELECT ledger_id, 'account', 'balance', month, {_d('closing', 'value')} FROM bk
UNION ALL SELECT ledger_id, 'category', category, month, {_d('total', 'value')} FROM ct
UNION ALL SELECT ledger_id, 'subcategory', category || '|' || subcategory, month, {_d('-sum(amount)', 'value')}
          FROM fl WHERE flow = 'expense' AND subcategory <> '' GROUP BY ledger_id, month, category, subcategory
UNION ALL SELECT ledger_id, 'movements', concat_ws('|', category, r, origin, subcategory, concept, last_date, n), month, {_d('total', 'value')}
          FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, month, category ORDER BY total, origin, subcategory) AS r FROM grp)
UNION ALL SELECT ledger_id, 'top', concat_ws('|', category, r, origin, subcategory, concept, last_date, n), month, {_d('total', 'value')}
          FROM (SELECT *, row_number() OVER (PARTITION BY ledger_id, month ORDER BY total, origin, category, subcategory) AS r FROM grp WHERE abs(total) > 500)
          WHERE r <= 15
UNION ALL SELECT ledger_id, 'cross ' || section, category, month, {_d('value', 'value')} FROM xt WHERE level = 'category'
UNION ALL SELECT ledger_id, 'card ' || section, category, month, {_d('value', 'value')} FROM yt WHERE level = 'category'
UNION ALL SELECT ledger_id, 'cross ' || section || ' sub', category || '|' || subcategory, month, {_d('value', 'value')} FROM xt WHERE level = 'sub'
UNION ALL SELECT ledger_id, 'card ' || section || ' sub', category || '|' || subcategory, month, {_d('value', 'value')} FROM yt WHERE level = 'sub'
UNION ALL SELECT ledger_id, 'cross ' || section || ' total', category, NULL, {_d('value', 'value')} FROM xt WHERE level = 'total'
UNION ALL SELECT ledger_id, 'card ' || section || ' total', category, NULL, {_d('value', 'value')} FROM yt WHERE level = 'total'""")

ORACLE["classify_index"] = q(_rules_cte(), select=_CLS_SELECT)


# ---- stored month views (T2) --------------------------------------------------------------------

AFTER = """
after_mv AS (
  SELECT ledger_id, row_id, date, kind, origin, category, subcategory, concept, debit, credit, bank_balance FROM old_ledger
  UNION ALL
  SELECT ledger_id, row_id, date, new_kind, new_origin, new_category, new_subcategory, concept, CASE WHEN debit > 0 THEN debit END,
         CASE WHEN credit > 0 THEN credit END, nullif(bank_balance, 0) FROM cls
)"""


def after_import(*ctes: str, select: str) -> str:
    """Like ``q`` over the ledger after the import."""
    return "WITH RECURSIVE " + ",\n".join([ADAPTER, *_imported_ctes(), AFTER, LEDGER.replace("FROM movements", "FROM after_mv"),
                                          OPENING, *ctes]) + "\n" + select


ORACLE["refresh_all"] = after_import(MONTHS, RUNNING, CAT_TOTALS, BANK, GROUPS, CROSS.format(src="fl"), select="""
, v AS (
  SELECT 'A1' AS view, ledger_id, month, 'expense' AS key, expense_total AS value, NULL AS n FROM mt
  UNION ALL SELECT 'A1', ledger_id, month, 'income', income_total, NULL FROM mt
  UNION ALL SELECT 'A2', ledger_id, month, category, total, n FROM ct
  UNION ALL SELECT 'A3', ledger_id, month, category || '|' || subcategory, -sum(amount), NULL
            FROM fl WHERE flow = 'expense' AND subcategory <> '' GROUP BY ledger_id, month, category, subcategory
  UNION ALL SELECT 'A4', ledger_id, month, concat_ws('|', category, origin, subcategory, concept, last_date), total, n FROM grp
  UNION ALL SELECT 'A5', ledger_id, month, concat_ws('|', section, level, category, subcategory), value, rank FROM xt
  UNION ALL SELECT 'W1', ledger_id, month, 'closing', closing, NULL FROM rb
  UNION ALL SELECT 'W1', ledger_id, month, 'opening', closing - net, NULL FROM rb
  UNION ALL SELECT 'W3', ledger_id, month, 'closing', closing, NULL FROM bk
  UNION ALL SELECT 'W3', ledger_id, month, 'opening', opening, NULL FROM bk)
SELECT view, ledger_id, month, key, cast(value AS double) AS value, cast(n AS bigint) AS n FROM v""")

# every file of the fixture has two lines that cannot be read
ORACLE["stream_summary"] = q(*_imported_ctes(), select="""
SELECT r.ledger_id, cast(r.file_no AS bigint) AS file_no, 'imported' AS status, r.n_read, coalesce(a.n_new, 0) AS n_new,
       coalesce(a.n_new - a.n_review, 0) AS n_classified, coalesce(a.n_review, 0) AS n_review, 2::BIGINT AS n_rejected, coalesce(a.n_review, 0) > 0 AS alert
FROM (SELECT ledger_id, file_no, count(*) AS n_read FROM incoming GROUP BY 1, 2) r
LEFT JOIN (SELECT ledger_id, file_no, count(*) AS n_new, count(*) FILTER (WHERE new_category = 'Sin clasificar') AS n_review
           FROM cls GROUP BY 1, 2) a USING (ledger_id, file_no)""")

ORACLE["classify_amounts"] = q(select="""
, rules AS (
  SELECT p_partkey AS ord, 'Rango ' || p_partkey::VARCHAR AS category, CASE WHEN p_partkey % 5 = 0 THEN 's' ELSE '' END AS sub,
         CASE WHEN p_partkey % 211 <> 0 THEN p_retailprice::DECIMAL(18,2) * 20 END AS lo,
         CASE WHEN p_partkey % 307 <> 0 THEN p_retailprice::DECIMAL(18,2) * 20 + (p_partkey % 97 * 3)::DECIMAL(18,2) END AS hi
  FROM part WHERE p_partkey % 211 <> 0 OR p_partkey % 307 <> 0),
amounts AS (SELECT DISTINCT greatest(abs(coalesce(debit, 0)), abs(coalesce(credit, 0))) AS amt FROM movements),
hit AS (SELECT amt, min({'a': CASE WHEN sub = '' THEN 1 ELSE 0 END, 'ord': ord}) AS best
        FROM amounts JOIN rules ON (lo IS NULL OR amt >= lo) AND (hi IS NULL OR amt <= hi) GROUP BY amt)
SELECT m.ledger_id, m.row_id, r.ord AS rule_ord, coalesce(r.category, 'Sin clasificar') AS new_category, coalesce(r.sub, '') AS new_subcategory,
       '' AS new_origin, '' AS new_kind
FROM movements m LEFT JOIN hit h ON h.amt = greatest(abs(coalesce(debit, 0)), abs(coalesce(credit, 0)))
LEFT JOIN rules r ON r.ord = h.best.ord""")

ORACLE["ledger_versions"] = ORACLE["reclassified_ledger"]


# ---- layers: the ledger by month (S3), the kept labeller (M2b) ---------------------------------

ORACLE["month_ledger"] = q(*_imported_ctes(), select=f"""
, al AS (
  SELECT ledger_id, 'y' || cast(year(date) AS varchar) AS batch_id, date, debit, credit, review FROM old_ledger
  UNION ALL
  SELECT ledger_id, 'import-1', date, CASE WHEN debit > 0 THEN debit END, CASE WHEN credit > 0 THEN credit END,
         new_category = 'Sin clasificar' FROM cls
)
SELECT ledger_id, batch_id, year(date) AS year, month(date) AS month, count(*) AS n, {_d('sum(debit)', 'debit')}, {_d('sum(credit)', 'credit')},
       count(*) FILTER (WHERE review) AS n_review
FROM al GROUP BY ALL""")
ORACLE["nb_kept"] = ORACLE["nb_labeller"]
ORACLE["import_stream_by_month"] = ORACLE["import_stream"]

ORACLE["migrate_new_rules"] = """
WITH s AS (
  SELECT CASE WHEN p_size % 4 = 0 THEN '' ELSE trim(p_name) END AS pattern, CASE WHEN p_size % 2 = 0 THEN cast(p_size AS double) END AS lo,
         CASE WHEN p_size % 3 = 0 THEN cast(p_size + 100 AS double) END AS hi, p_type AS category, cast(p_partkey AS varchar) AS subcategory,
         CASE WHEN p_size % 6 <> 0 THEN p_brand ELSE '' END AS origin, '' AS kind
  FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND trim(p_type) <> ''
)
SELECT *, cast(row_number() OVER (ORDER BY category, length(pattern) DESC, pattern, subcategory) AS integer) AS ord FROM s"""
