"""

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS] and prints
ONE JSON line: {"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}.
Each query is executed to completion with the ``noop`` sink (full plan, nothing collected), one
warm-up run, then the median of $BENCH_RUNS (default 3) timed runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ledgerline.operators import classify as C  # noqa: E402
from ledgerline.plans.registry import registered_queries  # noqa: E402
from ledgerline.session import get_session  # noqa: E402
from ledgerline.sources import adapter  # noqa: E402
from ledgerline.sources.rules import load_rules  # noqa: E402

HEADLINE = ["flagship", "cross_table", "import_statements", "mine_patterns", "top_movements", "category_trend",
            "bank_balance", "classify"]


def rules_of_size(spark, sf, n):
    """A rule sheet of ``n`` part-specific rules (pattern = part name + part key) — the
    """
    part = spark.read.parquet(f"{sf}/part.parquet").where(F.col("p_partkey") <= n)
    raw = part.select(F.col("p_partkey").cast("int").alias("ord"),
                      F.concat(F.upper("p_name"), F.lit("  "), F.col("p_partkey").cast("string")).alias("pattern"),
                      F.lit(None).cast("string").alias("lo"), F.lit(None).cast("string").alias("hi"),
                      F.concat(F.lit("Parte "), F.col("p_brand")).alias("category"), F.lit("").alias("subcategory"),
                      F.lit("").alias("origin"), F.lit("").alias("kind"))
    return load_rules(raw)


def classify_query(n, strategy):
    def run(spark, sf):
        mv = adapter.movements(spark, sf).select("ledger_id", "row_id", "concept", "debit", "credit")
        return C.classify(mv, rules_of_size(spark, sf, n), strategy=strategy)
    return run


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(f"local[{cpus}]", int(cpus) * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = registered_queries()
    qs = {n: reg[n] for n in HEADLINE}
    # rule-count dimension with the strategy the library picks (auto: CASE chain ≤ 32 rules, join ≤ 1,000, index
    # form above; the last is one rule per part, 20,000 at sf0.1), plus both forms at 10 rules for comparison
    for n in (10, 100, 1000, 100_000):
        qs[f"classify_rules{n}"] = classify_query(n, "auto")
    qs["classify_rules10_case"] = classify_query(10, "case")
    qs["classify_rules10_join"] = classify_query(10, "join")
    qs["classify_rules1000_join"] = classify_query(1000, "join")
    only = [x for x in os.environ.get("BENCH_QUERIES", "").split(",") if x]
    if only:
        qs = {k: v for k, v in qs.items() if k in only}
    out = {}
    for name, fn in qs.items():
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            fn(spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                times.append(time.perf_counter() - t0)
        out[name] = round(statistics.median(times), 3)
    m = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({"metric": "total_sec", "value": round(sum(out.values()), 3), "unit": "sec",
                      "queries": out, "sf": float(m.group(1)) if m else sf, "cpus": int(cpus),
                      "spark": spark.version, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
