"""Line de-duplication against a direct count, and edge rows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerline.llm import boilerplate as B


def brute(rows, ratio, least):
    lines = [[x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")] for _, _, t in rows]
    pages = Counter(h for _, h, _ in rows if h is not None)
    having = Counter((h, x) for (_, h, _), own in zip(rows, lines) if h is not None for x in set(own))
    out = []
    for (key, host, _), own in zip(rows, lines):
        rest = [x for x in own if host is None or not (having[host, x] >= least and having[host, x] > ratio * pages[host])]
        out.append((key, host, len(own), len(own) - len(rest), "\n".join(rest)))
    return sorted(out, key=repr)


def test_against_a_direct_count(spark):
    rnd = random.Random(2)
    vocabulary = [f"line {i}" for i in range(40)]
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), "\n".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(6)))) for i in range(200)]
    rows += [(900, "a", None), (901, "a", ""), (902, "c", "only\nonly"), (900, "a", None), (None, "b", " padded \n\n  \nline 1"),
             (903, "d", "\n".join(f"l{i}" for i in range(50_000)))]
    df = spark.createDataFrame(rows, "key long, host string, text string").withColumn("kept", F.lit(1)).withColumn("lines", F.lit(2))
    for ratio, least in ((0.1, 3), (0.5, 1), (0.0, 1), (B.RATIO, B.MIN_PAGES)):
        out = B.drop_boilerplate(df, F.col("key"), F.col("host"), F.col("text"), ratio, least)
        assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(rows, ratio, least)
    empty = B.drop_boilerplate(df.limit(0), F.col("key"), F.col("host"), F.col("text"))
    assert empty.count() == 0


def test_small_hosts_go_by_the_ratio(spark):
    rows = [(1, "two", "menu\none"), (2, "two", "menu\nother"), (3, "single", "menu\nalone"),
            *((10 + i, "ten", f"own {i}\n" + ("twice" if i < 2 else "x" * (i + 1))) for i in range(10)),
            *((100 + i, "many", f"own {i}\n" + ("rare" if i < 5 else "often" if i < 11 else f"z{i}")) for i in range(100))]
    df = spark.createDataFrame(rows, "key long, host string, text string")
    kept = {r["key"]: r["kept"] for r in B.drop_boilerplate(df, F.col("key"), F.col("host"), F.col("text")).collect()}
    assert (kept[1], kept[2], kept[3]) == ("one", "other", "menu\nalone")       # on both pages; on the only page
    assert kept[10] == "own 0" and kept[15] == "own 5\nxxxxxx"                   # 2 of 10 pages
    assert kept[100] == "own 0\nrare" and kept[105] == "own 5"                   # 5 of 100 is not over 0.05, 6 are


def test_hosts_and_lines(spark):
    page = "<HTML><style>p{}</style><script>x='</p>'</script><p>one<br>two <b>bold</b></p><!-- <p>no</p> --><div>three</div>"
    df = spark.createDataFrame([("HTTP://Www.Ex.COM:80/a?b", page), (None, None), ("no url", "")], "url string, html string")
    rows = df.select(B.host_of(F.col("url")).alias("h"), B.lines_of_html(F.col("html")).alias("t")).collect()
    assert [r["h"] for r in rows] == ["www.ex.com", None, None]
    assert [x for x in rows[0]["t"].split("\n") if x.strip()] == ["one", "two bold", "three"]
    assert rows[1]["t"] == rows[2]["t"] == ""
