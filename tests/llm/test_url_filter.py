import random

from pyspark.sql import functions as F

from scoreline.llm import url_filter

RULES = "host string, path string, verdict string"


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(5)
    hosts = ["a.com", "b.a.com", "x.b.a.com", "com", "aa.com", "org", "é.org", "A.COM", "", "c.a.com.", "a.com:80"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/a/b/c?x=/z", "/é", "?q", "#f", "/a#/b"]
    rules = list({(rng.choice(hosts).lower(), rng.choice(["", "/", "/a", "/a/", "/a/b", "/é"]), rng.choice(["allow", "block"])) for _ in range(25)})
    block = {(h, p): "block" for h, p, v in rules if v == "block"}
    rules = [(h, p, block.get((h, p), v)) for h, p, v in rules]
    urls = [rng.choice(["http://", "https://", "x://", "", "a://b://"]) + rng.choice(hosts) + rng.choice(paths) for _ in range(300)]
    urls += [None, "", "://", "nothing", "http://" + "a." * 3000 + "a.com/a", "http://a.com/a" + "b" * 50000]
    rows = [(i if i % 7 else None, u) for i, u in enumerate(urls)] + [(5, urls[5])] * 3
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("clash")).withColumn("kind", F.lit(1))
    got = url_filter.filter_urls(df, spark.createDataFrame(rules, RULES), ranges=7).collect()
    assert sorted((r.page_id or -1, r.url or "", r.host, r.path, r.rule or "", r.verdict) for r in got) == \
        sorted((i or -1, u or "", *[x or "" for x in brute(u, rules)]) for i, u in rows)


def test_no_pages_no_rules_and_default(spark):
    rules = spark.createDataFrame([("a.com", None, None)], RULES)
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, "http://b.com/")], "page_id bigint, url string")
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {1: ("a.com", "block"), 2: (None, "allow")}
    got = url_filter.filter_urls(pages, rules.limit(0), default_verdict="block").collect()
    assert [(r.rule, r.verdict) for r in got] == [(None, "block")] * 2


def test_hot_host_is_cut_into_ranges(spark):
    pages = spark.range(4000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 < 2, "http://hot.com/a").otherwise(
        F.concat(F.lit("http://h"), F.col("id"), F.lit(".com/a"))).alias("url"))
    rules = spark.createDataFrame([("hot.com", "/", "block"), ("com", "/a", "allow")], RULES)
    got = url_filter.filter_urls(pages, rules, ranges=16).groupBy("rule", "verdict").count().collect()
    assert {(r.rule, r.verdict): r["count"] for r in got} == {("hot.com/", "block"): 2667, ("com/a", "allow"): 1333}
    plan = url_filter.filter_urls(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
