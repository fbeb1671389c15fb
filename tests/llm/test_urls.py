"""URL filters against a plain search for the longest rule."""

import random

from contestframe.llm import urls


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[2], best[3] if best else "allow"


def judged(spark, given, rules, n=12):
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        df = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(given)], "page_id bigint, url string, rule string, top string")
        return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, urls.rules_frame(spark, rules)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nested_rules_at_random(spark):
    rnd = random.Random(11)
    names = ["com", "net", "a", "b", "example", "www", "x-y", "é"]
    paths = ["/", "/a", "/a/", "/a/b", "/a/b/c", "", "/é/"]
    rules = list({(".".join(rnd.choices(names, k=rnd.randint(1, 3))), rnd.choice(paths)): rnd.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(h, p, a) for (h, p), a in rules]
    given = ["http://" + ".".join(rnd.choices(names, k=rnd.randint(1, 5))) + rnd.choice(paths) + rnd.choice(["", "z", "?q=1", "#f", "/deep?x#y"]) for _ in range(500)]
    given += [given[0]] * 200 + [None, "", "no scheme", "http://", "http:///a", "HTTP://WWW.Example.COM/A", "http://com:80/", "a://b://c/d", "http://com/" + "a/" * 5000, "http://" + "a." * 300 + "com/a"]
    got = judged(spark, given, rules)
    assert got == {k: plain(u, rules) for k, u in enumerate(given)}


def test_given_rules_no_rules_and_no_rows(spark):
    given = ["http://www.example.com/en/1", "http://x.example.com/en/1", "http://example.com/de/", "http://example.com", "http://m.net/es/9", "http://net/fr"]
    got = judged(spark, given, urls.RULES)
    assert [got[k][2:] for k in range(6)] == [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), (None, "allow"), ("net/es/", "block"), (None, "allow")]
    none = spark.createDataFrame([], "host string, path string, action string")
    df = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    assert [r.verdict for r in urls.judge(df, none, default="block").collect()] == ["block"]
    assert urls.judge(df.where("page_id < 0"), urls.rules_frame(spark)).collect() == []
    twice = urls.rules_frame(spark, [("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("a.com", None, "block")])
    assert [r.verdict for r in urls.judge(df, twice).collect()] == ["block"]


def test_no_python_in_the_plan(spark, sf):
    from contestframe.llm import queries

    plan = queries.op2_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
