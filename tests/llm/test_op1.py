import random

from tallymatch.llm import queries
from tallymatch.llm.urls import judge_urls, rules_table


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:].split("?")[0].split("#")[0]
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_query_against_sql(spark, same_as_sql):
    same_as_sql(spark, queries.op1_url_filter, queries.OP1_SQL)


def test_against_brute_force(spark):
    rng = random.Random(1)
    urls = [f"{rng.choice(['http', 'HTTPS', 'x://y'])}://{rng.choice(['', 'a.', 'A.B.', '.', 'www.'])}{rng.choice(['Example.com', 'example.net', 'com', 'org', 'xcom', 'é.com', 'net.'])}{rng.choice(['', '/', '/en', '/en/', '/en/7', '/en/75', '/de/8', '/de/', '?/en/', '#x', '/é/'])}{rng.choice(['', '?q=/en/', '#f', 'x' * 50])}" for _ in range(400)]
    urls += [None, "", "nothing", "://", ":///en/", "http://a\nb.com/en/\nx", "http://com/en/" + "z" * 100_000]
    rules = [(v, h, p) for v in ("block", "allow") for h in ("com", "example.com", "net", "é.com", "") for p in ("", "/", "/en/", "/en/7", "/é/") if rng.random() < 0.6]
    pages = spark.createDataFrame([(i // 2, u, "r", "h") for i, u in enumerate(urls)], "page_id long, url string, rule string, host string")
    got = sorted(map(tuple, judge_urls(pages, rules_table(spark, rules)).collect()), key=repr)
    assert got == sorted(((i // 2, *brute(u, rules)) for i, u in enumerate(urls)), key=repr)


def test_the_join_is_on_short_prefixes(spark, sf):
    """The whole digest is no join key: it is looked at after the prefixes have met."""
    plan = queries.op1_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.split("\n") if "Join" in line and "__short" in line)
    keys, rest = join.split("Inner", 1)
    assert "__first" in keys and "__full" not in keys and "__digest" not in keys
    assert "StartsWith(__full" in rest
    assert "monotonically_increasing_id" not in plan


def test_no_rules_null_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    none = rules_table(spark, [])
    assert [r["verdict"] for r in judge_urls(pages, none, default="block").collect()] == ["block"]
    assert [r["rule"] for r in judge_urls(pages, rules_table(spark, [("block", None, "/"), ("block", "com", None), (None, "com", "/")])).collect()] == [None]
    assert judge_urls(pages.limit(0), rules_table(spark)).collect() == []
