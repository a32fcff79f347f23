"""URL verdicts against a plain reading of the rules; the cascade is exact over its universe."""
import pytest
from pyspark.sql import functions as F

from storewatch.llm import url_filter as U
from storewatch.session import Scope

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://example.org/en/2",
        "http://badexample.org/es/", "http://org/", "http://x.org", "http://x.org?q=/", "http://a.b.com/de/é\nx", "x://y.com/fr/#",
        "http://x.com/FR/", "http://com/de/", "a://b://c.org/", "http://example.org./es/", "http://user@example.org/es/1",
        "http://" + "a." * 3000 + "example.org/es/" + "p" * 9000, "http://ÄB.ORG/", "https://x.net/de/"]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        tail = url.split("://", 1)[1]
        cut = min([tail.index(c) for c in "/?#" if c in tail] or [len(tail)])
        host, rest = tail[:cut], tail[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = rest[:min([rest.index(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, default))
    return host, path, best[1], best[2]


def test_verdicts(spark):
    rows = [(i if i else None, u, "clash", "clash") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = U.url_verdicts(pages, RULES).collect()
    assert sorted(map(str, got)) == sorted(str(type(got[0])(**dict(zip(
        ("page_id", "host", "path", "rule", "verdict"), (r[0], *brute(r[1], RULES)))))) for r in rows)


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.url_verdicts(empty, RULES).collect() == []
    one = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    assert U.url_verdicts(one, []).first().verdict == "allow"
    with pytest.raises(ValueError):
        U.url_verdicts(one, RULES, max_rules=2)


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key like '%7'")
    with Scope(spark) as scope:
        levels = U.build_cascade(universe, listed, scope, listed.count())
    assert len(levels) >= 2
    wrong = universe.filter(U.is_listed(F.col("key"), levels) != F.col("key").like("%7"))
    assert wrong.count() == 0


def test_plan_has_no_join_or_python(spark):
    pages = spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string")
    plan = U.url_verdicts(pages, RULES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
