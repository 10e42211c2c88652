"""URL rules: the trie and the joins against every rule tried on every URL."""

import random

import pytest
from llm_cases import CLASHING, documents, key, none
from pyspark.sql import functions as F

from tidemark.llm import common, url_rules


@pytest.fixture(scope="module", autouse=True)
def settings(spark):
    common.configure(spark)


URLS = [
    None, "", "no scheme", "://", "http://", "http://org", "http://org/", "HTTP://Example.ORG/es/a/b", "https://a.b.example.org/en/123?x=/de/",
    "https://example.org/en/1", "https://example.org/en/2", "https://example.org/en", "https://notexample.org/es/", "https://x.com/fr/", "https://x.com/fr",
    "https://x.com/de/#a", "https://x.com:80/de/", "https://u@x.com/de/", "http://a://b/c", "http://..org/es", "http://org?/es/", "http://org#/", "x://é.com/de/é\n/z",
    "http://x.com//de/", "http://com/" + "y/" * 5000, "http://" + "s." * 500 + "example.org/es/",
]
ODD = [("org", "/", "allow"), ("ORG", "/", "block"), ("", "", "block"), (None, "/fr", "allow"), ("x.com", None, "allow"), ("com", "/de/", "block"),
       ("x.com", "/d", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/12", "allow"), ("b.example.org", "/e", "block"), ("com", "/", "allow")]


def plain(url, rules, otherwise="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = []
    for h, p, v in rules:
        h, p = "".join(c.lower() if c.isascii() else c for c in h or ""), p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    best = max(fits, default=(0, 0, otherwise, None))
    return host, path, best[3], best[2]


def judged(spark, urls, rules, **options):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, host string")
    known = spark.createDataFrame(rules, "host string, path string, verdict string")
    out = url_rules.judge_urls(pages, known, **options)
    assert out.columns == ["page_id", "url", "host", "judged"]
    return {r.page_id: tuple(r.judged) for r in out.collect()}


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("rules", [url_rules.RULES, ODD])
def test_longest_rule(spark, rules, bound):
    got = judged(spark, URLS + URLS[:8], rules, trie_bytes=bound)
    assert got == {i: plain(u, rules) for i, u in enumerate(URLS + URLS[:8])}


def test_many_rules(spark):
    dice = random.Random(2)
    part = lambda n: ".".join(dice.choice(["a", "b", "cc"]) for _ in range(n))
    rules = [(part(dice.randrange(3)), "/" + "/".join(dice.choice(["", "x", "xy", "z"]) for _ in range(dice.randrange(3))), dice.choice(["allow", "block"])) for _ in range(300)]
    urls = [f"http://{part(dice.randrange(1, 5))}/" + "/".join(dice.choice(["", "x", "xyz", "z"]) for _ in range(dice.randrange(4))) for _ in range(400)]
    rules = list({r[:2]: r for r in rules}.values())
    want = {i: plain(u, rules, "block") for i, u in enumerate(urls)}
    assert judged(spark, urls, rules, otherwise="block") == judged(spark, urls, rules, otherwise="block", trie_bytes=0) == want


def test_no_rules_no_rows_odd_verdicts(spark):
    assert judged(spark, URLS[:9], []) == {i: plain(u, []) for i, u in enumerate(URLS[:9])}
    known = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    for bound in (0, 10**6):
        assert url_rules.judge_urls(none(spark), known, "text", trie_bytes=bound).count() == 0
    docs = documents(spark).withColumn("url", F.concat(F.lit("http://x.com/de/"), F.col("doc_id").cast("string")))
    kept = url_rules.allowed(docs, known).select("doc_id", *CLASHING).collect()
    assert sorted(map(key, kept)) == sorted(map(key, docs.where("doc_id IS NULL").select("doc_id", *CLASHING).collect()))
    for odd in (None, "deny"):
        with pytest.raises(ValueError):
            url_rules.judge_urls(docs, spark.createDataFrame([("x", "/", odd)], "host string, path string, verdict string"))


def test_one_trie_and_no_shuffle(spark):
    known = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    plan = url_rules.judge_urls(documents(spark).coalesce(1), known, "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
