from __future__ import annotations

import re

from pyspark.sql import functions as F

from check_queries import compare, connect
from tallybrook.llm import urls
from tallybrook.llm.queries import ORACLES, URL_RULES, op6_urls
from tests.conftest import plan_of

SCHEMA = "page_id bigint, url string, host string, verdict int"
ADDRESSES = [
    None, "", "no address", "http://", "https://example.org", "https://example.org/", "https://EXAMPLE.org/es/x",
    "https://example.org/es", "https://a.example.org/en/12?q=1#f", "https://notexample.org/en/1",
    "http://example.org.evil.net/es/", "https://x.com/fr/", "https://x.com/de/1", "https://com/de/1",
    "https://a.net/listed", "https://a.net/listed?utm_source=x", "https://a.net/listed?b=2&a=1",
    "https://a.net/other", "ftp://user@a.net:80/listed#part", "a://b://c.com/fr/", "https://a.net?x=1",
    "https://Ünï.org/päth", "https://a..org//x", "https://x.com/" + "y" * 50_000,
]


def parts_of(url):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    if not found:
        return "", ""
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in found[1])
    return host, found[2]


def expected(url, listed):
    host, path = parts_of(url)
    fits = [
        r
        for r in URL_RULES
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if fits:
        best = max(fits, key=lambda r: (len(r.name), len(r.host)))
        return host, path, best.name, best.action
    return host, path, None, urls.BLOCK if url in listed else urls.ALLOW


def pages_of(spark, addresses):
    return spark.createDataFrame([(i, u, "?", 0) for i, u in enumerate(addresses)], SCHEMA)


def test_verdicts_equal_brute_force(spark):
    listed = spark.createDataFrame([("https://a.net/listed",), ("https://A.net/listed#x",), (None,)], "url string")
    got = urls.judge_urls(pages_of(spark, ADDRESSES * 2), URL_RULES, listed).collect()
    blocked = {"https://a.net/listed", "https://a.net/listed?utm_source=x"}
    assert len(got) == 2 * len(ADDRESSES)
    for row in got:
        want = expected(ADDRESSES[row.page_id % len(ADDRESSES)], blocked)
        assert tuple(row)[1:] == want


def test_canonical_form(spark):
    table = spark.createDataFrame(
        [("http://A.com?b=1&a=2&ref=z&&utm_x=1#f",), ("https://a.com/p?",), (None,), ("x",)], "url string"
    )
    got = [r[0] for r in table.select(urls.canonical(F.col("url"))).collect()]
    assert got == ["a.com/?a=2&b=1", "a.com/p", None, None]


def test_filter_loses_no_key_and_passes_few_others(spark, monkeypatch):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    asked = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    for size in (urls.BROADCAST_BYTES, 0):
        monkeypatch.setattr(urls, "BROADCAST_BYTES", size)
        passed = {r.key for r in urls.possible_hits(asked, keys, 3000).collect()}
        assert passed >= {f"k{i}" for i in range(3000)}
        assert len(passed) - 3000 < 0.03 * 17_000


def test_without_rules_list_or_pages(spark):
    none = spark.createDataFrame([], "url string")
    got = urls.judge_urls(pages_of(spark, ADDRESSES), (), none).collect()
    assert {r.verdict for r in got} == {urls.ALLOW} and len(got) == len(ADDRESSES)
    assert urls.judge_urls(pages_of(spark, []), URL_RULES, none).collect() == []


def test_query_equals_its_sql(spark, sf_dir):
    assert "Python" not in plan_of(op6_urls(spark, sf_dir))
    verdict = compare(spark, connect(sf_dir), sf_dir, "op6_urls", op6_urls, ORACLES["op6_urls"])
    assert verdict.startswith("match"), verdict
