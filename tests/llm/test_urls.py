"""URL filter: parts and rules against Python, the model against an own minimiser and on held-out addresses."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from salescope.llm import queries, urls

SF = "/root/testdata/sf0.001"
LABELLED = [(u, 1) for u in queries.BLOCKED_URLS] + [(u, 0) for u in queries.ALLOWED_URLS]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def decide(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return min(fits, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block"), default=None)


@pytest.fixture(scope="module")
def model(spark):
    return urls.fit(spark.createDataFrame(LABELLED, "url string, blocked int").coalesce(1))


ODD = ["http://A.Example.COM/En/1?x#y", "https://example.com/en/", "http://sub.www.example.com/en/x", "http://notexample.com/en/x", "http://example.com",
       "http://example.com?a=/en/", "http://b.net/es/", "http://net/fr/1", "http://b.net/ES/", "no scheme.com/en/", "", None, "://", "://h", "a://b://c.net/es/",
       "http://\u00c4.com/\u00c4", "http://x.com/a\nb", "ftp://user@x.net:80/es/1", "http://" + "a." * 20000 + "net/es/" + "9" * 50000]


def test_parts_and_rules(spark, model):
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(ODD)], "page_id bigint, url string, Verdict string")
    got = {r.page_id: r for r in urls.judge(rows, model, queries.URL_RULES).collect()}
    assert len(got) == len(ODD)
    for i, u in enumerate(ODD):
        host, path = split(u)
        rule = decide(host, path, queries.URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule and rule.name)
        assert got[i].verdict == (rule.verdict if rule else "block" if got[i].block_probability >= 0.5 else "allow")


def test_equal_lengths_and_many_rules(spark, model):
    rules = [urls.Rule("allow", "a.net", "/x"), urls.Rule("block", "net", "/x/y"), urls.Rule("allow", "net", "/q"), urls.Rule("block", "net", "/q")]
    rules += [urls.Rule("block", f"h{i}.org", "/") for i in range(urls.MOST_RULES - 4)]
    seen = ["http://a.net/x/y", "http://b.net/x/y", "http://b.net/q", "http://h17.org/"]
    got = [r.rule for r in urls.judge(spark.createDataFrame([(u,) for u in seen], "url string"), model, rules).collect()]
    assert got == ["a.net/x", "net/x/y", "net/q", "h17.org/"]
    with pytest.raises(ValueError):
        urls.matching(rules + rules, F.col("host"), F.col("path"))


def grams(url):
    host, path = split(url)
    out = set()
    for mark, part in (("h", host), ("p", path)):
        part = "\x02" + re.sub("[1-9]", "0", part) + "\x03"
        out |= {mark + part[i:i + n] for n in (3, 4, 5) for i in range(len(part) - n + 1)}
    return out


def test_model_is_the_minimum(spark, model):
    """Newton's method on the dual variables (no hashing: few of the n-grams share a counter)."""
    prints = [grams(u) for u, _ in LABELLED]
    y = np.array([b for _, b in LABELLED], float)
    kernel = np.array([[len(a & b) for b in prints] for a in prints], float)
    n, pen = len(y), urls.PENALTY
    alpha, bias = np.zeros(n), 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(kernel @ alpha + bias)))
        w = np.maximum(p * (1 - p), 1e-9)
        # stationarity: pen * alpha + (p - y) / n = 0, sum(p - y) = 0
        jac = np.zeros((n + 1, n + 1))
        jac[:n, :n] = pen * np.eye(n) + (w[:, None] * kernel) / n
        jac[:n, n], jac[n, :n], jac[n, n] = w / n, w @ kernel, w.sum()
        step = np.linalg.solve(jac, np.concatenate([pen * alpha + (p - y) / n, [(p - y).sum()]]))
        alpha, bias = alpha - step[:n], bias - step[n]
    seen = ["http://casino-palace.test/en/7", "http://the-archive.test/de/1", "http://x.test", "http://pills.test/"]
    got = [r.block_probability for r in urls.judge(spark.createDataFrame([(u,) for u in seen], "url string"), model).collect()]
    for u, g in zip(seen, got):
        want = 1 / (1 + math.exp(-(sum(a * len(grams(u) & p) for a, p in zip(alpha, prints)) + bias)))
        assert g == pytest.approx(want, abs=0.02)


def test_held_out_addresses(spark, model):
    bad = ["http://grand-casino.test/en/5", "http://blog.free-pills.test/de/7", "http://spam-ads.test/es/9", "http://www.poker-win.test/fr/2"]
    good = ["http://town-library.test/en/5", "http://blog.river-walks.test/de/7", "http://museum-notes.test/es/9", "http://www.school-news.test/fr/2"]
    got = {r.url: r.verdict for r in urls.judge(spark.createDataFrame([(u,) for u in bad + good], "url string"), model).collect()}
    assert [got[u] for u in bad] == ["block"] * 4 and [got[u] for u in good] == ["allow"] * 4


def test_odd_tables(spark, model):
    assert urls.judge(spark.createDataFrame([], "page_id bigint, url string"), model, queries.URL_RULES).count() == 0
    for rows in ([], [("http://a.test/", 1)], [(None, 0), ("http://a.test/", 1)]):
        with pytest.raises(ValueError):
            urls.fit(spark.createDataFrame(rows, "url string, blocked int"))


def test_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in queries.op13_url_filter(spark, SF).collect()}
    assert len(got) == len(pages)
    for page_id, url in pages:
        host, path = split(url)
        rule = decide(host, path, queries.URL_RULES)
        g = got[page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule and rule.name) and g.verdict in ("allow", "block")
        assert rule is None or g.verdict == rule.verdict
