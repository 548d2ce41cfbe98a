import random

import numpy as np
import pytest

from logweave.llm import url_filter as uf
from logweave.llm.queries import URL_RULES


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, text in rules:
        h, p = text[: text.find("/")], text[text.find("/") :]
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(text), len(h)) > (len(best[1]), best[1].find("/"))):
            best = (verdict, text)
    return host, path, best[1] if best else None, best[0] if best else default


ODD = [None, "", "no scheme", "http://", "http://EXAMPLE.org", "http://a.Example.ORG/en/1x?y#z", "https://org/", "x://example.org/es/#a://b/c", "http://notexample.org/es/", "http://com/fr/", "http://a.b.com/de/q?x=/fr/", "http://u@example.org:80/en/1", "http://.org/", "http://example.org./es/", "ü://ß.org/é", "http://x.org?y/es/", "a\nb://c.org/\nd", "http://" + "a." * 60 + "org/" + "x" * 5000, "http://q." + "a." * 5000 + "example.org/es/", "http://example.org." + "a." * 4095 + "zz/es/", "http://" + "." * 9000 + "com/de/"]


def test_matches_plain_rules(spark):
    rng = random.Random(3)
    parts = ["org", "com", "example", "en", "a", "fr", "de"]
    urls = ODD + [f"http://{'.'.join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))}/{'/'.join(rng.choice(['en', 'es', 'fr', 'de', '1', '12']) for _ in range(rng.randrange(0, 3)))}{rng.choice(['', '/', '?a', '#b'])}" for _ in range(800)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, path string").repartition(3)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.filter_urls(df, URL_RULES).collect()}
    assert got == {i: judge(u, URL_RULES) for i, u in enumerate(urls)}
    assert uf.filter_urls(df.limit(0), URL_RULES).collect() == []


def test_clashing_columns(spark):
    names = ["__host", "__path", "host", "url_helper", "Url_Helper_keys", "__best", "verdict", "key"]
    df = spark.createDataFrame([(1, "http://a.org/x", *names)] * 2, "page_id int, url string, " + ", ".join(f"`{n}` string" for n in names))
    for r in uf.filter_urls(df, URL_RULES).collect():
        assert (r.host, r.path, r.rule, r.verdict) == ("a.org", "/x", "org/", "allow")
        assert all(r[n] == n for n in names if n not in ("host", "verdict"))


def test_hosts_of_any_number_of_labels(spark):
    """A rule of many labels and a host of more than 4,096 behave as short ones do."""
    rules = [("block", "a." * 5000 + "zz/"), ("allow", "zz/p")]
    urls = ["http://" + "a." * n + "zz/p" for n in (0, 4095, 4096, 4999, 5000, 5001)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.filter_urls(df, rules).collect()} == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_many_rules(spark):
    rng = random.Random(4)
    rules = list({f"h{rng.randrange(4000)}.example.org/{rng.choice(['', 'a', 'b/c'])}": rng.choice(["allow", "block"]) for _ in range(3000)}.items())
    rules = [(v, t) for t, v in rules]
    urls = [f"http://{rng.choice(['', 'www.'])}h{rng.randrange(4000)}.example.org/{rng.choice(['', 'a', 'b/c', 'd'])}" for _ in range(3000)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in uf.filter_urls(df, rules).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_on_its_universe():
    rng = np.random.default_rng(0)
    one, two = (rng.integers(0, 2**63, 60_000, dtype=np.uint64) for _ in range(2))
    inside, outside = (one[:3000], two[:3000]), (one[3000:], two[3000:])
    first = uf.BloomFilter.build(*inside, rate=0.03, seed=0)
    wrong = first.has(*outside)
    cascade = uf._refine(inside, tuple(x[wrong] for x in outside), first)
    assert len(cascade.levels) > 2 and cascade.has(*inside).all() and not cascade.has(*outside).any()


def test_bounds(spark):
    df = spark.createDataFrame([(1, "http://a/")], "page_id int, url string")
    with pytest.raises(ValueError):
        uf.filter_urls(df, [("allow", "a/"), ("block", "b/")], max_list_keys=1)
    with pytest.raises(ValueError):
        uf.filter_urls(df, [("allow", "a/"), ("block", "a/")])
    assert uf.filter_urls(df, [], default="block").first().verdict == "block"
