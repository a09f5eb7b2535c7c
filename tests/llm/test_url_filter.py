import random

from pyspark.sql import functions as F

from momentlake.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "://", "HTTP://EXAMPLE.COM/en/7x?q#f", "http://example.com/en/8", "http://www.example.com/en/71", "http://badexample.com/en/7", "http://com/en/", "http://x.com/EN/",
    "http://a.example.net/de/80", "http://a.example.net/de/9", "http://user@a.net:80/de/", "ftp://b.org/es/?a://b", "http://b.org?/es/", "http://b.org#/es/", "http://ÄB.org/es/é", "x://y://z.net/de/", "http://c.org./es/", "http://net",
] * 2


def brute(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    tail = rest[len(host) :]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for h, p, v in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), len(h), h + p, v))
    return host, path, best and best[2], best[3] if best else "allow"


def test_standing_rules(spark):
    pages = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(URLS)], "page_id long, url string, html string, rule string").repartition(3)
    got = url_filter.judged_pages(pages).collect()
    want = sorted(((i if i else None, *brute(u, url_filter.RULES)) for i, u in enumerate(URLS)), key=str)
    assert sorted(map(tuple, got), key=str) == want


def test_many_nested_rules_over_many_ranges(spark):
    rng = random.Random(2)
    label = lambda: rng.choice("abc")
    host = lambda: ".".join(label() for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "".join(rng.choice("xy") for _ in range(rng.randrange(0, 6)))
    rules = list({(host(), path()): rng.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [f"http://{host()}{path()}" for _ in range(1500)] + ["http://a.b.c/xx"] * 700
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame([*rules, (None, "/", "block"), ("a", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, frame, [F.col("page_id")], ranges=13).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == brute(u, rules), u


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged_pages(pages).collect() == []
    none = spark.createDataFrame([], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(one, none, [F.col("page_id")]).collect()] == [(1, "a.b", "/c", None, "allow")]


def test_words_of_the_standing_rules(spark):
    urls = [("x.com/en/1", "com/en/", "block"), ("a.example.com/en/70", "example.com/en/7", "allow"), ("a.net/de/1", "net/de/", "allow"), ("example.net/de/9", "net/de/", "allow"), ("example.net/de/8", "example.net/de/8", "block"), ("b.org/es/", "org/es/", "block")]
    pages = spark.createDataFrame([(i, f"http://{u}") for i, (u, _, _) in enumerate(urls)], "page_id long, url string")
    assert [(r.rule, r.verdict) for r in url_filter.judged_pages(pages).orderBy("page_id").collect()] == [x[1:] for x in urls]
