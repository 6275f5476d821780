import itertools
import random

from corpusloom.llm.url_filter import ENTRIES, Entry, UrlFilter, labelled_pages, url_host, url_path, url_tokens
from pyspark.sql import functions as F

PAGES = "page_id long, url string"


def test_host_path_and_tokens(spark):
    urls = ["HTTP://WWW.Example.COM/En/A1.html?b=2&c#d9", "no scheme", None, "", "x://", "a://h?q=http://y/z", "a://b.c#f?g", "a://h:80//p//", "a://\nu/\nv?\nw", "ftp://É.com/É"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], PAGES).select("page_id", url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p"), url_tokens(F.col("url")).alias("t")).orderBy("page_id").collect()
    assert [(r["h"], r["p"]) for r in rows] == [("www.example.com", "/En/A1.html"), ("", ""), ("", ""), ("", ""), ("", ""), ("h", ""), ("b.c", ""), ("h:80", "//p//"), ("\nu", "/\nv"), ("É.com", "/É")]
    assert rows[0]["t"] == sorted(["s:http", "h1:com", "h2:example", "h3:www", "p:en", "p:a#.html", "x:html", "q:b", "q:c", "f:d#"])
    assert rows[2]["t"] == [] and rows[5]["t"] == ["h1:h", "q:q", "s:a"] and rows[6]["t"] == ["f:f?g", "h1:c", "h2:b", "s:a"]


def test_list_longest_fits(spark):
    cases = {
        "http://a.com/": ("com/", "allow"),
        "http://example.com/en/x": ("example.com/en/", "block"),
        "http://m.example.com/en/x": ("example.com/en/", "block"),
        "http://WWW.example.com/en/x": ("www.example.com/en/", "allow"),
        "http://a.www.example.com/en/": ("www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("com/", "allow"),
        "http://com": (None, "allow"),
        "http://example.com/EN/": ("com/", "allow"),
        "https://x.net/es/1": ("net/es/", "block"),
        "https://net/fr/": ("net/fr/", "block"),
        "https://x.net/fr": (None, "allow"),
        "x.net/fr/": (None, "allow"),
    }
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], PAGES)
    f = UrlFilter()
    rules = f.fit(spark.createDataFrame([], "url string, blocked boolean"))
    assert rules.count() == 0
    got = {r["url"]: (r["rule"], r["verdict"]) for r in f.judge(pages, rules).collect()}
    assert got == cases


def test_longer_host_of_two_as_long():
    assert sorted((Entry("a", "b.c", "/x"), Entry("b", "c", "/xyz")), key=lambda e: (len(e.name), len(e.host)))[-1].host == "b.c"
    assert {e.verdict for e in ENTRIES} == {"allow", "block"}


def rules_by_hand(labelled, tokens_of, least, confidence):
    """Every combination of every labelled url, its count with and without the label."""
    total, blocked = len(labelled), sum(b for _, b in labelled)
    n, nb = {}, {}
    for u, b in labelled:
        for k in range(1, len(tokens_of[u]) + 1):
            for c in itertools.combinations(tokens_of[u], k):
                n[c] = n.get(c, 0) + 1
                nb[c] = nb.get(c, 0) + b
    out = {}
    for c in n:
        for label, freq, prior in ((True, nb[c], blocked), (False, n[c] - nb[c], total - blocked)):
            if freq >= least and freq * 100 >= n[c] * confidence and freq * total > n[c] * prior:
                out[c, label] = freq, n[c], freq * 1_000_000 // n[c]
    return {k: v for k, v in out.items() if not any(w[2] >= v[2] for (c, label), w in out.items() if label == k[1] and set(c) < set(k[0]))}


def sample(n, seed):
    """Pages of casino paths on one host's blog, and of a query key with a path, are bad; either half alone isn't."""
    draw = random.Random(seed)
    for _ in range(n):
        host = draw.choice(["blog.site.org", "site.org", "news.io", "blog.news.io"])
        path, query = draw.choice(["casino", "news", "sport", "en"]), draw.choice(["", "?ref=1", "?win=2"])
        bad = (host.startswith("blog.") and path == "casino") or (query == "?win=2" and path == "sport")
        yield f"http://{host}/{path}/{draw.randint(1, 999)}{query}", bad != (draw.random() < 0.02)


def test_rules_equal_every_combination_counted(spark):
    rows = [*sample(300, 1), (None, True), ("http://site.org/en/1", None)]
    labelled = spark.createDataFrame(rows, "url string, blocked boolean")
    f = UrlFilter(min_count=8, min_support=0.01, min_confidence=85)
    got = {(tuple(r["antecedent"]), r["blocked"]): (r["freq"], r["n"], r["ppm"]) for r in f.fit(labelled).collect()}
    tokens = {r["url"]: r["t"] for r in labelled.where("blocked is not null").select("url", url_tokens(F.col("url")).alias("t")).collect()}
    # Ten tokens a url at most, so all are mined; tokens below the least count stand in no rule anyway.
    assert max(map(len, tokens.values())) <= 10
    assert got == rules_by_hand([(u, b) for u, b in rows if b is not None], tokens, 8, 85)
    assert any(b and {"h3:blog", "p:casino"} & set(c) for c, b in got)


def test_held_out_urls_and_joined_rules(spark):
    f = UrlFilter()
    rules = f.fit(spark.createDataFrame(list(sample(1500, 2)), "url string, blocked boolean"))
    held = list(sample(400, 3))
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], PAGES)
    got = {r["page_id"]: r["verdict"] for r in f.judge(pages, rules).collect()}
    right = sum((got[i] == "block") == b for i, (_, b) in enumerate(held))
    assert right >= 0.95 * len(held)
    # Rules too many to broadcast give the same.
    joined = {r["page_id"]: r["verdict"] for r in UrlFilter(broadcast_bytes=0).judge(pages, rules).collect()}
    assert joined == got


def test_most_telling_tokens_enter(spark):
    rows = [(f"http://a.b/{'bad' if i % 4 == 0 else 'good'}/x?k=1", i % 4 == 0) for i in range(80)]
    rules = UrlFilter(max_tokens=1).fit(spark.createDataFrame(rows, "url string, blocked boolean")).collect()
    assert {(tuple(r["antecedent"]), r["blocked"]) for r in rules} == {(("p:bad",), True), (("p:good",), False)}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.b/bad", "x", "y"), (1, "http://a.b/bad", "x", "y"), (None, None, None, None), (2, "http://h/" + "seg/" * 40_000, "", "")], PAGES + ", verdict string, doc string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    told = labelled_pages(pages, labels)
    assert [(r["url"], r["blocked"]) for r in told.collect()] == [("http://a.b/bad", True)] * 2
    f = UrlFilter(min_count=2, min_support=0.0)
    long_urls = spark.createDataFrame([("http://h/" + "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(5000)), i > 1) for i in range(4)] + [("http://a.b/bad", True)] * 3, "url string, blocked boolean")
    rules = f.fit(long_urls)
    out = f.judge(pages, rules)
    assert out.columns == ["page_id", "url", "doc", "host", "path", "rule", "verdict", "pattern", "pattern_ppm"]
    rows = out.collect()
    assert [r["verdict"] for r in rows if r["page_id"] == 1] == ["block"] * 2 and len(rows) == 4
    empty = next(r for r in rows if r["page_id"] is None)
    assert (empty["host"], empty["path"], empty["rule"], empty["verdict"]) == ("", "", None, "allow")
    assert f.judge(pages.limit(0), rules).collect() == []
