import random

from corpusguard.llm import urls as U


def plain(url, rules=U.RULES):
    """Host, path, rule and its verdict by the stated steps."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([i for i in (rest.find(c) for c in "?#") if i >= 0], default=len(rest))]
    fitting = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fitting)[1:] if fitting else (None, None)))


URLS = [None, "", "no scheme", "http://net/", "http://net", "http://NET/x", "https://a.Example.NET/en/1?x=2#y", "http://example.net/en", "http://xexample.com/de/",
        "http://example.com/de/a?b", "http://a.b.example.com/de/", "http://example.com?/de/", "http://q.org/fr/", "http://q.org/FR/", "x://y://example.com/de/",
        "http://É.org/fr/ü", "://net/", "http://a.net/en/", "http://#frag", "http://a.org/fr/\nx?y", "a" * 50_000 + "://big.net/" + "9" * 50_000]


def test_rules_and_parts(spark):
    rows = [(i, u, 0) for i, u in enumerate(URLS)]
    got = {r.page_id: r for r in U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == verdict if rule else got[i].verdict in ("allow", "block")


def test_trees_generalise_from_labelled_urls(spark):
    r = random.Random(4)

    def url(bad, host):
        if bad:
            return f"http://{host}/" + "/".join(str(r.randrange(10 ** 7)) for _ in range(5)) + "?" + "&".join(f"k{i}={r.random()}" for i in range(4))
        return f"http://{host}/" + r.choice(["about", "news", "story"]) + "/" + r.choice(["one", "two", "three"])

    rules = (("block", "bad.com", "/"), ("allow", "good.com", "/"))
    rows = [(i, url(i % 2, "bad.com" if i % 2 else "good.com")) for i in range(600)] + [(1000 + i, url(i % 2, "other.com")) for i in range(200)]
    got = U.filter_urls(spark.createDataFrame(rows + [(9999, None)], "page_id long, url string"), rules).where("page_id >= 1000 AND page_id < 9999").collect()
    assert sum((x.verdict == "block") == bool(x.page_id % 2) for x in got) >= 190


def test_nothing_to_learn_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, "http://b.com/")], "page_id long, url string")
    assert sorted((x.page_id or -1, x.verdict) for x in U.filter_urls(pages).collect()) == [(-1, "allow"), (1, "block"), (1, "block")]
    assert U.filter_urls(pages.limit(0)).collect() == []
