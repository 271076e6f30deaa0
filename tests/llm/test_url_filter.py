import random

from netsift.llm import url_filter as U


def brute(url, rules, default="allow"):
    lower = {k: k + 32 for k in range(65, 91)}
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate(lower), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, h, p in rules:
        h = h.translate(lower)
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (-1,), (len(h + p), len(h), verdict == "block", h + p, verdict))
    return (host, path, best[3], best[4]) if best else (host, path, None, default)


def test_rules_against_brute_force(spark):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "ab", "com", "net", "x-y", "Ab", "é", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(0, 4)))
    path = lambda: "".join(rng.choice(["/", "a", "/b", "?q=/a", "#f", "/a/b"]) for _ in range(rng.randint(0, 4)))
    urls = [None, "", "no scheme", "://", "http://", "a://b://c/d", "http://H.COM?x", "s://a.b\n/c"] + [f"http://{host()}{path()}" for _ in range(600)]
    urls += ["http://hot.com/a"] * 300 + ["http://com\0evil/", "http://a.com\0b/", "http://com\1\1evil/", "http://x.com\0/", "http://y.com\1/"]
    rules = [(rng.choice(["allow", "block"]), host(), path().split("?")[0].split("#")[0]) for _ in range(60)] + [("block", "hot.com", "/"), ("block", "hot.com", "/"), ("block", "com", "/"), ("allow", "com\0", "/")]
    rules = list({(h.lower() if h.isascii() else h, p): (v, h, p) for v, h, p in rules}.values())
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'x' host", "'y' rule", "1 key")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, U.rule_frame(spark, rules)).collect()}
    assert len(got) == len(urls)
    for k, url in enumerate(urls):
        assert got[k] == brute(url, rules), url


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b"), (None, None)], "page_id bigint, url string")
    rows = U.judge_urls(pages, spark.createDataFrame([], "verdict string, host string, path string")).collect()
    assert {(r.rule, r.verdict) for r in rows} == {(None, "allow")} and len(rows) == 2
    assert U.judge_urls(pages.limit(0), U.rule_frame(spark, U.RULES)).collect() == []
