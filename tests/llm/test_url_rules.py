from flowlab.llm.url_rules import PATTERNS, HostRule, PatternRule, judge_urls

RULES = [HostRule("com", "/", "allow"), HostRule("example.com", "/en/", "block"), HostRule("www.example.com", "/en/", "allow"), HostRule("net", "/es", "block"),
         HostRule("bare.org", "", "block"), HostRule("net", "/es", "allow")]
URLS = ["http://example.com/en/1", "https://WWW.Example.COM/en/", "http://a.www.example.com/en/?q", "http://notexample.com/en/", "http://example.com", "http://example.com/EN/",
        "x://u.net/español", "x://u.net/e", "http://bare.org", "http://s.bare.org/x?y", "http://barebare.org/", None, "", "no scheme", "://", "a://b://c/d", "http://net/es",
        "http://spam-farm.test/", "http://spammy.test/", "http://casino.com/", "http://x.test/casino", "http://e\nx.com/\n/en", "http://" + "a." * 5000 + "com/"]


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    best = [(len(r.name), r.verdict == "block", r.name, r.verdict) for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return (host, path, *(max(best)[2:] if best else (None, None)))


def test_equals_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "mine", 1, 2, 3) for i, u in enumerate(URLS)] + [(0, URLS[0], "mine", 1, 2, 3)],
                                  "page_id long, url string, verdict string, target int, best_rule int, `odd.name x` int")
    rows = judge_urls(pages, RULES + PATTERNS).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if verdict:
            assert r.verdict == verdict and r.pattern is None
    by_id = {r.page_id: r.verdict for r in rows}
    assert by_id[17] == "block" and by_id[18] == "allow" and by_id[19] == "allow" and by_id[20] == "allow"


def test_rule_without_tokens_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://q.test/")], "page_id long, url string")
    assert judge_urls(pages, [PatternRule("any", ".", (), "block")]).first().verdict == "block"
    assert judge_urls(pages, []).first().verdict == "allow"
    assert judge_urls(pages.filter("false"), RULES).count() == 0
