"""URL verdicts against a plain loop over all rules."""

import re

from vantry.llm import url_rules as U

FIXED = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
URLS = [
    None, "", "x", "http://", "http://Example.ORG/es/1", "http://a.b.example.org/en/12?x", "http://example.org/en/2", "http://myexample.org/es/", "http://org",
    "http://org/", "https://x.com/de/a#b", "https://x.com/DE/a", "http://x.com/fr", "http://x.com/fr/", "http://com/de/", "ftp://x.net/login", "http://x.net/Login",
    "http://x.net/blogin/", "http://casino.net?q=1", "http://a.net/p?banner", "http://x.org?y=/de/", "a://b://c.org/", "http://xn--é.org/ü", "http://a.org:80/",
    "http://x.com/fr/casino", "http://a\nb.org/q", "http://x.net/" + "a" * 20_000 + "/porn",
]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in FIXED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    words = set(re.split(r"[^a-z0-9]", host + path))
    return host, path, None, "block" if words & {r.literals[0] for r in U.WORD_RULES} else "allow"


def test_against_all_rules(spark):
    rows = list(enumerate(URLS)) + [(4, URLS[4])]
    df = spark.createDataFrame([(*r, "h", "v") for r in rows], "page_id long, url string, host string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.judge(df).collect())
    assert got == sorted((k, h, p, r or "", v) for k, u in rows for h, p, r, v in [plain(u)])
    assert U.judge(df.limit(0)).count() == 0


def test_rules_lie_under_their_rarest_token():
    found = {name: token for token, name, *_ in U.index(U.RULES, {"org": 50, "example": 90, "es": 3, "en": 60, "com": 9, "fr": 9, "de": 1})}
    assert found == {"org/": "org", "example.org/es/": "es", "example.org/en/1": "org", "com/fr/": "com", "com/de/": "de"}
    assert U.index([U.Rule("any", "block", "q+", (), 1)], {})[0][0] == ""


def test_rule_without_literal_and_empty_list(spark):
    df = spark.createDataFrame([(1, "http://a.net/qq"), (2, "http://a.net/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in U.judge(df, [U.Rule("any", "block", "q{2}", (), 1)]).collect()}
    assert got == {1: "block", 2: "allow"}
    assert {r.verdict for r in U.judge(df, [], otherwise="block").collect()} == {"block"}


def test_rules_with_capitals(spark):
    rules = [U.prefix_rule("block", h, p) for h, p in [("com", "/News/"), ("Example.ORG", "/%C3%A9/"), ("net", "/A/bC/"), ("net", "/a/")]]
    urls = ["http://x.com/News/1", "http://x.com/news/1", "http://example.org/%C3%A9/q", "http://EXAMPLE.org/%c3%a9/q", "http://a.net/A/bC/", "http://a.net/A/bc/", "http://a.net/a/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.matched for r in U.judge(df, rules).collect()}
    want = {}
    for k, u in enumerate(urls):
        host, path = re.search("://([^/]*)(.*)", u).groups()
        fits = [r for r in rules if re.search(r.pattern, host.lower() + path)]
        want[k] = max(fits, key=lambda r: r.priority).name if fits else None
    assert got == want and sum(v is not None for v in want.values()) == 4
