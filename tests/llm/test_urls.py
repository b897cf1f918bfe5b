import random
import re

from tidepool.llm.urls import PATTERNS, RULES, filter_urls, index_patterns, judge_urls, pattern_table, rule_table

ODD_RULES = [*RULES, ("block", "Shop.Example.net", "/a/b/c"), ("allow", "shop.example.net", "/a/b/"), ("block", "net", ""), ("allow", "", "/x"), ("block", None, "/x"), ("block", "org", None)]
ODD_PATTERNS = [*PATTERNS, ("block", "loan*offer"), ("block", "|ftp://"), ("block", "promo^page"), ("allow", "/keep|"), ("block", "a.b|c"), ("block", "/[0-9]{7}/"), ("block", None), ("none", "x")]


def regex_of(p):
    """The pattern language, read from its description."""
    if len(p) > 2 and p[0] == p[-1] == "/":
        return re.compile(p[1:-1], re.S)
    p, out, end = p.lower(), "", ""
    if p.endswith("|"):
        p, end = p[:-1], r"\Z"
    if p.startswith("||"):
        p, out = p[2:], r"\A[^:/?#]*://(?:[^/?#]*\.)?"
    elif p.startswith("|"):
        p, out = p[1:], r"\A"
    for c in p:
        out += {"*": ".*", "^": r"(?:[^a-z0-9%]|\Z)"}.get(c) or re.escape(c)
    return re.compile(out + end, re.S)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def want(url, rules, patterns):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = ascii_lower(re.match(r"[^/?#]*", rest)[0])
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    best = {}
    for verdict, h, p in rules:
        if h and host and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p or ""):
            rule = h.lower() + (p or "")
            best[rule] = max(best.get(rule, ""), verdict)
    if best:
        rule = max(best, key=lambda r: (len(r), r))
        return host, path, rule, best[rule], None
    fits = [(v, p if p[0] == p[-1] == "/" and len(p) > 2 else p.lower()) for v, p in patterns if p and v in ("allow", "block") and url is not None and regex_of(p).search(ascii_lower(url))]
    return (host, path, None, *min(fits)) if fits else (host, path, None, "allow", None)


def urls():
    rng = random.Random(5)
    hosts = ["a.org", "ORG", "x.example.org", "example.com", "shop.example.net", "SHOP.example.net:80", "casino-win.example.com", "my-casino.example.com", "www.cheap-pills.co", "ads.example.com",
             "bads.example.com", "sex-education.co", "u@poker.co", "a..b", ""]
    paths = ["", "/", "/es/", "/en/1", "/en/12/x", "/fr/a", "/de/1", "/a/b/c/d", "/a/b/x", "/cgi-bin/x", "/x.zip", "/Loan/big/Offer", "/promo-page", "/keep", "/1234567", "//", "/a\nb/é"]
    tails = ["", "?q=://x/", "#f", "?sessionid=0123456789abcdef0", "?a.b|c"]
    out = [rng.choice(["http://", "https://", "ftp://", "HTTP://"]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(tails) for _ in range(1500)]
    return out + [None, "", "no scheme casino", "://", "x://y", "http://" + "a." * 3000 + "org/" + "b/" * 3000, "http://a.com/" + "z" * 100_000 + ".zip"]


def test_against_every_rule_on_every_url(spark):
    rows = [(i, u) for i, u in enumerate(urls())] + [(0, "http://a.org/"), (None, "http://poker.de/")]
    pages = spark.createDataFrame([(*r, "k", "x", "x") for r in rows], "page_id long, url string, key string, pattern string, verdict string").repartition(5)
    for rules, patterns in ((RULES, PATTERNS), (ODD_RULES, ODD_PATTERNS)):
        got = judge_urls(pages, rule_table(spark, rules), pattern_table(spark, patterns)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(str((i, *want(u, rules, patterns))) for i, u in rows)


def test_filter_keeps_rows_and_columns(spark):
    pages = spark.createDataFrame([(1, "http://www.cheap-pills.com/x", "k"), (2, "http://ok.com/", "k"), (2, "http://ok.com/", "k"), (3, None, "k")], "page_id long, url string, key string")
    kept = filter_urls(pages, rule_table(spark), pattern_table(spark))
    assert kept.columns == pages.columns and sorted(r[0] for r in kept.collect()) == [2, 2, 3]


def test_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://casino.com/")], "page_id long, url string")
    none = judge_urls(pages, rule_table(spark).limit(0), pattern_table(spark).limit(0)).collect()
    assert [tuple(r) for r in none] == [(1, "casino.com", "/", None, "allow", None)]
    assert judge_urls(pages.limit(0), rule_table(spark), pattern_table(spark)).count() == 0


def test_a_rule_stands_under_its_rarest_token(spark):
    urls = spark.createDataFrame([("http://a.com/red/blue",), ("http://b.com/red/",), ("http://c.com/red",)], "url string")
    patterns = pattern_table(spark, [("block", "/red/blue^"), ("block", "/com^"), ("block", "red"), ("block", "/r.d/")])
    keys = {r["pattern"]: r["key"] for r in index_patterns(patterns, urls).collect()}
    assert keys == {"/red/blue^": "blue", "/com^": "com", "red": "", "/r.d/": ""}
