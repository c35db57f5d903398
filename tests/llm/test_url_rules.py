from itertools import combinations

from articleflow.llm import url_rules
from articleflow.llm.url_rules import Mining


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda s, stops: min([s.find(c) for c in stops if c in s], default=len(s))
    host = rest[: cut(rest, "/?#")]
    path = rest[len(host) :][: cut(rest[len(host) :], "?#")]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x=1#y", "https://a.example.com/en/", "https://example.com/fr/",
    "https://example.com", "http://x.net/es/1", "http://net/fr/", "http://badnet/fr/", "http://www.example.com/en/q.html",
    "http://h.org?z=/a://b", "http://ÄB.net/fr/",
]


def test_hosts_paths_and_fixed_rules(spark):
    pages = spark.createDataFrame([(k, u, 1) for k, u in enumerate(URLS)], "page_id long, url string, rule int")
    none = spark.createDataFrame([], "url string, blocked boolean")
    rows = {r.page_id: r for r in url_rules.judge(pages, none).collect()}
    for k, u in enumerate(URLS):
        host, path = host_path(u)
        assert (rows[k].host, rows[k].path) == (host, path)
        fit = [
            (len(h + p), h + p, v) for v, h, p in url_rules.FIXED_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        want = max(fit)[1:] if fit else (None, "allow")
        assert (rows[k].rule, rows[k].verdict) == want


def test_mined_rules_equal_all_subsets(spark):
    urls = [f"http{'s' * (k % 2)}://{'bad' if k % 3 else 'good'}.site{k % 4}.org/{'en' if k % 5 else 'xx'}/{k}" for k in range(300)]
    blocked = [u.startswith("https") and "bad" in u for u in urls]
    table = spark.createDataFrame(list(zip(urls, blocked, strict=True)), "url string, blocked boolean")
    options = Mining(0.02, 0.9)
    sets = [frozenset(r[0]) for r in table.select(url_rules.tokens_of(table.url)).collect()]
    every = {frozenset(c) for s in sets for n in range(1, len(s) + 1) for c in combinations(s, n)}
    good = set()
    for c in every:
        n = sum(c <= s for s in sets)
        hits = sum(c <= s and b for s, b in zip(sets, blocked, strict=True))
        if hits >= 0.02 * 300 and hits / n >= 0.9:
            good.add(c)
    rules = url_rules.mine(table, options)
    assert rules and {frozenset(t) for t, _ in rules} == {c for c in good if not any(o < c for o in good)}
    pages = table.selectExpr("1L as page_id", "url")
    verdicts = {r.url: r.v for r in pages.select("url", url_rules.matches(url_rules.tokens_of(pages.url), rules).alias("v")).collect()}
    for u, s in zip(urls, sets, strict=True):
        assert verdicts[u] == any(c <= s for c in good)
