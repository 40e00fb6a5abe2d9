from collections import Counter, defaultdict

from lodestar.llm import urlgraph as U
from lodestar.llm.common import table


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    stop = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:stop]


def rule_of(host, path, rules=U.RULES):
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: (len(r[0] + r[1]),), default=None)


def brute(pages, links, rules=U.RULES):
    """pages: (url, linked hosts). Verdicts by host from plain iteration."""
    urls = [split(u) for u, _ in pages]
    n, share = Counter(h for h, _ in urls if h), {"allow": Counter(), "block": Counter()}
    for h, p in urls:
        if h and (r := rule_of(h, p, rules)):
            share[r[2]][h] += 1
    out = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        edges = {(a, b) if kind == "trust" else (b, a): w for (a, b), w in links.items()}
        total = defaultdict(int)
        for (a, _), w in edges.items():
            total[a] += w
        start = {h: 0.15 * share[verdict][h] / n[h] for h in n}
        score = dict(start)
        for _ in range(U.ITERATIONS if links else 0):
            new = defaultdict(float, start)
            for (a, b), w in edges.items():
                new[b] += 0.85 * w / total[a] * score.get(a, 0)
            score = new
        out[kind] = score
    return out


def test_whole_table_against_brute_force(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    urls = {r.page_id: r.url for r in pages.select("page_id", "url").collect()}
    want = brute([(u, ()) for u in urls.values()], {})
    rows = U.url_digest(pages).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = split(urls[r.page_id])
        rule = rule_of(host, path)
        trust, distrust = round(want["trust"][host], 9), round(want["distrust"][host], 9)
        method = "block" if distrust >= 0.075 and distrust > trust else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[0] + rule[1], rule[2] if rule else method)
    assert {r.verdict for r in rows} == {"allow", "block"}


def test_flows_and_odd_urls(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts) + '<a href="/own"><a href="#x">'
    data = [
        (1, "http://bad.example.com/de/1", link("spam.io"), 1), (2, "http://friend.io/", link("bad.example.com", "bad.example.com", "good.org"), 1),
        (3, "https://good.org/fr/", link("nice.io"), 1), (4, "HTTP://User@NICE.io:80?q=/de/", None, 1), (5, None, link("good.org"), 1),
        (6, "no scheme", "", 1), (7, "x://", "", 1), (8, "x:///path", "", 1), (9, "http://example.net/en", "", 1), (9, "http://EXAMPLE.net/en/#a", "", 1),
        (10, "http://a.b.example.com/de/\nx?y", "", 1), (11, "http://anexample.com/de/", "", 1), (12, "http://é.net/a://b/c", "<a href=//friend.io/x>", None),
        (None, "http://good.org/fr/", "x" * 500_000 + link("nice.io"), 1),
    ]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, Rule int")
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    rows = U.judge(pages, rules).collect()
    assert len(rows) == len(data)
    for r in rows:
        host, path = split(r.url)
        rule = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        assert not rule or r.verdict == rule[2]
    links = {("bad.example.com", "spam.io"): 1, ("friend.io", "bad.example.com"): 2, ("friend.io", "good.org"): 1, ("good.org", "nice.io"): 2, ("é.net", "friend.io"): 1}
    want = brute([(d[1], ()) for d in data], links)
    for r in rows:
        if r.host:
            assert abs(r.trust - want["trust"].get(r.host, 0)) < 1e-6 and abs(r.distrust - want["distrust"].get(r.host, 0)) < 1e-6
    by = {r.host: r.verdict for r in rows if r.rule is None}
    assert by["friend.io"] == "block" and by["user@nice.io:80"] == "allow" and by[""] == "allow"
    assert U.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_a_blocked_host_with_many_links_to_it_blocks_those_that_link_to_it_only(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    data = [(0, "http://bad.example.com/de/1", "")] + [(k, f"http://h{k}.io/", link("bad.example.com")) for k in range(1, 41)]
    data += [(41, "http://far.io/", link("h1.io", "h2.io")), (42, "http://mixed.io/", link("bad.example.com", "a.io", "b.io", "c.io")), (43, "http://good.org/fr/", link("liked.io")), (44, "http://liked.io/", link("bad.example.com", "a.io"))]
    rules = spark.createDataFrame(U.RULES, "host string, path string, verdict string")
    out = U.judge(spark.createDataFrame(data, "page_id long, url string, html string"), rules)
    assert set(out.columns) == {"page_id", "url", "html", "host", "path", "rule", "trust", "distrust", "verdict"}
    by = {r.host: r.verdict for r in out.collect() if r.rule is None}
    assert {h for h, v in by.items() if v == "block"} == {f"h{k}.io" for k in range(1, 41)} | {"far.io"}
