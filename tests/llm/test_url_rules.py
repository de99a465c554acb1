import random
import re
from urllib.parse import urljoin, urlsplit

import pytest

from spectrafleet.llm import url_rules
from tests.llm.test_near_copies import groups

RULES = url_rules.DEFAULT_RULES


def host_path(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def best_rule(host, path):
    fits = [(a, h, p) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def name(url):
    parts = urlsplit(urljoin(url, urlsplit(url).path or "/"))
    host, _ = host_path(url)
    return host + (parts.path or "/") + ("?" + urlsplit(url).query if "?" in url.split("#")[0] else "")


def brute(pages, links):
    """page_id -> (host, path, rule, verdict) with a plain union-find over (url, url) links."""
    urls = {u for ab in links for u in ab} | {u for _, u in pages if u and "://" in u}
    nodes = {name(u) for u in urls}
    root = groups(sorted(nodes), [(name(a), name(b)) for a, b in links])
    linked = {name(u) for ab in links if name(ab[0]) != name(ab[1]) for u in ab}
    votes = {}
    for u in urls:
        if name(u) in linked and (r := best_rule(*host_path(u))):
            votes.setdefault(root[name(u)], set()).add(r[0])
    out = []
    for page_id, url in pages:
        host, path = host_path(url)
        own, passed = best_rule(host, path), None
        if url and "://" in url and name(url) in linked and (v := votes.get(root[name(url)])):
            passed = "allow" if "allow" in v else "block"
        out.append((page_id, host, path, own and own[1] + own[2], own[0] if own else passed or "allow"))
    return sorted(out, key=str)


def judged(spark, rows, links=None):
    pages = spark.createDataFrame([(i, u, h, "x", "y", 1) for i, u, h in rows], "page_id long, url string, html string, host string, rule string, node int")
    return sorted((tuple(r)[:5] for r in url_rules.judge_urls(pages, url_rules.default_rules(spark), links).collect()), key=str)


def canonical(target):
    return f'<html><head><link rel="canonical" href="{target}"></head></html>'


@pytest.mark.parametrize(
    ("url", "html", "target"),
    [
        ("http://a.com/x/y?q=1", canonical("../b"), "http://a.com/b"),
        ("http://a.com/x/y", canonical("./b/./c/../d"), "http://a.com/x/b/d"),
        ("http://a.com/x/y", canonical("?q=2"), "http://a.com/x/y?q=2"),
        ("http://a.com", canonical("b"), "http://a.com/b"),
        ("https://A.com/x", canonical("//B.net/z#frag"), "https://b.net/z"),
        ("http://a.com/x", canonical("/b?a=1&amp;c=2"), "http://a.com/b?a=1&c=2"),
        ("http://a.com/x", canonical(" \n http://b.net/ "), "http://b.net/"),
        ("http://a.com/x", "<LINK HREF='http://b.net/p' REL='alternate Canonical'>", "http://b.net/p"),
        ("http://a.com/x", "<link href=http://b.net/p rel=canonical>", "http://b.net/p"),
        ("http://a.com/x", '<meta http-equiv="Refresh" content="0; url=\'http://b.net/q\'">', "http://b.net/q"),
        ("http://a.com/x", "<meta content='5;URL=next' http-equiv=refresh>", "http://a.com/next"),
        ("http://a.com/x", "<!-- " + canonical("/b") + " -->", None),
        ("http://a.com/x", "<!-- open " + canonical("/b"), None),
        ("http://a.com/x", "<script>var a = '" + canonical("/b") + "'</script>", None),
        ("http://a.com/x", '<link data-rel="canonical" href="/b">', None),
        ("http://a.com/x", '<link rel="canonical-ish" href="/b">', None),
        ("http://a.com/x", canonical("mailto:me@b.net"), None),
        ("http://a.com/x", "the canonical refresh", None),
        ("no url", canonical("/b"), None),
        (None, canonical("/b"), None),
        ("http://a.com/x", None, None),
    ],
)
def test_links_of_a_page(spark, url, html, target):
    pages = spark.createDataFrame([(url, html)], "url string, html string")
    got = [tuple(r) for r in url_rules.page_links(pages).select(url_rules._node(url_rules.F.col("a")), url_rules._node(url_rules.F.col("b"))).collect()]
    assert got == ([(name(url), name(target))] if target else [])


def test_verdicts_against_plain_union_find(spark):
    rng = random.Random(6)
    hosts = ["a.com", "b.net", "sub.b.net", "example.net", "x.example.com", "y.org", "Z.org", "xnet", "net"]
    paths = ["", "/", "/en/1", "/de/1", "/fr/2", "/other?q=1", "/p/q"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths]
    rows, links = [], []
    for i, u in enumerate(urls + urls[:7]):
        target = rng.choice(urls)
        kind = rng.randrange(4)
        html = canonical(target) if kind == 0 else f'<meta http-equiv=refresh content="0;url={target}">' if kind == 1 and rng.random() < 0.4 else "<p>text</p>"
        if html != "<p>text</p>":
            links.append((u, target))
        rows.append((i, u, html))
    rows += [(900, None, None), (901, "", "x"), (902, "plain words", "x"), (None, "http://b.net/", None), (903, "http://" + "a." * 5000 + "net/x", None), (903, "http://q.org/fr/", "x" * 200_000)]
    assert judged(spark, rows) == brute([(i, u) for i, u, _ in rows], links)
    more = [("http://q.org/fr/", "http://a.com/"), ("http://q.org/fr/", "http://q.org/fr/"), ("http://sub.b.net/p/q", "http://unseen.net/")]
    log = spark.createDataFrame([*more, (None, "http://a.com/")], "a string, b string")
    assert judged(spark, rows, log) == brute([(i, u) for i, u, _ in rows], links + more)


def test_allow_goes_before_block_and_an_empty_path_has_no_vote(spark):
    def chain(*urls):
        return [(i, u, canonical(urls[i + 1]) if i + 1 < len(urls) else None) for i, u in enumerate(urls)]

    verdicts = lambda rows: [r[4] for r in judged(spark, rows)]
    assert verdicts(chain("http://a.com/", "http://c.com/", "http://b.net/")) == ["block"] * 3
    assert verdicts(chain("http://a.com/", "http://b.net/", "http://q.org/fr/")) == ["allow", "block", "allow"]
    assert verdicts(chain("http://a.com/", "http://b.net")) == ["allow", "allow"]
    assert verdicts(chain("http://a.com/", "http://c.com/", "http://a.com/")) == ["allow"] * 3
    assert judged(spark, []) == []


def test_long_hosts_give_few_suffixes(spark):
    urls = spark.createDataFrame([("a." * 20_000 + "example.net", "/en/")], "host string, path string")
    (row,) = url_rules.match_rules(urls, url_rules.default_rules(spark)).collect()
    assert (row["rule"], row["action"]) == ("example.net/en/", "allow")
