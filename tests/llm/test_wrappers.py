import json
import random
import re
import time
from html import unescape

import pytest

from spectrafleet.llm import html_tree, wrappers

BREAK = re.compile(r"</?(?:h1|p|ul|ol|li|div|blockquote)\b[^>]*>", re.I)


def article_of(html):
    """The text of the pages at hand by their one article element."""
    found = re.search(r"(?s)<article>(.*?)(?:</article>|$)", html or "")
    lines = [" ".join(unescape(re.sub(r"(?s)<!--.*?-->|<[^>]+>", " " if "<br" in x else "", x)).split()) for x in BREAK.split(re.sub("<br>", " ", found[1]))] if found else []
    return "\n".join(x for x in lines if x)


def texts_of(pages, order=None):
    """The library's steps without Spark: one wrapper for all pages."""
    trees = [html_tree.page_tree(p) for p in pages]
    out = None
    for t in [trees[k] for k in order] if order else trees:
        own = wrappers.wrapper_of(t)
        out = own if out is None else wrappers.aligned(out, own)
    plan = json.loads(json.dumps(wrappers.decided(json.loads(json.dumps(out)), len(pages))))
    return [wrappers.extract_text(t, plan) for t in trees]


def test_given_pages(spark):
    from spectrafleet.llm.queries import QUERIES

    pages = {r["page_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = QUERIES["op11_page_wrappers"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_of(pages[r["page_id"]]["html"]) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore".split()


def said(rng, n=12):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def plain_site(rng, k):
    """No landmark and no telling names: only the template tells."""
    paras = [said(rng) for _ in range(rng.randrange(1, 6))]
    head = said(rng, 4)
    extra = "<div><a href='/x'>Next story here</a></div>" if k % 3 == 0 else ""
    links = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, 4))
    html = (
        f"<html><body><div>Welcome to our little site</div><ul>{links}</ul>{extra}<div><h1>{head}</h1><div>" + "".join(f"<p>{p}</p>" for p in paras) + "</div></div>"
        "<div>All rights reserved by the owners of this place</div></body></html>"
    )
    return html, "\n".join([head, *paras])


def test_template_without_names_or_landmarks():
    rng = random.Random(1)
    pages, want = zip(*(plain_site(rng, k) for k in range(12)), strict=True)
    assert texts_of(pages) == list(want)
    for seed in range(5):
        order = list(range(12))
        random.Random(seed).shuffle(order)
        assert texts_of(pages, order) == list(want)


def named_site(rng, k):
    paras = [said(rng) for _ in range(rng.randrange(1, 6))]
    comments = "".join(f"<article class='comment'><p>{said(rng, 5)}</p></article>" for _ in range(rng.randrange(0, 4)))
    notice = "<div class='cookie-notice'><p>We use cookies.</p><button>Accept</button></div>" if k % 2 else ""
    ads = "<div class='ad-slot'><p>" + said(rng, 6) + "</p></div>"
    quote = f"<blockquote>{said(rng, 3)}</blockquote>" if k % 4 == 0 else ""
    html = (
        f"<!doctype html><html><head><title>{k}</title><style>p > a {{}}</style></head><body>{notice}<header id='top'><h1>Site</h1><p>Slogan {k}</p></header>"
        f"<nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div id='page'><div class='post-content'><h2>Title {k}</h2>"
        + ads.join(f"<p>{p}" for p in paras)
        + f"{quote}<form action=/><p>Sign up {k}</p><input name=q></form></div><div class='sidebar'><p>{said(rng, 30)}</p></div><div id='comments'>{comments}</div></div>"
        f"<div class='site-footer'>Contact {k}</div><script>var x = '<p>no</p>';</script></body></html>"
    )
    return html, "\n".join([f"Title {k}", *paras, *re.findall("<blockquote>(.*?)</blockquote>", quote)])


def test_names_of_blocks():
    rng = random.Random(2)
    pages, want = zip(*(named_site(rng, k) for k in range(10)), strict=True)
    assert texts_of(pages) == list(want)
    for p, w in zip(pages, want, strict=True):
        assert texts_of([p]) == [w]


def test_landmarks():
    page = "<body><header><h1>Site</h1></header><main><h1>Title</h1><aside>side</aside><article><header><h2>Sub</h2><p>by</p></header><p>One.<p>Two.</article><p>tail</p></main></body>"
    assert texts_of([page]) == ["Title\nSub\nOne.\nTwo."]
    form = "<body><form id=all><nav>menu</nav><div role=main><p>Body &amp; soul</div></form>"
    assert texts_of([form]) == ["Body & soul"]
    assert texts_of(["<body><article><p>a</p><section class=comments><article><p>reader</p></article></section></article>"]) == ["a"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("no markup at all", "no markup at all"),
        ("<p>a<br>b  c\n d</p>", "a b c d"),
        ("<p>x <b>y</b><i>z</i>&nbsp;&lt;p&gt; &#x41;&#233; &am &amp</p>", "x yz <p> Aé &am &"),
        ("<p>one<p>two</p>three</p>four", "one\ntwo\nthree\nfour"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<p title='a > b' class=\"x\">t</p>", "t"),
        ("<p>1 < 2 and <3</p>", "1 < 2 and <3"),
        ("<p>a<!-- <p>b --> c</p><!-- open <p>d", "a c"),
        ("<script>if (a < b) '</p>'</SCRIPT ><p>s</p><style>x", "s"),
        ("<p>shown<span hidden>no</span><span class=ad>buy</span> on</p><div style='display: none'>no</div>", "shown on"),
        ("<p>cut off <a href='x", "cut off"),
        ("<title>t</title><textarea>form</textarea><p>a</p>", "a"),
        ("<b><p>a</b><p>b", "a\nb"),
    ],
)
def test_single_pages(html, text):
    assert texts_of([html]) == [text]


def test_wrappers_find_groups_options_and_slots():
    one = html_tree.page_tree("<h1>A</h1><dl><dt>a<dd>1<dt>b<dd>2</dl><p>x</p><p>y</p><hr>")
    two = html_tree.page_tree("<h1>A</h1><div>new</div><dl><dt>a<dd>1</dl><p>z</p>")
    out = wrappers.aligned(wrappers.wrapper_of(one), wrappers.wrapper_of(two))
    by = {x[0]: x for x in out}
    assert [x[0] for x in out] == ["h1", "div>#", "dl", "p"] and by["div>#"][2] == wrappers._OPTIONAL and by["p"][2] == wrappers._REPEATED
    (group,) = by["dl"][1]
    assert group[0] == "(" and [x[0] for x in group[1]] == ["dt", "dd"] and group[2] & wrappers._REPEATED
    assert by["h1"][1][0][4] is not None and by["h1"][1][0][1] == 2 and by["p"][1][0][4] is None
    again = wrappers.aligned(out, wrappers.wrapper_of(two))
    assert wrappers.size_of(again) == wrappers.size_of(out)


def test_wrappers_stay_small():
    rng = random.Random(4)
    out = None
    for _ in range(300):
        page = "".join(f"<{t}>{said(rng, 2)}</{t}>" for t in rng.choices(["p", "h2", "ul", "pre", "blockquote"], k=rng.randrange(1, 30)))
        own = wrappers.wrapper_of(html_tree.page_tree(page))
        out = own if out is None else wrappers.aligned(out, own)
    assert wrappers.size_of(out) < 400


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "in" + "</div>" * 5000 + "<p>out</p>"
    assert texts_of([deep]) == ["in\nout"]
    muted = "<div>" * 300 + "<nav>menu</nav>text<span class=ad>ad</span>" + "</div>" * 300
    assert texts_of([muted]) == ["text"]
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article><footer>f</footer>"
    assert texts_of([long]) == ["\n".join(["word & word"] * 50_000)]


@pytest.mark.parametrize("html", ["<b>" * 60_000 + "x" + "</i>" * 60_000, "<div>" * 60_000 + "x", "</div>" * 60_000 + "<p>" * 60_000 + "x", "<ul>" * 3000 + "<li>x</p>" * 20_000, "<p title='" * 60_000, "<b>" * 60_000 + "</b>" * 60_000 + "x"])
def test_broken_markup_takes_time_in_proportion(html):
    began = time.process_time()
    wrappers.wrapper_of(html_tree.page_tree(html))
    assert time.process_time() - began < 5


def test_table_with_odd_rows(spark, monkeypatch):
    rng = random.Random(6)
    data = [(k, f"http://{h}.example/{k}", *site(rng, k)) for k, (h, site) in enumerate([("a", plain_site), ("B", named_site)] * 12)]
    data += [(1, data[1][1], data[1][2], data[1][3]), (50, None, "<article>x</article>", "x"), (51, "http://c/", None, ""), (None, "no host", "<p>y", "y"), (52, "http://d/", "", "")]
    df = spark.createDataFrame([(i, u, h, 7, "t") for i, u, h, _ in data], "page_id long, url string, html string, text int, _host string").repartition(7)
    want = sorted(((i, u, t, len(t)) for i, u, _, t in data), key=str)
    for limit, fan_in, held in ((1 << 20, 32, 1 << 20), (0, 2, 10)):
        monkeypatch.setattr(wrappers, "FAN_IN", fan_in)
        monkeypatch.setattr(wrappers, "HELD_NODES", held)
        got = wrappers.add_main_text(df, limit)
        assert got.columns == ["page_id", "url", "text", "_host", "_text", "n_chars"]
        assert sorted(((r["page_id"], r["url"], r["_text"], r["n_chars"]) for r in got.collect()), key=str) == want
    assert wrappers.add_main_text(df.limit(0)).count() == 0
