"""Small helpers for one HTML page: its balanced tree of blocks, and what tags and attributes say of a block's role."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTES = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4"
    " h5 h6 head header hgroup hr html iframe legend li main menu nav noembed noframes noscript object ol optgroup option p pre script section select style"
    " summary svg table tbody td template textarea tfoot th thead title tr ul video audio canvas xmp".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that end an open paragraph.
_END_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav"
    " ol p pre section summary table ul li dd dt".split()
)
#: Open tags that an opening tag ends, and those behind which it looks no further.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "caption"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
_SCOPE = frozenset("table td th caption button template object html".split())
_TABLE_SCOPE = frozenset(["table", "html", "template"])

#: What a block is: of no role, not article text, a header, a landmark of the article, or named like content.
NONE, DROP, HEADER, MAIN, ARTICLE, CONTENT = "", "-", "^", "*", "!", "+"

_DROP_TAGS = frozenset(
    "nav footer aside form script style noscript template button select option optgroup textarea dialog menu iframe svg object audio video canvas head title"
    " noembed noframes".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
_DROP_WORDS = frozenset(
    "ad ads adsense adslot adunit adbox nav menu submenu sidebar side aside rail widget widgets footer foot banner notice notices alert popup modal overlay toast"
    " consent gdpr form search login signin signup register share sharing social related replies reply respond discussion copyright skip pager toolbar topbar"
    " tooltip dropdown".split()
)
_DROP_STARTS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "navbar", "navig", "newsletter", "paginat", "promo", "recommend", "sponsor", "subscri", "sidebar")
_HEADER_WORDS = frozenset(["header", "masthead", "head"])
_CONTENT_WORDS = frozenset("article content entry post story main text body prose articlebody".split())
_SHELL_WORDS = frozenset("wrap wrapper container inner outer area block box section list item items group region panel row col column left right top bottom".split())
_MODIFIERS = frozenset("has with no not js is without hide show".split())

#: Deeper blocks are not nested: their text lies in the block at this depth.
MAX_DEPTH = 120
#: Labels of tags that are remembered.
_MAX_LABELS = 20_000


def _is_drop(word: str) -> bool:
    return word in _DROP_WORDS or word.startswith(_DROP_STARTS)


def role_of_name(name: str) -> str:
    """The role that one class or id tells by its first and last words."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in _MODIFIERS:
        return NONE
    while len(words) > 1 and words[-1] in _SHELL_WORDS:
        words.pop()
    first, last = words[0], words[-1]
    if _is_drop(first) or _is_drop(last):
        return DROP
    if first in _HEADER_WORDS or last in _HEADER_WORDS:
        return HEADER
    return CONTENT if any(w in _CONTENT_WORDS for w in words) else NONE


def role_of(tag: str, attributes: dict[str, str]) -> str:
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or _NOT_SHOWN.search(attributes.get("style", "")):
        return DROP
    own = attributes.get("role", "").strip().lower()
    if tag in ("html", "body"):
        return NONE
    if tag in _DROP_TAGS or own in _DROP_ROLES:
        return DROP
    named = [role_of_name(n) for n in (*attributes.get("class", "").split(), *attributes.get("id", "").split())]
    if DROP in named:
        return DROP
    if tag == "article" or own == "article" or attributes.get("itemprop") == "articleBody":
        return ARTICLE
    if tag == "main" or own == "main":
        return MAIN
    if tag == "header" or HEADER in named:
        return HEADER
    return CONTENT if CONTENT in named else NONE


def attributes_of(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


_labels: dict[tuple[str, str], tuple[str, str]] = {}


def _labelled(tag: str, text: str) -> tuple[str, str]:
    """(label, role) of an opening tag: a block is known by its tag, role and first class or id, without digits."""
    if (known := _labels.get((tag, text))) is None:
        attributes = attributes_of(text) if text else {}
        role = role_of(tag, attributes)
        name = next(iter((*attributes.get("class", "").split(), *attributes.get("id", "").split())), "")
        if len(_labels) >= _MAX_LABELS:
            _labels.clear()
        name = re.sub(r"\d+", "", name) if tag not in ("html", "body") else ""
        known = _labels[tag, text] = (f"{tag}{role}.{name}" if name else f"{tag}{role}", role)
    return known


def bare(label: str) -> str:
    """The tag and role of a label, without names and without what the block begins with."""
    return label.split(".", 1)[0].split(">", 1)[0]


def tag_and_role(label: str) -> tuple[str, str]:
    head = bare(label)
    return (head[:-1], head[-1]) if head[-1:] in (DROP, HEADER, MAIN, ARTICLE, CONTENT) else (head, NONE)


def _settle(items: list) -> None:
    """Tell nameless containers apart by what they begin with."""
    for x in items:
        if not isinstance(x, tuple):
            _settle(x[1])
            if x[0] in ("div", "section"):
                x[0] += ">" + ("#" if x[1] and isinstance(x[1][0], tuple) else bare(x[1][0][0]) if x[1] else "")


def page_tree(html: str) -> list:
    """The blocks of a page as nested [label, items]; a text is (text, characters of it inside links), white space made one.

    Missing end tags are supplied as browsers do for the usual cases, stray ones are ignored. Inline tags leave no trace
    but their text; of hidden and dropped ones not even that. Blocks below MAX_DEPTH are flat.
    """
    root: list = []
    # open tags: (tag, items of its block or None if inline or flat, mutes, is a link)
    stack: list[tuple[str, list | None, bool, bool]] = []
    #: How often each tag is open, and the items of the open blocks that are nested.
    opened: Counter[str] = Counter()
    nested = [root]
    items, pieces, links = root, [], 0
    depth = muted = linked = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                items.append((text, min(links, len(text))))
            pieces.clear()
        links = 0

    def pop_to(k: int) -> None:
        nonlocal items, depth, muted, linked
        if any(stack[i][0] in _BLOCKS for i in range(k, len(stack))):
            flush()
        while len(stack) > k:
            tag, own, mutes, link = stack.pop()
            opened[tag] -= 1
            muted -= mutes
            linked -= link
            if own is not None:
                depth -= 1
                nested.pop()
        items = nested[-1]

    def end(tags: frozenset, stop: frozenset) -> bool:
        if not any(opened[t] for t in tags):
            return False
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                pop_to(k)
                return True
            if stack[k][0] in stop:
                return False
        return False

    def add(text: str) -> None:
        nonlocal links
        if text and not muted:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if linked:
                links += len(text)

    at, n = 0, len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        add(html[at:lt])
        after = html[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            if html.startswith("<!--", lt):
                close = html.find("-->", lt + 4)
                at = n if close < 0 else close + 3
            else:
                close = html.find(">", lt)
                at = n if close < 0 else close + 1
            continue
        closing = after == "/"
        name = _NAME.match(html, lt + 1 + closing)
        if not name:
            if closing:
                close = html.find(">", lt)
                at = n if close < 0 else close + 1
            else:
                add("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        stop = html.find(">", name.end())
        if stop < 0:
            break  # a tag that the page ends in
        text = html[name.end() : stop]
        if '"' in text or "'" in text:
            if found := _ATTRIBUTES.match(html, name.end()):
                stop = found.end() - 1
                text = html[name.end() : stop]
        at = stop + 1
        if closing:
            if tag == "br":
                add(" ")
            elif tag in _BLOCKS:
                flush()
                stops = frozenset(["ul", "ol"]) | _SCOPE if tag == "li" else _TABLE_SCOPE - {tag} if tag in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption") else _SCOPE - {tag}
                end(frozenset([tag]), stops)
            elif opened[tag]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
                    if stack[k][0] in _BLOCKS:
                        break
            continue
        block = tag in _BLOCKS
        if block:
            flush()
            if tag in _END_P:
                end(frozenset(["p"]), _SCOPE)
            if tag in _IMPLIED:
                end(*_IMPLIED[tag])
            if tag in _HEADINGS and stack and stack[-1][0] in _HEADINGS:
                pop_to(len(stack) - 1)
        label, role = _labelled(tag, text if block or "class" in text or "hidden" in text or "style" in text or "role" in text else "")
        if tag in _VOID:
            if tag == "br":
                add(" ")
            continue
        if tag in _RAW:
            # text is not markup here, and none of it is shown
            found = _RAW_END[tag].search(html, at)
            if not found:
                at = n
            else:
                close = html.find(">", found.end())
                at = n if close < 0 else close + 1
            if block:
                items.append([label, []])
            continue
        if block and depth < MAX_DEPTH:
            own: list = []
            items.append([label, own])
            items = own
            nested.append(own)
            stack.append((tag, own, False, False))
            depth += 1
        else:
            mutes = role == DROP
            stack.append((tag, None, mutes, tag == "a"))
            muted += mutes
            linked += tag == "a"
        opened[tag] += 1
    flush()
    _settle(root)
    return root
