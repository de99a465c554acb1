"""HTML main text by wrappers: union-free regular expressions over the blocks of a host's pages.

Pages of a host are aligned one after the other. Where the wrapper so far and a page differ, the mismatch is resolved:
blocks that follow themselves become repeated groups, blocks that one side lacks become optional, and texts become
slots. Tasks align the pages that they have, and their wrappers are aligned in turn, FAN_IN at a time, so that a host of
any size is no one task's. What the slots hold over all pages of a host then says which of them are the article.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from ._shared import ascii_lower, materialize, spare
from .html_tree import ARTICLE, CONTENT, DROP, HEADER, MAIN, bare, page_tree, tag_and_role

#: Wrappers that one task aligns in a round.
FAN_IN = 32
#: Blocks and slots of wrappers that a task holds before it hands them on.
HELD_NODES = 200_000
#: Wrappers that are broadcast, in bytes; beyond it they are joined by host.
BROADCAST_BYTES = 8 << 20
#: Blocks in a repeated group, at most.
MAX_GROUP = 4
#: Nodes side by side, at most; more become one group in any order.
MAX_SIBLINGS = 24
#: Pages from which on a text that all share is the template's.
TEMPLATE_PAGES = 3

# Nodes: a slot is ["#", pages, characters, characters in links, digest of its one text or None]; a block is
# [label, nodes, flags]; a group of several blocks has the label "(", and "*" if they come in any order.
_OPTIONAL, _REPEATED = 1, 2


def _key(node: list) -> tuple:
    return ("(", *(_key(x) for x in node[1])) if node[0] == "(" else (node[0],)


def _keys(nodes: list) -> list:
    return [_key(x) for x in nodes]


def _merge(a: list, b: list, one_page: bool) -> list:
    """Two nodes of one key as one; one_page: both occur in each page, else the pages of both add up."""
    if a[0] == "#":
        return ["#", max(a[1], b[1]) if one_page else a[1] + b[1], a[2] + b[2], a[3] + b[3], a[4] if a[4] == b[4] else None]
    return [a[0], aligned(a[1], b[1], one_page), a[2] | b[2]]


def _repeat(node: list) -> list:
    if node[0] != "#":
        node[2] |= _REPEATED
    return node


def folded(nodes: list) -> list:
    """nodes with blocks that follow themselves, alone or as a group of up to MAX_GROUP, made repeated."""
    out: list = []
    for node in nodes:
        out.append(node)
        while _fold_end(out):
            pass
    return out


def _fold_end(out: list) -> bool:
    if len(out) > 1 and _key(out[-1]) == _key(out[-2]):
        last = out.pop()
        out[-1] = _repeat(_merge(out[-1], last, True))
        return True
    for k in range(2, MAX_GROUP + 1):
        tail, before = out[-k:], out[-2 * k : -k] if len(out) >= 2 * k else None
        if len(out) > k and out[-k - 1][0] == "(" and _keys(out[-k - 1][1]) == _keys(tail):
            del out[-k:]
            out[-1] = ["(", _zipped(out[-1][1], tail), out[-1][2] | _REPEATED]
            return True
        if len(out) > k and out[-1][0] == "(" and _keys(out[-1][1]) == _keys(out[-k - 1 : -1]):
            group = out.pop()
            out[-k:] = [["(", _zipped(out[-k:], group[1]), group[2] | _REPEATED]]
            return True
        if before and _keys(before) == _keys(tail):
            del out[-k:]
            out[-k:] = [["(", _zipped(before, tail), _REPEATED]]
            return True
    return False


def _zipped(a: list, b: list) -> list:
    return [_merge(x, y, True) for x, y in zip(a, b, strict=True)]


def _optional(nodes: list) -> list:
    for x in nodes:
        if x[0] != "#":
            x[2] |= _OPTIONAL
    return nodes


def _members(nodes: list) -> list:
    return [y for x in nodes for y in (_members(x[1]) if x[0] in ("(", "*") else [x])]


def _in_any_order(nodes: list, more: list, one_page: bool) -> list:
    """All nodes as one repeated group of optional ones, each key once: (a? b? c?)+."""
    for known_by in (lambda x: x[0], lambda x: bare(x[0])):
        by: dict[str, list] = {}
        for side in (nodes, more):
            own: dict[str, list] = {}
            for x in _members(side):
                k = known_by(x)
                own[k] = _merge(own[k], x, True) if k in own else x
            for k, x in own.items():
                by[k] = _merge(by[k], x, one_page) if k in by else x
        if len(by) <= MAX_SIBLINGS:
            break
    out = _optional(list(by.values()))
    for k, x in by.items():
        x[0] = k
    return [["*", out, _REPEATED]]


def _matched(w: list, s: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence."""
    longest = [[0] * (len(s) + 1) for _ in range(len(w) + 1)]
    for i in range(len(w) - 1, -1, -1):
        row, below = longest[i], longest[i + 1]
        for j in range(len(s) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if w[i] == s[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(w) and j < len(s):
        if w[i] == s[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif longest[i + 1][j] >= longest[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(w: list, s: list, one_page: bool = False) -> list:
    """The nodes of a wrapper that has the pages of both.

    Nodes outside a longest common subsequence are optional; where that makes a node or a group follow its like, they
    are repeated. Lists of more than MAX_SIBLINGS nodes become one group in any order, so that wrappers stay small.
    """
    if any(x[0] == "*" for x in (*w[:1], *s[:1])):
        return _in_any_order(w, s, one_page)
    wk, sk = _keys(w), _keys(s)
    if wk == sk:
        return [_merge(a, b, one_page) for a, b in zip(w, s, strict=True)]
    out, i, j = [], 0, 0
    for x, y in (*_matched(wk, sk), (len(w), len(s))):
        out += _optional(w[i:x]) + _optional(s[j:y])
        if x < len(w):
            out.append(_merge(w[x], s[y], one_page))
        i, j = x + 1, y + 1
    return _bounded(folded(out))


def _bounded(nodes: list) -> list:
    return nodes if len(nodes) <= MAX_SIBLINGS else _in_any_order(nodes, [], True)


def wrapper_of(items: list) -> list:
    """A page's blocks as a wrapper of this one page."""
    return _bounded(folded([["#", 1, len(x[0]), x[1], xxh32_intdigest(x[0])] if isinstance(x, tuple) else [x[0], wrapper_of(x[1]), 0] for x in items]))


def size_of(nodes: list) -> int:
    return sum(1 if x[0] == "#" else 1 + size_of(x[1]) for x in nodes)


def decided(nodes: list, pages: int) -> list:
    """The wrapper with, for each slot, ["#", main, rest]: whether it is article text, and whether it is on pages that have none of the former.

    Dropped roles are never text; of a header inside a landmark or a block named like content, headings are. Then the texts of an article element
    count, with headings of its main element; else those of main; else those of the innermost block named like content
    with most of the text; else, and for rest, all slots but menus of links and the template's constant texts.
    """
    slots: list[dict] = []

    def walk(nodes: list, dropped: bool, header: bool, marks: tuple, heading: bool, contents: tuple) -> list:
        out = []
        for x in nodes:
            if x[0] == "#":
                out.append({"node": x, "dropped": dropped or header and not (heading and (marks or contents)), "marks": marks, "heading": heading, "contents": contents})
                slots.append(out[-1])
                continue
            if x[0] in ("(", "*"):
                out.append(["(", walk(x[1], dropped, header, marks, heading, contents)])
                continue
            tag, role = tag_and_role(x[0])
            gone = dropped or role == DROP and not (tag == "form" and _holds_article(x[1]))
            inside = contents + (len(walked),) if role == CONTENT else contents
            if role == CONTENT:
                walked.append(len(contents))
            mark = marks + (role,) if role in (ARTICLE, MAIN) else marks
            head = heading or len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            out.append([x[0], walk(x[1], gone, header or role == HEADER, mark, head, inside)])
        return out

    walked: list[int] = []
    tree = walk(nodes, False, False, (), False, ())
    good = [s for s in slots if not s["dropped"]]
    chars = lambda some: sum(s["node"][2] for s in some)
    varies = any(s["node"][4] is None for s in good)
    for s in slots:
        _, n, length, links, value = s["node"]
        constant = varies and value is not None and n >= TEMPLATE_PAGES and 2 * n >= pages
        s["rest"] = not s["dropped"] and not constant and 2 * links <= length
    article = [s for s in good if ARTICLE in s["marks"]]
    main = [s for s in good if s["marks"]]
    if article and 2 * chars(article) >= chars(main):
        chosen = {id(s) for s in main if ARTICLE in s["marks"] or s["heading"]}
    elif main:
        chosen = {id(s) for s in main}
    else:
        rest = [s for s in slots if s["rest"]]
        best, least = None, chars(rest) / 2
        for k in sorted(range(len(walked)), key=lambda k: (walked[k], k)):
            if (held := chars(s for s in rest if k in s["contents"])) > 0 and held >= least:
                best, least = k, 0.9 * held
        chosen = {id(s) for s in good if best in s["contents"]} if best is not None else {id(s) for s in rest}

    def marked(x) -> list:
        if isinstance(x, dict):
            return ["#", int(id(x) in chosen), int(x["rest"])]
        return [x[0], [marked(y) for y in x[1]]]

    return [marked(x) for x in tree]


def _holds_article(nodes: list) -> bool:
    """Whether a form is the page's own shell: it holds a landmark or a first heading."""
    return any(x[0] != "#" and (tag_and_role(x[0])[1] in (ARTICLE, MAIN) or tag_and_role(x[0])[0] == "h1" or _holds_article(x[1])) for x in nodes)


def extract_text(items: list, wrapper: list) -> str:
    """The texts of a page's blocks in article slots of its host's decided wrapper, one a line."""
    found: list[tuple[str, int, int]] = []

    def walk(items: list, nodes: list | None, dropped: bool) -> None:
        nodes = _members(nodes) if nodes else []
        labels = [x[0] for x in nodes]
        at = 0
        for x in items:
            label = "#" if isinstance(x, tuple) else x[0]
            # this block again, a later one, or one before: a group that begins anew
            found_at = next((k for k in (*range(at, len(labels)), *range(at)) if labels[k] == label), None)
            if found_at is None and label != "#":
                short = bare(label)
                found_at = next((k for k, l in enumerate(labels) if l == short), None)
            node = nodes[found_at] if found_at is not None else None
            at = at if found_at is None else found_at
            if label != "#":
                gone = dropped or node is None and tag_and_role(label)[1] in (DROP, HEADER)
                walk(x[1], node[1] if node else None, gone)
            elif node is not None:
                found.append((x[0], node[1], node[2]))
            elif not dropped:
                found.append((x[0], 0, 1))

    walk(items, wrapper, False)
    lines = [t for t, main, _ in found if main] or [t for t, _, rest in found if rest]
    return "\n".join(lines)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' for null."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def _dumped(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"))


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to partial (host, part, pages, wrapper)."""
    task = TaskContext.get()
    held: dict[str, list] = {}
    nodes, part = 0, (task.partitionId() if task else 0) << 20

    def handed_on() -> Iterator[pa.RecordBatch]:
        nonlocal part
        if held:
            pages, wrappers = zip(*held.values(), strict=True)
            parts = range(part, part + len(held))
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(parts, pa.int64()), pa.array(pages, pa.int64()), pa.array(map(_dumped, wrappers))], ["host", "part", "pages", "wrapper"])
            part += len(held)
            held.clear()

    for batch in batches:
        for host, html in zip(batch.column(0), batch.column(1), strict=True):
            host, own = host.as_py(), wrapper_of(page_tree(html.as_py()))
            if host in held:
                pages, before = held[host]
                held[host] = [pages + 1, aligned(before, own)]
                nodes += max(0, size_of(held[host][1]) - size_of(before)) if pages % 16 == 0 else 0
            else:
                held[host] = [1, own]
                nodes += size_of(own)
            if nodes > HELD_NODES:
                yield from handed_on()
                nodes = 0
    yield from handed_on()


def _align_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["part", "wrapper"])
    wrappers = iter(map(json.loads, group["wrapper"]))
    out = next(wrappers)
    for w in wrappers:
        out = aligned(out, w)
    return pd.DataFrame({"host": group["host"].iloc[:1], "part": group["part"].iloc[:1], "pages": [int(group["pages"].sum())], "wrapper": [_dumped(out)]})


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, part, pages, wrapper) of pages (host, html, both without nulls): one row for each host, in rounds of FAN_IN wrappers."""
    schema = "host string, part long, pages long, wrapper string"
    table = materialize(pages.select("host", "html").mapInArrow(_infer, schema), "wrappers")
    most = table.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    groups = most
    while groups > 1:
        # a hash deals unevenly: this many groups hold FAN_IN wrappers on average
        groups = -(-groups // FAN_IN)
        bucket = F.pmod(F.xxhash64("part"), F.lit(groups)).alias("bucket")
        table = materialize(table.groupBy("host", bucket).applyInPandas(_align_group, schema), "wrappers")
    return table


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        plans = [_dumped(decided(json.loads(w.as_py()), p.as_py())) for w, p in zip(batch.column("wrapper"), batch.column("pages"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(plans, pa.string())], ["host", "plan"])


def _extractor(plan_of: Callable[[pa.RecordBatch, int], tuple[str, str]], keep: list[str], text: str, n_chars: str, html: str):
    """A function for mapInArrow; plan_of gives a row's host and plan."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, list] = {}
        for batch in batches:
            texts = []
            for k, page in enumerate(batch.column(html)):
                host, plan = plan_of(batch, k)
                if host not in parsed:
                    if len(parsed) >= 1000:
                        parsed.clear()
                    parsed[host] = json.loads(plan)
                texts.append(extract_text(page_tree(page.as_py()), parsed[host]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, text, n_chars])

    return extract


def add_main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pages (url, html, others) with text, the main text of html, and n_chars, its code points, for html.

    Null html is empty, and so is its text; pages of a null url, or one without ://, are a host of their own. Repeated
    rows each have their text. A column of pages that is named text or n_chars keeps its name, and the new one gets an
    underscore before it. No rows give no rows. Pages are read whole, whatever their length; blocks nested deeper than
    MAX_DEPTH count as part of the one at that depth.
    """
    host, html, plan = spare(pages, "_host", "_html", "_plan")
    text, n_chars = spare(pages, "text", "n_chars")
    keep = [c for c in pages.columns if c != "html"]
    rows = pages.withColumns({host: host_of(F.col("url")), html: F.coalesce("html", F.lit(""))}).select(*keep, host, html)
    wrappers = host_wrappers(rows.select(F.col(host).alias("host"), F.col(html).alias("html")))
    plans = materialize(wrappers.select("host", "pages", "wrapper").mapInArrow(_plans, "host string, plan string"), "plans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema) + f", `{text}` string, `{n_chars}` long"
    held = plans.agg(F.sum(F.octet_length("plan") + F.octet_length("host"))).first()[0] or 0
    if held <= broadcast_bytes:
        shared = pages.sparkSession.sparkContext.broadcast({r["host"]: r["plan"] for r in plans.collect()})

        def plan_of(batch: pa.RecordBatch, k: int) -> tuple[str, str]:
            name = batch.column(host)[k].as_py()
            return name, shared.value[name]

    else:
        rows = rows.join(plans.select(F.col("host").alias(f"{host}2"), F.col("plan").alias(plan)), F.col(host) == F.col(f"{host}2")).drop(f"{host}2")

        def plan_of(batch: pa.RecordBatch, k: int) -> tuple[str, str]:
            return batch.column(host)[k].as_py(), batch.column(plan)[k].as_py()

    return rows.mapInArrow(_extractor(plan_of, keep, text, n_chars, html), schema)
