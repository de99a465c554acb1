"""URL filters: domain rules, and block decisions carried over redirect and canonical links to equivalent pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower, connected_components, materialize

#: (action, host, path prefix)
DEFAULT_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: What a browser doesn't read as markup.
_UNREAD = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b|\z)|<style\b.*?(?:</style\b|\z)"
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_REFRESH = r"(?is)^\s*[\d.]*\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in double, single or no quotes; empty if it has none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or no '://'."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty for null or no '://'."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Join each distinct (host, path) with its longest matching rule: host, path, rule, action (both null if none).

    rules has action, host, path. Each host is expanded into its suffixes, so this is an equi-join and not a scan of
    all rules per url; longest means the longest host+path text, ties by rule text, then allow before block.
    """
    keyed = rules.select("action", F.col("host").alias("suffix"), F.col("path").alias("prefix"), F.concat("host", "path").alias("rule"))
    labels = F.split("host", r"\.")
    # No suffix of more labels than the longest rule's host can match, so that a host of any length gives few.
    most = rules.agg(F.max(F.size(labels))).first()[0] or 1
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.greatest(n - most + 1, F.lit(1)), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    hits = urls.select("host", "path", F.explode(suffixes).alias("suffix")).join(keyed, "suffix").filter(F.expr("startswith(path, prefix)"))
    best = F.min_by(F.struct("rule", "action"), F.struct((-F.length("rule")).alias("n"), F.col("rule"), F.col("action")))
    return hits.groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.rule", "r.action")


def _absolute(target: Column, url: Column) -> Column:
    """A link's target as a full url, by the page's own; null if it has another kind of scheme, like mailto:."""
    scheme, origin = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    here, folder = F.regexp_extract(url, r"(?s)^([^?#]*)", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.rlike(_SCHEME + "//"), target)
        .when(target.rlike(_SCHEME), F.lit(None).cast("string"))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .when(F.startswith(target, F.lit("?")), F.concat(here, target))
        .when(F.startswith(target, F.lit("#")) | (target == ""), url)
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def _without_dots(path: Column) -> Column:
    """A path with its '.' and '..' segments resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.least(F.size(acc), F.lit(1))))).otherwise(F.concat(acc, F.array(p))))
    kept = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"(?s)(?:^|/)\.\.?(?:/|\z)"), kept).otherwise(path)


def _node(url: Column) -> Column:
    """The page a url names: fragment dropped, scheme ignored, host lower-cased, dot segments resolved; an empty path is '/'."""
    path = _without_dots(url_path(url))
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    return F.concat(url_host(url), F.when(path == "", F.lit("/")).otherwise(path), query)


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b) urls joined by a canonical link or a meta refresh in html; comments, scripts and styles are not read.

    A link counts if canonical is one of its rel words. Of character references only &amp; is resolved.
    """
    html = F.regexp_replace("html", _UNREAD, " ")
    canonical = F.filter(F.regexp_extract_all(html, F.lit(_LINK), 0), lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical"))
    moves = F.filter(F.regexp_extract_all(html, F.lit(_META), 0), lambda t: F.lower(F.trim(_attribute(t, "http-equiv"))) == "refresh")
    targets = F.concat(F.transform(canonical, lambda t: _attribute(t, "href")), F.transform(moves, lambda t: F.regexp_extract(_attribute(t, "content"), _REFRESH, 1)))
    # The cheap test comes first: a page without either word is never scanned by the patterns.
    may = F.col("html").rlike("(?i)canonical|refresh") & F.contains(F.col("url"), F.lit("://"))
    found = pages.filter(may).select("url", F.explode(targets).alias("t")).select("url", F.regexp_replace(F.replace("t", F.lit("&amp;"), F.lit("&")), r"^\s+|\s+$", "").alias("t"))
    return found.filter("t <> ''").select(F.col("url").alias("a"), _absolute(F.col("t"), F.col("url")).alias("b")).filter("b is not null")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, component for every row of pages (page_id, url, html; others are ignored).

    A page's own longest rule decides. Without one, the page takes the decision of its equivalence class (pages
    joined by redirect and canonical links, over any number of hops): allow if a rule allows a member, else block if
    one blocks a member, else allow. Members are all urls that a link joins, and pages that name the same; a rule
    holds for the path as it was written. component is the class's smallest page key, null for unlinked pages.
    links may add further (a, b) url pairs, e.g. a crawler's redirect log. Null url: empty host and path, allow;
    null html: no links; repeated rows and pages of the same url stay and are judged alike; urls and pages may have
    any length; other columns are ignored; an empty table gives no rows.
    """
    located = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), _node(F.col("url")).alias("node"))
    matched = match_rules(located.select("host", "path").distinct(), rules)
    pairs = page_links(pages)
    if links is not None:
        pairs = pairs.unionByName(links.select("a", "b").filter("a is not null and b is not null"))
    pairs = materialize(pairs.distinct().select("a", "b", _node(F.col("a")).alias("node_a"), _node(F.col("b")).alias("node_b")), "url-links")
    if pairs.isEmpty():  # as for the given pages: then no join with classes is needed
        return located.join(matched, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    parts = materialize(connected_components(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "url-components"), "url-classes")
    linked = [pairs.select(F.col(f"node_{x}").alias("node"), url_host(F.col(x)).alias("host"), url_path(F.col(x)).alias("path")) for x in "ab"]
    members = located.select("node", "host", "path").join(parts.select("node"), "node", "left_semi").unionByName(linked[0]).unionByName(linked[1]).distinct()
    own = match_rules(members.select("host", "path").distinct(), rules)
    votes = members.join(own, ["host", "path"]).join(parts, "node").groupBy("component").agg(F.min("action").alias("passed"))  # allow sorts before block
    classes = parts.join(votes, "component", "left").select("node", "component", "passed")
    judged = located.join(matched, ["host", "path"], "left").join(classes, "node", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", "passed", F.lit("allow")).alias("verdict"), "component")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_RULES), "action string, host string, path string")
