"""Operator 12: URL rules whose decisions reach a page's aliases.

A rule fits its host and all subdomains, for paths that start with its own; the longest fitting one decides. A page that no rule fits takes the decision of its aliases: pages and link
targets that redirects and canonical links join to it, directly or by others, found as connected components. There an allowed alias comes before a blocked one, and without either the page
is allowed. A page's own rule is never overruled.

A node of the graph is a URL without scheme and fragment, so the two schemes of a page are one. Its edges are the page's canonical links, its refresh redirects, what a table of recorded
redirects adds, and the redirect to its plain form that servers make: without default port, ``www.`` or ``m.``, tracking parameters and a closing slash.

Rules meet distinct (host, path) pairs in one equi-join on the parts of a URL that have a rule's shape (number of labels, length of the path); the table of rules is broadcast only if
Spark finds it small. Edges, labels and decisions are tables; the driver sees the rules' shapes and whether edges are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components

#: A rule: its verdict, host and path.
Rule = tuple[str, str, str]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"
TRACKING = r"&(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*"
LINK_TAG, META_TAG = r"(?i)<link\b[^<>]*>", r"(?i)<meta\b[^<>]*>"
CANONICAL, REFRESH = r"""(?i)\brel\s*=\s*["']?canonical\b""", r"""(?i)\bhttp-equiv\s*=\s*["']?refresh\b"""
HREF, TARGET = r"""(?i)\bhref\s*=\s*["']?([^"'\s<>]+)""", r"""(?i)\burl\s*=\s*["']?([^"'\s<>]+)"""
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.-]*://"


def host_of(url: Column) -> Column:
    """From the first ``://`` to the next ``/``, ``?`` or ``#``, A to Z in lower case; empty without one, and for nulls."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL without scheme and fragment; null where there is no host."""
    host = host_of(url)
    return F.when(host != "", F.concat(host, path_of(url), F.regexp_extract(url, URL, 3)))


def plain_form(node: Column) -> Column:
    """The node that servers redirect a node to."""
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(node, r"^[^/?]*", 0), ":(?:80|443)$", ""), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(node, r"^[^/?]*([^?]*)", 1), "/$", "")
    query = F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(node, r"\?(.*)$", 1)), TRACKING, "")
    return F.concat(host, path, F.when(F.length(query) > 1, F.concat(F.lit("?"), F.substr(query, F.lit(2)))).otherwise(""))


def linked(html: Column, url: Column) -> Column:
    """The nodes that a page's canonical links and refresh redirects name, relative ones below the page's folder."""
    pick = lambda tags, kind, address: F.transform(F.filter(F.regexp_extract_all(html, F.lit(tags), F.lit(0)), lambda t: t.rlike(kind)), lambda t: F.replace(F.regexp_extract(t, address, 1), F.lit("&amp;"), F.lit("&")))
    found = F.concat(pick(LINK_TAG, CANONICAL, HREF), pick(META_TAG, REFRESH, TARGET))
    here, folder = F.concat(F.lit("http://"), host_of(url)), F.regexp_replace(path_of(url), "[^/]*$", "")
    whole = F.transform(
        F.filter(found, lambda t: t != ""),
        lambda t: F.when(t.rlike(ABSOLUTE), t).when(t.startswith("//"), F.concat(F.lit("http:"), t)).when(t.startswith("/"), F.concat(here, t)).otherwise(F.concat(here, F.when(folder == "", "/").otherwise(folder), t)),
    )
    return F.when(html.rlike("(?i)canonical|refresh"), F.filter(F.transform(whole, node_of), lambda n: n.isNotNull()))


def match_rules(places: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` of those distinct ``host, path`` that a rule fits: the longest one; of equal lengths an allowing one, then the last by text."""
    if not isinstance(rules, DataFrame):
        rules = places.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
    rules = rules.select("verdict", F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    shapes = rules.select((F.size(F.split("rule_host", r"\.", -1))).alias("labels"), F.length("rule_path").alias("size")).distinct().collect()  # at most labels of a host x lengths of a path
    if not shapes:
        return places.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    parts = F.array(*[F.struct(F.substring_index("host", ".", -s["labels"]).alias("rule_host"), F.when(F.length("path") >= s["size"], F.substring("path", 1, s["size"])).alias("rule_path")) for s in shapes])
    tried = places.select("host", "path").distinct().select("host", "path", F.inline(parts)).filter("rule_path is not null")
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict"))
    return tried.join(rules, ["rule_host", "rule_path"]).groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule`` (null where none fits), ``verdict`` (``allow`` or ``block``) and ``decided_by`` (``rule``, ``alias`` or ``default``) of every row of ``pages`` (``page_id, url`` and maybe ``html``).

    ``redirects`` has recorded ones as ``source, target`` URLs. A null URL, or one without ``://``, has an empty host and path and no aliases. Null or repeated ids and repeated URLs keep
    all their rows; other columns are ignored; an empty table gives no rows. Relative links are taken as they stand, without resolving dots.
    """
    html = F.col("html") if "html" in pages.columns else F.lit(None).cast("string")
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"), linked(html, F.col("url")).alias("links"))
    pages = materialize(pages)  # read five times, by then without the pages' html
    edges = pages.select(F.col("node").alias("a"), F.explode("links").alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")))
    named = pages.select("node").unionByName(edges.select(F.col("a").alias("node"))).unionByName(edges.select(F.col("b").alias("node"))).filter("node is not null").distinct()
    plain = named.select(F.col("node").alias("a"), plain_form(F.col("node")).alias("b"))
    found = components(edges.filter("a is not null and b is not null").unionByName(plain).filter("a <> b"))
    # Decisions of the rules on every URL that a page or a link names; plain forms that nobody names decide nothing.
    places = found.join(named.withColumnRenamed("node", "id"), "id").select("id", "component", F.regexp_extract("id", r"^[^/?]*", 0).alias("host"), F.regexp_extract("id", r"^[^/?]*([^?]*)", 1).alias("path"))
    decided = places.join(match_rules(places, rules), ["host", "path"]).groupBy("component").agg(F.min("verdict").alias("alias"))  # allow comes before block
    aliases = materialize(found.join(decided, "component").select(F.col("id").alias("node"), "alias"))
    out = pages.join(match_rules(pages, rules), ["host", "path"], "left").join(aliases, "node", "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", "alias", F.lit("allow")).alias("verdict"), by.alias("decided_by"))
