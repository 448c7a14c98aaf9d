"""URL rules whose block decisions reach the aliases of a URL. DataFrame functions only.

Aliases are the connected components over two kinds of edges: a page's canonical link and its
`http-equiv="refresh"` redirect. A URL with a rule of its own keeps that rule's verdict. A URL without
one is blocked if some member of its component is blocked and none is explicitly allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridhead.llm.common import written
from gridhead.llm.graph import components

#: (verdict, host, path): fits the host and its subdomains where the path starts with this one.
Rule = tuple[str, str, str]

RULES: Sequence[Rule] = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, or null. `rules` is a short policy list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


#: A name, and perhaps a value in double, single or no quotes.
_NAMED = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""
#: A tag of links, with `>` inside quotes being none of its ends.
_TAG = r"""(?is)(<(?:link|meta|base)(?=[\s/>"'])[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+){0,200}+>)"""
#: What is no markup: comments, scripts and styles, open ones up to the end.
_ASIDE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of this name, or the empty text; attributes are read one after the other."""
    body = F.regexp_replace(tag, r"^<[A-Za-z]+", " ")
    every = F.zip_with(F.regexp_extract_all(body, F.lit(_NAMED), F.lit(1)), F.regexp_extract_all(body, F.lit(_NAMED), F.lit(2)), lambda n, v: F.struct(F.lower(n).alias("name"), v.alias("value")))
    value = F.get(F.filter(every, lambda a: a["name"] == name), F.lit(0))["value"]
    return F.coalesce(F.regexp_replace(value, r"""^["']|["']$""", ""), F.lit(""))


def _absolute(url: Column, link: Column) -> Column:
    """`link` as seen from `url`: absolute, scheme-relative, host-relative or relative to the url's folder."""
    scheme, origin = F.regexp_extract(url, r"^([^:/?#]+):", 1), F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def _without_dots(path: Column) -> Column:
    """A path without its `.` and `..` segments."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    whole = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def walked(done: Column, part: Column) -> Column:
        return F.when(part == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    resolved = F.array_join(F.aggregate(whole, F.array().cast("array<string>"), walked), "/")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), resolved).otherwise(path)


def _decoded(text: Column) -> Column:
    """Text of an HTML attribute with its character references below 256 read: numeric ones, and those that addresses hold by name."""

    def numeric(text: Column, pattern: str, base: int) -> Column:
        codes = F.regexp_extract_all(text, F.lit(f"(?i)&#{pattern};"), F.lit(1))
        between = F.split(text, f"(?i)&#{pattern};", -1)
        read = F.transform(codes, lambda c: F.char(F.conv(c, base, 10).cast("int")))
        pieces = F.zip_with(between, F.concat(read, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
        return F.when(text.rlike(f"(?i)&#{pattern};"), F.array_join(pieces, "")).otherwise(text)

    plain = numeric(numeric(text, "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])", 10), "x0*([0-9a-f]{1,2})", 16)
    for name, value in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):  # the ampersand last: it is read once
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(value))
    return plain


def node_of(url: Column) -> Column:
    """A URL as a node of the alias graph: without fragment, dot segments and outer blanks, the scheme and host lower-cased."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    front = F.regexp_extract(bare, r"(?s)^[^:/?#]*://[^/?#]*", 0)
    path = F.regexp_extract(F.substr(bare, F.length(front) + 1), r"(?s)^[^?]*", 0)
    return F.concat(F.translate(front, _UPPER, _LOWER), _without_dots(path), F.substr(bare, F.length(front) + F.length(path) + 1))


def alias_edges(pages: DataFrame) -> DataFrame:
    """`u, v` (nodes): a page's URL and where its canonical link or redirect leads, seen from its base address if it has one.

    Links in comments, scripts and styles are none.
    """
    linked = pages.where(F.col("url").isNotNull() & F.col("html").rlike(r"(?i)canonical|http-equiv"))
    tags = F.regexp_extract_all(F.regexp_replace("html", _ASIDE, " "), F.lit(_TAG), F.lit(1))
    found = linked.select(F.trim("url").alias("url"), tags.alias("tags"))
    bases = F.filter("tags", lambda t: t.rlike(r"(?is)^<base\b.*\bhref\b"))
    base = F.nullif(F.trim(_decoded(_attribute(F.get(bases, F.lit(0)), "href"))), F.lit(""))
    seen = found.withColumn("seen_from", F.when(F.size(bases) > 0, _absolute(F.col("url"), base)))
    tag = seen.select("url", F.coalesce("seen_from", "url").alias("seen_from"), F.explode("tags").alias("tag")).where(~F.col("tag").rlike("(?i)^<base"))
    canonical = F.when(F.col("tag").rlike("(?i)^<link") & F.lower(_attribute(F.col("tag"), "rel")).rlike(r"(^|\s)canonical(\s|$)"), _attribute(F.col("tag"), "href"))
    redirect = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]+)", 1))
    links = tag.select("url", "seen_from", F.trim(_decoded(F.coalesce(canonical, redirect))).alias("link")).where("link <> ''")
    return links.select(node_of(F.col("url")).alias("u"), node_of(_absolute(F.col("seen_from"), F.col("link"))).alias("v"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`page_id, host, path, rule, verdict, component` of every row of `pages` (page_id, url, html).

    A null url or one without `://` has an empty host and path, no rule and verdict allow. `component` is the
    least alias, null for a URL without aliases. Rows may repeat, page_id too: equal rows give equal results. A very long
    html is searched whole. Further columns are ignored. An empty table gives an empty result.
    """
    edges = written(alias_edges(pages.select("url", "html")).distinct(), "url-edges")
    nodes = components(edges, "url-components")
    ruled = nodes.withColumn("verdict", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    judged = ruled.groupBy("component").agg((F.bool_or(F.coalesce(F.col("verdict") == "block", F.lit(False))) & ~F.bool_or(F.coalesce(F.col("verdict") == "allow", F.lit(False)))).alias("blocked"))
    aliases = written(nodes.join(judged, "component"), "url-aliases")
    own = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    own = own.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", node_of(F.col("url")))
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("blocked"), "block"), F.lit("allow"))
    return own.join(aliases, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")
