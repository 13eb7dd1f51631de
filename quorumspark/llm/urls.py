"""URL filters with redirect equivalence, in DataFrame operations only.

Host and path rules decide pages by the longest rule that fits. Canonical links and redirects make addresses aliases of each other; connected components over
these edges carry a block decision to all aliases that have no rule of their own, unless a
member of the component is allowed by a rule: an explicit allow takes precedence.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumspark.llm._graph import components, written

#: The rules of the query's contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """An address without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, "://[^/?#]*([^#]*)", 1))


def resolved(link: Column, url: Column) -> Column:
    """A link's absolute address: with a scheme, or relative to the scheme, the host or the page's folder."""
    link = F.trim(F.replace(link, F.lit("&amp;"), F.lit("&")))
    site = F.regexp_extract(url, "^(.*?://[^/?#]*)", 1)
    folder = F.concat(site, F.when(path_of(url).contains("/"), F.regexp_extract(path_of(url), "^(.*/)", 1)).otherwise(F.lit("/")))
    return F.when(link == "", F.lit(None)).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(url, "^(.*?):", 1), F.lit(":"), link)).when(link.startswith("/"), F.concat(site, link)).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:|^[?#]"), F.lit(None)).otherwise(F.concat(folder, link))


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b, url): nodes joined by a page's canonical link or redirect, and the target's address."""
    own = pages.where(F.col(url_col).contains("://")).select(F.col(url_col).alias("url"), F.explode(F.array(F.regexp_extract(html_col, _CANONICAL, 1), F.regexp_extract(html_col, _REFRESH, 1))).alias("link"))
    own = own.where("link != ''").select("url", resolved(F.col("link"), F.col("url")).alias("to")).where(F.col("to").contains("://"))
    return own.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"), F.explode(F.array("url", "to")).alias("url")).where("a != b")


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action) for distinct (host, path) that a rule fits: longest, then allow first.

    rules: (action, rule), a rule being a host and a path that begins with /. A join on every suffix of the host, so the number of rules is not bounded.
    """
    rules = rules.select("action", "rule", F.regexp_extract("rule", "^([^/]*)", 1).alias("suffix"), F.regexp_extract("rule", "^[^/]*(.*)$", 1).alias("start"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pairs = addresses.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = pairs.join(rules, "suffix").where(F.startswith(F.col("path"), F.col("start")))
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action")).alias("x"))
    return best.select("host", "path", "x.rule", "x.action")


def filter_urls(pages: DataFrame, rules: DataFrame | tuple = RULES, url_col: str = "url", html_col: str = "html", keep: tuple = ("page_id",), default: str = "allow") -> DataFrame:
    """(*keep, host, path, rule, verdict, propagated), one row for each page.

    verdict: the action of the longest rule that fits; else, if the page's component has an explicit
    allow, allow; else block if it has a block; else `default`. propagated: it came from the component.
    A null url, or one without ://, has an empty host and path and no aliases. A null html has no links. Rows that
    repeat each give a row; empty tables give an empty result; other columns are not looked at. A page's html is searched as one string.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(action).alias("action"), F.lit(rule).alias("rule")) for action, rule in rules))))
    url = F.col(url_col)
    rows = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), F.when(url.contains("://"), node_of(url)).alias("node"))
    # the html is searched once
    edges = written(alias_edges(pages, url_col, html_col))
    members = components(edges)
    named = edges.select(node_of(F.col("url")).alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    decided = named.join(ruled(named, rules), ["host", "path"]).join(members, "node")
    groups = decided.groupBy("root").agg(F.max(F.col("action") == "allow").alias("allowed"))
    aliases = members.join(groups, "root").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("spread"))
    out = rows.join(ruled(rows, rules), ["host", "path"], "left").join(aliases, "node", "left")
    return out.select(*keep, "host", "path", "rule", F.coalesce("action", "spread", F.lit(default)).alias("verdict"), (F.col("action").isNull() & F.col("spread").isNotNull()).alias("propagated"))
