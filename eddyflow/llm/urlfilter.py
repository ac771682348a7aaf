"""Operator 8, URL filters: rules by host and path, and redirect equivalence, in DataFrame functions only.

A rule fits its host and all hosts below it if the path starts with the rule's;
the longest rule that fits gives the verdict. Pages without a rule get it from
their aliases: canonical links and immediate redirects of the pages, and any
redirects given besides, are edges between addresses; in each connected
component an explicit allow decides first, else a block does, and the component's
verdict goes to all its addresses. Addresses without either are allowed.

Addresses are compared without scheme, fragment and case of the host. Defined
results: a null url, or one without ``://``, has an empty host and path, no rule
and no alias; null pages have no links; repeated rows get equal results; of
rules of equal length the one with the longer host decides, then allow; very
long pages are read whole; an empty table gives no row; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eddyflow.llm.common import components, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Links that name a page's own address; one pattern for either order of attributes.
CANONICAL = (
    r"""(?i)<link\s(?:[^<>]*\s)?rel\s*=\s*["']?canonical["']?\s(?:[^<>]*\s)?href\s*=\s*["']?([^"'\s<>]+)""",
    r"""(?i)<link\s(?:[^<>]*\s)?href\s*=\s*["']?([^"'\s<>]+)["']?\s(?:[^<>]*\s)?rel\s*=\s*["']?canonical""",
)
REFRESH = r"""(?i)<meta\s(?:[^<>]*\s)?http-equiv\s*=\s*["']?refresh["']?\s(?:[^<>]*\s)?content\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s<>]+)"""

#: The same with content before http-equiv.
REFRESH_TURNED = r"""(?i)<meta\s(?:[^<>]*\s)?content\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s<>]+)["']*\s(?:[^<>]*\s)?http-equiv\s*=\s*["']?refresh"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """The url without scheme and fragment, its host in lower case; null if it has no host."""
    rest = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def without_dots(path: Column) -> Column:
    """A path with its segments . and .. worked out."""
    parts = F.split(path, "/")
    up = lambda done, x: F.when(x == "..", F.regexp_replace(done, "/[^/]*$", "")).when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x))
    done = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(""), up)
    return F.when(path.contains("/."), F.concat(done, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))).otherwise(path)


def resolved(href: Column, url: Column) -> Column:
    """An absolute url for a link on a page; a link of a query or fragment alone is on the page's own path."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    site = F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*", 0)
    own = path_of(url)
    folder = F.coalesce(F.nullif(F.regexp_extract(own, "(?s)^.*/", 0), F.lit("")), F.lit("/"))
    whole = F.when(href.startswith("/"), href).when(href.rlike("^[?#]"), F.concat(own, href)).otherwise(F.concat(folder, href))
    path, rest = F.regexp_extract(whole, "^[^?#]*", 0), F.regexp_extract(whole, "(?s)^[^?#]*(.*)$", 1)
    return F.when(href == "", None).when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).when(href.startswith("//"), F.concat(F.lit("http:"), href)).otherwise(F.concat(site, without_dots(path), rest))


def links(pages: DataFrame, *, url: str = "url", page: str = "html") -> DataFrame:
    """Edges (a, b) between addresses: a page's own and the one its canonical link or redirect names."""
    told = F.coalesce(F.col(page), F.lit("")).rlike("(?i)canonical|http-equiv")
    rows = pages.filter(told & F.col(url).isNotNull()).select(F.col(url).alias("u"), F.explode(F.array(*(F.coalesce(*(F.nullif(F.regexp_extract(page, p, 1), F.lit("")) for p in either)) for either in (CANONICAL, (REFRESH, REFRESH_TURNED))))).alias("href"))
    return edges(rows.select("u", resolved(F.col("href"), F.col("u")).alias("v")), "u", "v")


def edges(redirects: DataFrame, source: str, target: str) -> DataFrame:
    """Edges (a, b) between the addresses of redirects given by url."""
    rows = redirects.select(address_of(F.col(source)).alias("a"), address_of(F.col(target)).alias("b"))
    return rows.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The rule that decides, as a struct (rule, verdict), or null. Rules are (verdict, host, path)."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "allow"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    return F.coalesce(*(F.when(f, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for f, (v, h, p) in zip(fits, ordered, strict=True)), F.lit(None))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Rows (key, host, path, rule, verdict) of every page. ``redirects`` may add (source, target) urls."""
    found = links(pages, url=url, page=page)
    if redirects is not None:
        found = found.unionAll(edges(redirects, "source", "target")).distinct()
    found = settle(found, "links")
    rows = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), address_of(F.col(url)).alias("address"))
    rows = rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    if not found.isEmpty():
        comp = components(found)
        as_url = F.concat(F.lit("http://"), F.col("node"))
        ruled = comp.select("node", "comp", rule_of(host_of(as_url), path_of(as_url), rules)["verdict"].alias("v"))
        sides = ruled.groupBy("comp").agg(F.max((F.col("v") == "allow").cast("int")).alias("allow"), F.max((F.col("v") == "block").cast("int")).alias("block"))
        told = settle(comp.join(sides, "comp").select(F.col("node").alias("address"), F.when(F.col("allow") == 1, "allow").when(F.col("block") == 1, "block").alias("alias")), "aliases")
        rows = rows.join(told, "address", "left")
    else:
        rows = rows.withColumn("alias", F.lit(None).cast("string"))
    return rows.select(key, "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias", F.lit("allow")).alias("verdict"))
