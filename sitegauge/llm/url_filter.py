"""URL filter that carries block decisions over to aliases of a page.

Rules judge host and path. Redirect and canonical-link edges say that two addresses are the same page: their connected
components are alias classes. An address without a rule of its own is blocked when any address of its class is blocked by a
rule, else allowed. An explicit rule always wins over what the class says, so an explicit allow shields its address from
blocked aliases. All of it is DataFrame work.

An address is a url without its fragment, host in lower case. Edges come from ``<link rel=canonical>`` and ``<meta
http-equiv=refresh>`` of a page's html (absolute or relative to the page or its ``<base href>``), or from a redirect table given by the caller.

* NULL urls and urls without ``://`` have empty host and path, match no rule, and take part in no class: they are allowed.
* Repeated rows are judged alike and all returned. Rules of equal length cannot both fit one url unless they are the same rule; then
  block wins. Empty tables give empty results. Extra columns are kept only where asked for (``keep``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.components import connected_components
from sitegauge.llm.storage import load, save

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    host: str
    path: str
    block: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", False),
    Rule("example.org", "/es/", True),
    Rule("example.org", "/en/1", True),
    Rule("com", "/fr/", False),
    Rule("com", "/de/", True),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for NULL or without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """Url without fragment, scheme and host in lower case; NULL where there is no ``://``."""
    tail = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    start = F.regexp_extract(url, r"(?s)^(.*?://)", 1)
    address = F.concat(F.lower(start), host_of(url), F.when(tail == "", F.lit("/")).otherwise(tail))
    return F.when(start != "", address)


def rule_number(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Position in ``rules`` of the longest rule that fits; NULL without one."""
    best = F.lit(None).cast("int")
    for n, rule in sorted(enumerate(rules), key=lambda r: (len(r[1].text), r[1].block)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        best = F.when(fits, F.lit(n)).otherwise(best)
    return best


def number_of_address(address: Column, rules: Sequence[Rule] = RULES) -> Column:
    return rule_number(host_of(address), path_of(address), rules)


def _by_number(values: list, number: Column) -> Column:
    return F.get(F.lit(values), number)


def _without_dots(path: Column) -> Column:
    """A path from the root without ``.`` and ``..``."""
    parts = F.split(path, "/", -1)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"), lambda a, p: F.when(p == ".", a).when(
        p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    open_ = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_, F.lit("/")).otherwise(F.lit("")))


def _resolved(target: Column, base: Column) -> Column:
    """Absolute form of a link on the page ``base``; NULL for links with a scheme but no host (mail, scripts)."""
    scheme = F.substring_index(base, "://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(base))
    path = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(base), r"(?s)^/(.*/)", 1))
    page = F.concat(origin, F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base)))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
            .when(F.startswith(target, F.lit("/")), F.concat(origin, _without_dots(path), rest))
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(F.startswith(target, F.lit("?")), F.concat(page, target))
            .when(F.startswith(target, F.lit("#")), F.concat(F.substring_index(base, "#", 1), target))
            .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest)))


def page_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between addresses, from the canonical and refresh links in the html of ``pages`` (url, html)."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
                    lambda t: t.rlike(r"(?i)rel\s*=\s*[\"']?canonical\b") | t.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh\b"))
    href = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    refresh = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
    target = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract("tag", href, 1), F.lit("")),
                                         F.nullif(F.regexp_extract("tag", refresh, 1), F.lit(""))), "&amp;", "&")
    linking = pages.filter(F.col("html").rlike(r"(?i)\b(?:canonical|refresh)\b"))
    given = F.regexp_replace(F.nullif(F.regexp_extract("html", r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit("")), "&amp;", "&")
    base = F.coalesce(_resolved(given, F.col("url")), F.col("url"))
    links = linking.select("url", base.alias("base"), F.explode(tags).alias("tag")).select("url", "base", target.alias("target"))
    return links.select(address_of(F.col("url")).alias("a"), address_of(_resolved(F.col("target"), F.col("base"))).alias("b"))


def filter_urls(pages: DataFrame, edges: DataFrame, rules: Sequence[Rule] = RULES, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of ``pages`` with host, path, rule and verdict. ``edges`` links addresses (a, b)."""
    parts = load(pages.sparkSession, save(connected_components(edges), "aliases"))
    texts, blocks = [r.text for r in rules], [r.block for r in rules]
    number = rule_number(F.col("host"), F.col("path"), rules)
    own = parts.select("component", number_of_address(F.col("node"), rules).alias("number"))
    blocked = own.filter(F.col("number").isin([n for n, b in enumerate(blocks) if b])).select("component").distinct()
    aliases = parts.join(blocked, "component").select(F.col("node").alias("address"), F.lit(True).alias("inherited"))
    judged = pages.select(*[F.col(k).alias(f"kept_{k}") for k in keep], host_of(F.col("url")).alias("host"),
                          path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("address"))
    judged = judged.withColumn("number", number).join(aliases, "address", "left")
    block = F.coalesce(_by_number(blocks, F.col("number")), "inherited", F.lit(False))
    return judged.select(
        *[F.col(f"kept_{k}").alias(k) for k in keep], "host", "path", _by_number(texts, F.col("number")).alias("rule"),
        F.when(block, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
