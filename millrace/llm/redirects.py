"""Verdicts on the urls of pages: the longest rule that fits, and for the others what their aliases say.

Aliases are urls joined by redirects (`<meta http-equiv="refresh">`) and canonical links
(`<link rel="canonical">`), in either direction and over any number of steps: the connected components of
those edges. A url without a rule of its own is blocked where its component holds a blocked url, a page's
or only a target's, and no explicitly allowed one; a rule that fits a url itself always decides for it.
"""

from __future__ import annotations

import html
from collections.abc import Sequence
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.llm.components import components
from millrace.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: So many blocked aliases are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
SKIPPED = r"(?is)<!--.*?(?:-->|\z)|<(script|style|noscript|template|textarea|title)\b.*?(?:</\1|\z)"
TAG = r"""(?is)<((?:link|meta|base)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
ATTRIBUTE = r"""(?is)([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?"""
REFRESH = r"""(?is)^\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?["']?(.*?)["']?\s*$"""


class Rule(NamedTuple):
    """allow or block for a host with all its subdomains, and the paths that begin with path."""

    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_node(url: Column) -> Column:
    """The url that a request would name: scheme and host in lower case, no fragment, / for an empty path;
    null where there is no ://."""
    scheme = F.translate(F.substring_index(url, "://", 1), UPPER, LOWER)
    path, query = url_path(url), F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), url_host(url), F.when(path == "", "/").otherwise(path), query))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (ties: the longer host), else null."""
    fits = None
    for r in sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host))):
        hit = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        made = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        fits = F.when(hit, made) if fits is None else fits.when(hit, made)
    return F.lit(None).cast("struct<rule: string, verdict: string>") if fits is None else fits


@F.pandas_udf(StringType())
def _target(page: pd.Series, base: pd.Series, href: pd.Series) -> pd.Series:
    """href as an absolute url; null where it can't be read as one."""

    def one(page: str, base: str, href: str) -> str | None:
        try:
            return urljoin(urljoin(page, html.unescape(base).strip()), html.unescape(href).strip())
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(page, base, href, strict=True)], dtype=object)


def _attribute(tag: Column, name: str) -> Column:
    """The first attribute of that name, without its quotes; empty where there is none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 1), F.lower)
    value = F.try_element_at(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), 2), F.array_position(names, name).cast("int"))
    return F.regexp_replace(F.when(F.array_contains(names, name), value).otherwise(""), r"""^["']|["']$""", "")


def alias_edges(pages: DataFrame, url: str = "url", text: str = "html") -> DataFrame:
    """(a, b): url nodes that a redirect or a canonical link of a page joins; comments, scripts and texts
    that aren't markup are passed over. Null urls, null pages and targets without a scheme give none."""
    named = pages.where(F.col(text).rlike(r"(?i)canonical|refresh") & url_node(F.col(url)).isNotNull())
    tags = F.regexp_extract_all(F.regexp_replace(text, SKIPPED, " "), F.lit(TAG), 1)
    found = named.select(F.col(url).alias("page"), tags.alias("tags"))
    bases = F.filter("tags", lambda t: t.rlike(r"(?i)^base\b") & (_attribute(t, "href") != ""))
    found = found.select("page", F.when(F.size(bases) > 0, _attribute(bases[0], "href")).otherwise("").alias("base"), F.explode("tags").alias("tag"))
    canonical = F.col("tag").rlike(r"(?i)^link\b") & F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = F.col("tag").rlike(r"(?i)^meta\b") & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh")
    href = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.regexp_extract(_attribute(F.col("tag"), "content"), REFRESH, 1))
    found = found.select("page", "base", F.trim(href).alias("href")).where("href <> ''")
    ends = found.select(url_node(F.col("page")).alias("a"), url_node(_target("page", "base", "href")).alias("b"))
    return ends.where("a <> b").distinct()


def blocked_aliases(edges: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Nodes of edges (a, b) without a rule whose component holds a blocked node and no allowed one."""
    known = longest_rule(url_host(F.col("v")), url_path(F.col("v")), rules)
    nodes = written(components(edges).withColumn("own", known["verdict"]), "aliases")
    judged = nodes.groupBy("label").agg(F.bool_or(F.col("own") == "block").alias("block"), F.bool_or(F.col("own") == "allow").alias("allow"))
    judged = judged.where("block AND NOT coalesce(allow, false)").select("label")
    return written(nodes.where("own IS NULL").join(judged, "label").select("v"), "blocked")


def verdicts(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """key, host, path, rule (null: none fits) and verdict (allow or block) of each page.

    A null url or one without :// has an empty host and path, no aliases, and is allowed unless a rule fits
    it. Repeated rows and null keys give a row each; no rows give none; other columns are not read.
    """
    blocked = blocked_aliases(alias_edges(pages.select(url, text), url, text), rules)
    if blocked.count() <= BROADCAST_ROWS:
        blocked = F.broadcast(blocked)
    own = pages.select(F.col(key), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), url_node(F.col(url)).alias("v"))
    own = own.withColumn("fits", longest_rule(F.col("host"), F.col("path"), rules))
    ruled = own.where("fits IS NOT NULL").select(key, "host", "path", "fits.rule", "fits.verdict")
    free = own.where("fits IS NULL").join(blocked.withColumn("hit", F.lit(True)), "v", "left")
    free = free.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    return ruled.unionByName(free)
