"""URL rules whose decisions spread over redirects and canonical links, as DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.llm.common import saved, table
from stockwright.llm.components import components

#: (verdict, host, path): a rule fits its host and all subdomains, if the url's path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), A_Z, a_z)


def path_of(url: Column) -> Column:
    # the group may be empty, so that the match never moves on to a second ``://``
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*((?:/[^?#]*)?)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct<rule, verdict>; null if none does. Of equally long ones the first in text order."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: ((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2]))
    return F.coalesce(*[F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ordered], F.lit(None).cast("struct<rule:string,verdict:string>"))


def without_dots(path: Column) -> Column:
    """A path without its segments . and .., each of which takes the segment before it along."""
    step = lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc).otherwise(F.array_append(acc, x))
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.array_join(kept, "/")).otherwise(path)


def normal_url(url: Column) -> Column:
    """What two spellings of one address share: lower-case host, path without dot segments and query; scheme, fragment and a
    last slash go.
    """
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), F.regexp_replace(F.concat(without_dots(path_of(url)), rest), r"/$", "")))


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute url; null for an empty link, a place in the page or one that isn't http. Dot segments stay."""
    link = F.btrim(link, F.lit(" \t\n\x0c\r"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link == "", None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(link.rlike("^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .when(F.startswith(link, F.lit("?")), F.concat(F.regexp_extract(base, r"(?s)^([^?#]*)", 1), link))
        .otherwise(F.concat(F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted or not, with the entities that addresses have; empty if it has none."""
    found = lambda k: F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", k)
    value = F.concat(found(1), found(2), found(3))
    for text, sign in (("&#38;", "&"), ("&#x26;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2f;", "/"), ("&#x2F;", "/"), ("&amp;", "&")):
        value = F.replace(value, F.lit(text), F.lit(sign))
    return value


def alias_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): normal urls that a page's canonical links and redirects (refresh, or its address in og:url) declare equal.

    All of a page count, in any order of attributes, but for those in comments. Null urls and pages have none.
    """
    html = F.regexp_replace(html_col, "(?s)<!--.*?-->", "")
    tags = F.when(F.col(html_col).rlike(r"(?i)canonical|og:url|refresh"), F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0))
    found = pages.select(F.col(url_col).alias("u"), F.explode(tags).alias("tag")).where(F.col("tag").rlike(r"(?i)canonical|og:url|refresh"))
    tag = F.col("tag")
    is_link = tag.rlike("(?i)^<link")
    canonical = F.when(is_link & F.array_contains(F.split(F.lower(attribute(tag, "rel")), r"\s+"), "canonical"), attribute(tag, "href"))
    social = F.when(~is_link & (F.lower(attribute(tag, "property")) == "og:url"), attribute(tag, "content"))
    refresh = F.when(~is_link & (F.lower(attribute(tag, "http-equiv")) == "refresh"), F.regexp_extract(attribute(tag, "content"), r"(?i)url\s*=\s*['\"]?([^'\"\s]+)", 1))
    found = found.select("u", F.coalesce(canonical, social, refresh).alias("link")).where("link <> ''")
    return found.select(normal_url(F.col("u")).alias("a"), normal_url(resolved(F.col("u"), F.col("link"))).alias("b")).where("a <> b")


def url_verdicts(pages: DataFrame, links: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages.

    A url's own longest rule decides first. A url without a rule takes its aliases' decision: urls joined by links (a, b) form
    a component; one explicitly allowed member makes the component allowed, else one blocked member makes it blocked, else
    it is allowed. Links may name urls that pages lacks. Null urls and urls without ``://``: empty host and path, no rule,
    allowed. Repeated rows give repeated rows; an empty table gives none.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    page = page.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), normal_url(F.col("url")).alias("node"))
    page = page.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    member = components(links)
    # a node stands for both spellings of its address, with and without a last slash
    full = F.concat(F.lit("http://"), F.col("node"), F.when(F.contains("node", F.lit("?")), "").otherwise("/"))
    decided = member.withColumn("own", rule_of(host_of(full), path_of(full), rules))
    flags = decided.groupBy("component").agg(F.max(F.col("own.verdict") == "allow").alias("allowed"), F.max(F.col("own.verdict") == "block").alias("blocked"))
    blocked = saved(member.join(flags.where("blocked and not coalesce(allowed, false)"), "component").select("node", F.lit("block").alias("spread")))
    page = page.join(blocked, "node", "left")
    return page.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), "spread", F.lit("allow")).alias("verdict"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_verdicts(pages, alias_links(pages))
