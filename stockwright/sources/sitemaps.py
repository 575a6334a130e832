"""Sitemap files: a page of addresses each, and an index of them all, written by Spark and moved into place when all are complete."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockwright.functions.text import xml_escaped
from stockwright.operators.ordered import Ordered
from stockwright.sources.tables import rename_single_files, scratch

# The pages that are always there, with how often they change and how much they count, and the frame of a file.
STATIC_PAGES = (
    ("/", "daily", "1.0"), ("/build-lists", "daily", "0.9"), ("/search", "weekly", "0.7"), ("/about", "monthly", "0.6"), ("/pricing", "monthly", "0.6"),
    ("/support", "monthly", "0.5"), ("/contact-us", "monthly", "0.4"), ("/privacy-policy", "yearly", "0.3"), ("/terms-of-service", "yearly", "0.3"),
)
URLS_PER_PAGE = 20_000
HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'


@dataclass(frozen=True)
class Kind:
    """Addresses of one kind: rows (``key``, ``changed``), the path before a key, how often they change and how much they count."""

    name: str
    rows: DataFrame
    key: str
    changed: str
    path: str
    frequency: str
    priority: str


def entry(loc: Column, changed: Column | None, frequency: str, priority: str) -> Column:
    """An address's element; times are UTC to the second, and left out where they are null."""
    last = F.lit("") if changed is None else F.coalesce(F.concat(F.lit("\n    <lastmod>"), F.date_format(changed, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("</lastmod>")), F.lit(""))
    return F.concat(F.lit("  <url>\n    <loc>"), xml_escaped(loc), F.lit("</loc>"), last, F.lit(f"\n    <changefreq>{frequency}</changefreq>\n    <priority>{priority}</priority>\n  </url>"))


def entries(kind: Kind, site: str, per_page: int = URLS_PER_PAGE) -> DataFrame:
    """(kind, page, place, entry): each address by its key as text, pages from 1, places from 0. Null keys have no address."""
    rows = kind.rows.where(F.col(kind.key).isNotNull()).select(F.col(kind.key).cast("string").alias("k"), F.col(kind.changed).alias("at"))
    placed = Ordered(rows, ["k", "at"]).numbered("place").frame()
    page = (F.floor(F.col("place") / per_page) + 1).cast("long")
    return placed.select(F.lit(kind.name).alias("kind"), page.alias("page"), "place", entry(F.concat(F.lit(f"{site}{kind.path}/"), "k"), F.col("at"), kind.frequency, kind.priority).alias("entry"))


def file_name(kind: str, page: int) -> str:
    return f"sitemap-{kind}{'' if page == 1 else f'-{page}'}.xml"


def write_sitemap(spark: SparkSession, kinds: Sequence[Kind], folder: str, site: str, api: str, now: dt.datetime, per_page: int = URLS_PER_PAGE) -> list[str]:
    """Writes sitemap-<kind>[-<page>].xml, sitemap-static.xml and sitemap.xml, the index; the files' names in the index's order.

    Pages are written by one task each, in a folder apart; only complete ones are moved into place, the index last. A kind
    without addresses has one empty page. The driver handles one name a page, never the addresses.
    """
    staged = scratch(spark)
    pages: list[tuple[str, int]] = []
    for kind in kinds:
        rows = entries(kind, site, per_page)
        n = rows.agg(F.max("page")).first()[0] or 1
        pages += [(kind.name, p) for p in range(1, n + 1)]
        numbers = spark.range(1, n + 1).select(F.col("id").alias("page"))
        frame = numbers.select(F.lit(kind.name).alias("kind"), "page", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("place"), F.lit(HEAD.format("urlset")).alias("entry")), F.struct(F.lit(2**62).alias("place"), F.lit("</urlset>").alias("entry")))).alias("x"))
        whole = rows.unionByName(frame.select("kind", "page", "x.place", "x.entry"))
        whole.repartition("page").sortWithinPartitions("page", "place").select("page", "entry").write.partitionBy("page").text(f"{staged}/{kind.name}")
    lines = [HEAD.format("urlset"), *[r.e for r in _static(spark, site).collect()], "</urlset>"]
    _one_file(spark, lines, f"{staged}/static/page=1")
    pages.insert(0, ("static", 1))
    stamp = now.astimezone(dt.UTC).replace(microsecond=0).isoformat() if now.tzinfo else now.replace(microsecond=0).isoformat() + "+00:00"
    index = [f"  <sitemap>\n    <loc>{api}/sitemap-{k}.xml{'' if p == 1 else f'?page={p}'}</loc>\n    <lastmod>{stamp}</lastmod>\n  </sitemap>" for k, p in pages]
    _one_file(spark, [HEAD.format("sitemapindex"), *index, "</sitemapindex>"], f"{staged}/index")
    rename_single_files(spark, {f"{staged}/{k}/page={p}": f"{folder}/{file_name(k, p)}" for k, p in pages})
    rename_single_files(spark, {f"{staged}/index": f"{folder}/sitemap.xml"})
    return [file_name(k, p) for k, p in pages]


def _static(spark: SparkSession, site: str) -> DataFrame:
    rows = [spark.range(1).select(F.lit(i).alias("i"), entry(F.lit(f"{site}{path}"), None, often, much).alias("e")) for i, (path, often, much) in enumerate(STATIC_PAGES)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("i")


def _one_file(spark: SparkSession, lines: Sequence[str], folder: str) -> None:
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)


def read_sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of every file of a folder; a page has a bounded number of addresses."""
    files = spark.read.text(f"{folder}/*.xml", wholetext=True)
    return files.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value").alias("content"))
