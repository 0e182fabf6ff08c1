"""Tables, links and embedded series inside web pages. Whole pages are read; arrays stay inside their row until exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import clean, host_of, matched, squeeze
from ..operators.ordering import first_per_group

TABLE, ROW = r"(?is)<table[\s>].*?</table\s*>", r"(?is)<tr[\s>].*?</tr\s*>"
CELL = r"(?is)<(td|th)[\s>].*?</\1\s*>"
YEAR = r"\b((?:19|20)\d{2})\b"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def plain_text(c: Column) -> Column:
    """Text without tags, numbered citations and the two common entities, white space squeezed."""
    bare = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), r"\[\s*\d+\s*\]", "")
    bare = F.replace(F.replace(bare, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    return squeeze(bare)


def html_tables(pages: DataFrame, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, entity_header, entity, year, value) of the tables with years in their header.

    Tables of one page are merged: the first non-empty value of an (entity, year) stands.
    """
    rows = lambda t: F.filter(F.transform(_all(t, ROW), lambda r: F.transform(_all(r, CELL), plain_text)), lambda r: F.size(r) > 0)
    tables = F.filter(F.transform(_all(F.col(html), TABLE), rows), lambda t: F.size(t) >= 2)
    dated = F.filter(tables, lambda t: F.exists(F.slice(t[0], 2, F.size(t[0])), lambda h: h.rlike(YEAR)))
    found = pages.filter(F.col(html).rlike("(?i)<table")).select(page, dated.alias("tables")).filter(F.size("tables") > 0)
    found = found.select(page, F.col("tables")[0][0][0].alias("entity_header"), F.posexplode("tables").alias("t", "table"))
    body = found.select(page, "entity_header", "t", F.col("table")[0].alias("head"), F.posexplode("table").alias("r", "row"))
    body = body.filter("r > 0").select(page, "entity_header", "t", "r", "head", F.trim(F.col("row")[0]).alias("entity"),
                                       F.posexplode("row").alias("c", "value")).filter("c > 0 and entity != '' and value != ''")
    year = matched(F.get("head", F.col("c")), YEAR, 1)
    cells = body.withColumn("year", year).filter("year is not null")
    return cells.groupBy(page, "entity", "year").agg(
        F.min_by("value", F.struct("t", "r", "c")).alias("value"), F.first("entity_header").alias("entity_header"),
        F.min(F.struct("t", "r")).alias("seen"))


def as_wide(cells: DataFrame, years: list[str], page: str = "page_id") -> DataFrame:
    """Merged table cells as one row per entity and one column per year."""
    return cells.groupBy(page, "entity").pivot("year", years).agg(F.first("value"))


def html_links(pages: DataFrame, limit: int | None = None, absolute_only: bool = True, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, place, url, title): each target once per page, first occurrence first; at most ``limit`` of a page if given."""
    rule = r"""(?is)<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    zipped = F.arrays_zip(_all(F.col(html), rule, 1).alias("url"), _all(F.col(html), rule, 2).alias("inner"))
    links = pages.select(page, F.posexplode(zipped).alias("at", "a")).select(page, "at", F.col("a.url").alias("url"), F.col("a.inner").alias("inner"))
    if absolute_only:
        links = links.filter(F.col("url").rlike("^https?:"))
    once = links.groupBy(page, "url").agg(F.min("at").alias("at"), F.min_by("inner", "at").alias("inner"))
    title = squeeze(F.regexp_replace("inner", "<[^>]+>", " "))
    listed = once.withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("at")).cast("bigint"))  # a page's links fit in a task
    if limit is not None:
        listed = listed.filter(F.col("place") <= limit)
    return listed.select(page, "place", "url", F.when(title == "", host_of("url")).otherwise(title).alias("title"))


def ranked_slugs(pages: DataFrame, top_n: int, pattern: str, page: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, rank, slug): distinct targets in page order; their order is the ranking."""
    found = pages.select(page, F.posexplode(_all(F.col(html), pattern, 1)).alias("at", "slug"))
    once = found.groupBy(page, "slug").agg(F.min("at").alias("at"))
    return first_per_group(once, [page], [F.col("at")], top_n).select(page, "rank", "slug")


def embedded_series(pages: DataFrame, html: str = "html") -> DataFrame:
    """(entity, ts, m): the points drawn by a page's chart, the entity taken from its title."""
    title = matched(F.col(html), r"(?i)<title>\s*([^<]+?)\s*-\s*Market capitalization", 1)
    name = F.nullif(clean(F.regexp_replace(title, r"\s*\([A-Za-z0-9.\-]+\)\s*$", "")), F.lit(""))
    point = r'\{"d":(\d+),"m":(\d+(?:\.\d+)?)\}'
    zipped = F.arrays_zip(_all(F.col(html), point, 1).alias("d"), _all(F.col(html), point, 2).alias("m"))
    rows = pages.select(F.coalesce(name, F.lit("company")).alias("entity"), F.explode(zipped).alias("p"))
    return rows.select("entity", F.col("p.d").try_cast("bigint").alias("ts"), F.col("p.m").try_cast("double").alias("m")).filter("ts > 0 and m > 0")
