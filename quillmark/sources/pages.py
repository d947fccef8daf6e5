"""Web pages as a source: their texts, domains, blocked addresses, candidates of a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.params import BLOCKED_SUFFIXES, LEAST_PAGE, MOST_PAGES
from quillmark.sources.html import parsed


def domain(url: Column) -> Column:
    """Authority of the URL without any 'www.'; '' if there is none."""
    return F.replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def blocked(url: Column) -> Column:
    return F.substring_index(F.lower(F.coalesce(url, F.lit(""))), "?", 1).rlike(rf"\.({'|'.join(BLOCKED_SUFFIXES)})$")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, domain, title, text) of pages that are not blocked and have enough visible text."""
    return indexed_texts(pages.where(~blocked(F.col("url")))).where(F.length("text") >= LEAST_PAGE)


def indexed_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, domain, title, text) of all pages."""
    # from an array of one, as a filter on the text itself would be pushed down to the scan and parse the page twice
    rows = pages.select("page_id", "url", domain(F.col("url")).alias("domain"), F.explode_outer(F.array(parsed("html"))).alias("x"))
    shown = F.coalesce(F.nullif("x.title", F.lit("")), F.nullif("domain", F.lit("")), F.col("url"))
    return rows.select("page_id", "url", "domain", F.substring(shown, 1, 300).alias("title"), "x.text")


def candidates(results: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """The first ``most`` distinct URLs of each document's search results, by (query_ix, rank).

    If the results have a column ``readable``, it tells which pages can be read; others use up their URL only.
    """
    rows = results.where("coalesce(url, '') <> ''").where(domain(F.col("url")) != "")
    first = Window.partitionBy("doc_id", "url").orderBy("query_ix", "rank")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    if "readable" in rows.columns:
        rows = rows.where("readable").drop("readable")
    place = Window.partitionBy("doc_id").orderBy("query_ix", "rank")
    return rows.withColumn("n", F.row_number().over(place)).where(F.col("n") <= most).drop("n")
