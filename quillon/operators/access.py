"""The lookups and updates of the four tables, each as a filter, semi-join or projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.schemas import FAILED, INDEXED, INDEXING, MSG_STOPPED


def stop_indexing_sites(site: DataFrame, now: Column, status: str = FAILED, error: str = MSG_STOPPED) -> DataFrame:
    """Sites being indexed get the status, the time and the error; others stay."""
    busy = F.col("status") == INDEXING
    return site.withColumns({
        "status_time": F.when(busy, now).otherwise(F.col("status_time")),
        "last_error": F.when(busy, F.lit(error)).otherwise(F.col("last_error")),
        "status": F.when(busy, F.lit(status)).otherwise(F.col("status")),
    })


def final_status(site: DataFrame, now: Column, failed: DataFrame) -> DataFrame:
    """Sites after a crawl: FAILED where ``failed`` (site_id, error) names the site, else INDEXED."""
    err = failed.groupBy("site_id").agg(F.min("error").alias("_e"))
    return site.join(err, "site_id", "left").select(
        "site_id", "url", "name", F.when(F.col("_e").isNull(), INDEXED).otherwise(FAILED).alias("status"), now.alias("status_time"), F.col("_e").alias("last_error")
    )


def site_by_url(site: DataFrame, url: str) -> DataFrame:
    return site.filter(F.col("url") == url)


def sites_by_urls(site: DataFrame, urls: Iterable[str]) -> DataFrame:
    return site.filter(F.col("url").isin(list(urls)))


def searchable_sites(site: DataFrame, url: str | None = None) -> DataFrame:
    """Sites that can be searched, all or the one with the url: any that is not being indexed, failed ones included."""
    return site.filter((F.lit(url is None) | (F.col("url") == F.lit(url or ""))) & (F.col("status") != INDEXING))


def site_statuses(site: DataFrame) -> DataFrame:
    return site.select("status")


def page_at(page: DataFrame, site_id: int, path: str) -> DataFrame:
    return page.filter((F.col("site_id") == site_id) & (F.col("path") == path))


def known_paths(page: DataFrame, links: DataFrame) -> DataFrame:
    """Stored pages among the links (site_id, path)."""
    return page.join(links.select("site_id", "path").distinct(), ["site_id", "path"], "left_semi")


def new_links(links: DataFrame, page: DataFrame) -> DataFrame:
    """Links (site_id, path) that no stored page has. The site counts: equal paths on two sites are different pages."""
    return links.join(page.select("site_id", "path"), ["site_id", "path"], "left_anti")


def count_by_site(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("site_id").agg(F.count("*").alias(name))


def lemma_rows(lemma: DataFrame, lemmas: DataFrame, sites: DataFrame) -> DataFrame:
    """Lemma rows of the wanted lemmas on the wanted sites; order them by site, frequency and lemma."""
    return lemma.join(lemmas.select("lemma").distinct(), "lemma", "left_semi").join(sites.select("site_id").distinct(), "site_id", "left_semi")


def postings_of(index: DataFrame, lemmas: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Postings of (site_id, lemma), within the given pages if there are any."""
    hit = index.join(lemmas.select("site_id", "lemma").distinct(), ["site_id", "lemma"], "left_semi")
    return hit if pages is None else hit.join(pages.select("page_id").distinct(), "page_id", "left_semi")


def summed_ranks(index: DataFrame, lemmas: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, abs_rank): the sum of the ratings of the lemmas on each of the pages."""
    return postings_of(index, lemmas, pages).groupBy("page_id").agg(F.sum("rating").alias("abs_rank"))


def page_lemmas(index: DataFrame, page_id: int) -> DataFrame:
    return index.filter(F.col("page_id") == page_id).select("site_id", "lemma")
