"""Crawling as rounds over a frontier of links, from stored pages or from a fetch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import urls as U
from quillon.operators.access import new_links
from quillon.sources.tables import cut, if_small

FOLD = 20


def page_links(pages: DataFrame, site: DataFrame) -> DataFrame:
    """Accepted links (site_id, path, to_path) of pages (site_id, path, content)."""
    rows = pages.join(if_small(site.select("site_id", "url")), "site_id")
    links = U.extract_links(rows, F.col("url"), F.col("content"), "site_id", "path")
    own = F.concat(F.col("site_url"), F.col("path"))
    return U.accept_links(links, own, "site_id", "path").select("site_id", "path", U.relative_link(F.col("link")).alias("to_path"))


def _folded(rounds: DataFrame, level: int) -> DataFrame:
    """The union of all rounds' tables, written as one table every ``FOLD`` rounds."""
    return cut(rounds) if level % FOLD == FOLD - 1 else rounds


def reachable(seeds: DataFrame, links: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(site_id, path, level) of all that the links (site_id, path, to_path) reach from the seeds (site_id, path).

    One round for each level, until a round finds nothing new. Each round's lineage is cut.
    """
    seen = frontier = cut(seeds.select("site_id", "path", F.lit(0).alias("level")).dropDuplicates(["site_id", "path"]))
    for level in range(1, max_rounds + 1):
        step = links.join(frontier.select("site_id", "path"), ["site_id", "path"]).select("site_id", F.col("to_path").alias("path")).distinct()
        frontier = cut(new_links(step, seen).withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            return seen
        seen = _folded(seen.unionByName(frontier), level)
    raise RuntimeError(f"the crawl did not end in {max_rounds} rounds")


def page_scan(pages: DataFrame, site: DataFrame) -> DataFrame:
    """(page_id, site_id, path, code, content, sub_links) of pages: what one visit of a page yields. sub_links: the accepted links, in order of
    their text. A page whose code is not 200 has an empty content and no links."""
    ok = F.coalesce(F.col("code") == 200, F.lit(False))
    links = page_links(pages.filter(ok), site).groupBy("site_id", "path").agg(F.array_sort(F.collect_set("to_path")).alias("_links"))
    rows = pages.join(links, ["site_id", "path"], "left")
    none = F.array().cast("array<string>")
    return rows.select("page_id", "site_id", "path", "code", F.when(ok, F.coalesce("content", F.lit(""))).otherwise("").alias("content"), F.when(ok, F.coalesce("_links", none)).otherwise(none).alias("sub_links"))


def stored_web(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A fetch from pages (site_id, path, code, content); what they lack answers 404."""

    def fetch(links: DataFrame) -> DataFrame:
        got = links.join(pages.select("site_id", "path", "code", "content", F.lit(True).alias("_have")), ["site_id", "path"], "left")
        return got.select("site_id", "path", F.when(F.col("_have"), F.col("code")).otherwise(404).alias("code"), F.coalesce("content", F.lit("")).alias("content"), F.lit(None).cast("string").alias("error"))

    return fetch


def crawl_sites(site: DataFrame, fetch: Callable[[DataFrame], DataFrame], stop: Callable[[], bool] = lambda: False, max_rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(pages, errors) of a crawl of all sites (site_id, url) from their roots, one round for each level.

    fetch gives (site_id, path, code, content, error) of links (site_id, path, link). pages: (page_id, site_id, path, code, content), each
    (site, path) once, those of other codes than 200 with an empty content. errors: (site_id, error): the first error of each site, with its
    link. A page that fails is no page and is not followed; its siblings and the other sites go on. ``stop`` is asked before each round.
    """
    todo = cut(site.select("site_id", F.lit("/").alias("path"), F.concat("url", F.lit("/")).alias("link")).dropDuplicates(["site_id", "path"]))
    seen, got = todo.select("site_id", "path"), None
    for level in range(max_rounds):
        if stop() or todo.isEmpty():
            break
        answer = fetch(todo).dropDuplicates(["site_id", "path"])
        fetched = cut(answer.select("site_id", "path", "code", F.when(F.col("code") == 200, F.coalesce("content", F.lit(""))).otherwise("").alias("content"), "error", F.lit(level).alias("level")))
        got = fetched if got is None else got.unionByName(fetched)
        step = page_links(fetched.filter("code = 200"), site).select("site_id", F.col("to_path").alias("path")).distinct()
        fresh = new_links(step, seen).join(if_small(site.select("site_id", "url")), "site_id").select("site_id", "path", F.concat("url", "path").alias("link"))
        todo = cut(fresh)
        seen = _folded(seen.unionByName(todo.select("site_id", "path")), level)
    empty = "site_id int, path string, code int, content string, error string, level int"
    got = site.sparkSession.createDataFrame([], empty) if got is None else got
    fetched_pages = got.filter("error is null").select(F.monotonically_increasing_id().alias("page_id"), "site_id", "path", "code", "content")
    links = got.filter("error is not null").join(if_small(site.select("site_id", "url")), "site_id")
    errors = links.groupBy("site_id").agg(F.min_by(F.concat("error", F.lit(": "), "url", "path"), F.struct("level", "path")).alias("error"))
    return cut(fetched_pages), cut(errors)
