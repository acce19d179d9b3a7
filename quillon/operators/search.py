"""Ranked search: rarest-first narrowing per site, summed ratings, normalised relevance, paging.

A page's depth is the longest gap-free prefix of the query's lemmas (rarest first) that it holds. The
number of pages at each depth decides where a site's narrowing stops, so the procedure needs no loop:
windows over the postings of the query's few lemmas give it for all sites at once.

Scale: the lemmas of one query reach the driver first, so that the postings are filtered by literals in the scan of the stored index,
before anything is aggregated. The postings of those lemmas and the depths are written once and read
by the steps that need them again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators.access import searchable_sites
from quillon.schemas import MSG_EMPTY_QUERY, MSG_NO_SITES, SearchRequest, SearchSettings
from quillon.sources.tables import cut, if_small


class RequestError(ValueError):
    """A request that the endpoint answers with 400."""


def check_request(req: SearchRequest, site: DataFrame, settings: SearchSettings) -> tuple[DataFrame, int]:
    """The sites to search and the limit; raises for an empty query or when no site can be searched."""
    if not req.query:
        raise RequestError(MSG_EMPTY_QUERY)
    sites = searchable_sites(site, req.site or None)
    if sites.isEmpty():
        raise RequestError(MSG_NO_SITES)
    return sites, req.limit or settings.default_limit


def query_words(spark: SparkSession, query: str) -> DataFrame:
    """Rows (lang, word) of a query."""
    return X.token_rows(spark.createDataFrame([(query,)], "q string"), F.col("q")).distinct()


def pick_lemmas(candidates: DataFrame, freq: DataFrame) -> DataFrame:
    """One lemma for each word of (word, lemma): that with the highest frequency on any site, then the first by name; distinct."""
    best = freq.join(F.broadcast(candidates.select("lemma").distinct()), "lemma", "left_semi").groupBy("lemma").agg(F.max("frequency").alias("_f"))
    w = Window.partitionBy("word").orderBy(F.desc_nulls_last("_f"), "lemma")
    return candidates.join(best, "lemma", "left").withColumn("_k", F.row_number().over(w)).filter("_k = 1").select("lemma").distinct()


def ranked_lemmas(lemmas: DataFrame, freq: DataFrame, sites: DataFrame | None = None) -> DataFrame:
    """(site_id, lemma, frequency, k) of the sites that know every lemma; k counts from the rarest, ties by name."""
    lemmas = F.broadcast(lemmas)  # the words of one query
    hit = freq.join(lemmas, "lemma", "left_semi")
    if sites is not None:
        hit = hit.join(sites.select("site_id").distinct(), "site_id", "left_semi")
    by_site = Window.partitionBy("site_id")
    need = lemmas.agg(F.count("*").alias("_need"))
    return (
        hit.withColumn("_n", F.count("*").over(by_site))
        .withColumn("k", F.row_number().over(by_site.orderBy("frequency", "lemma")))
        .join(F.broadcast(need), F.col("_n") == F.col("_need"))
        .select("site_id", "lemma", "frequency", "k")
    )


def candidates(index: DataFrame, ranked: DataFrame, settings: SearchSettings = SearchSettings(), mode: str = "narrowing") -> DataFrame:
    """(site_id, page_id, abs_rank) of the pages that remain.

    ``narrowing``: a site's list is intersected with one lemma after another, and ends early where it stays
    as large or where the lemma is too common; where it gets empty the site drops out. ``strict_and``: pages
    that hold every lemma, without a cap. The first lemma's list is cut to its smallest page ids. Ranks
    sum all lemmas, those after the stop included.
    """
    cap, late, common = settings.page_start_count_limit, settings.lemmas_count_for_page_limit, settings.page_count_limit
    ranked = cut(ranked)
    hits = cut(index.join(if_small(ranked), ["site_id", "lemma"]).select("site_id", "page_id", "k", F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).alias("rating")))
    if mode == "strict_and":
        n = ranked.groupBy("site_id").agg(F.max("k").alias("n"))
        return hits.groupBy("site_id", "page_id").agg(F.count("*").alias("c"), F.sum("rating").alias("abs_rank")).join(n, "site_id").filter("c = n").select("site_id", "page_id", "abs_rank")
    if mode != "narrowing":
        raise ValueError(mode)
    first = Window.partitionBy("site_id", "k").orderBy("page_id")
    # only the rarest lemma's list is numbered, so a common lemma's list is never sorted
    kept = hits.filter("k > 1").unionByName(hits.filter("k = 1").withColumn("_p", F.row_number().over(first)).filter(F.col("_p") <= cap).drop("_p"))
    gap_free = Window.partitionBy("site_id", "page_id").orderBy("k")
    depth = (
        kept.withColumn("_rn", F.row_number().over(gap_free))
        .groupBy("site_id", "page_id")
        .agg(F.max(F.when(F.col("_rn") == F.col("k"), F.col("k")).otherwise(0)).alias("d"), F.sum("rating").alias("abs_rank"))
        .filter("d > 0")
    )
    depth = cut(depth)
    at = depth.groupBy("site_id", "d").agg(F.count("*").alias("_c"))
    sizes = (
        ranked.join(at, "site_id", "left")
        .groupBy("site_id", "k", "frequency")
        .agg(F.coalesce(F.sum(F.when(F.col("d") >= F.col("k"), F.col("_c"))), F.lit(0)).alias("s"))
        .withColumn("_prev", F.lag("s").over(Window.partitionBy("site_id").orderBy("k")))
    )
    stop = (F.col("s") == 0) | (F.col("s") == F.col("_prev")) | ((F.col("k") > late) & (F.col("frequency") > common))
    need = (
        sizes.groupBy("site_id")
        .agg(F.max("k").alias("n"), F.min(F.when(F.col("s") == 0, F.col("k"))).alias("zero"), F.min(F.when(stop, F.col("k"))).alias("stop"))
        .filter(F.col("zero").isNull() | (F.col("zero") > F.col("stop")))
        .select("site_id", F.coalesce(F.col("stop") - 1, F.col("n")).alias("need"))
    )
    return depth.join(need, "site_id").filter("d >= need").select("site_id", "page_id", "abs_rank")


def relevance(ranks: DataFrame) -> DataFrame:
    """Adds relevance: the rank over the highest of all sites, before any paging."""
    top = ranks.agg(F.max("abs_rank").alias("_top"))
    return ranks.join(F.broadcast(top), F.lit(True)).withColumn("relevance", F.when(F.col("_top") != 0, F.col("abs_rank") / F.col("_top")).otherwise(0.0)).drop("_top")


def result_page(ranks: DataFrame, offset: int, limit: int) -> DataFrame:
    """A slice by rank, ties by page id."""
    return ranks.orderBy(F.desc("abs_rank"), "page_id").offset(offset).limit(limit)


def walk(ranks: DataFrame, limit: int, offset: int = 0) -> Iterator[tuple[int, DataFrame]]:
    """(offset, slice) of all result pages from an offset on: the next offset is this one and the rows there were, until none remain."""
    count = ranks.count()
    while offset < count:
        yield offset, result_page(ranks, offset, limit)
        offset += min(limit, count - offset)


def decorate(slice_: DataFrame, page: DataFrame, site: DataFrame, title: Column, snippet: Column | None = None) -> DataFrame:
    """Result rows (site, siteName, uri, title[, snippet], relevance). Pages are joined after the slice, which is broadcast: a result page's rows."""
    rows = page.join(F.broadcast(slice_.select("page_id", "relevance", "abs_rank")), "page_id").join(if_small(site.select("site_id", F.col("url").alias("site"), F.col("name").alias("siteName"))), "site_id")
    cols = ["page_id", "site", "siteName", F.col("path").alias("uri"), title.alias("title")]
    return rows.select(*cols, *([snippet.alias("snippet")] if snippet is not None else []), "relevance")


def search_ranks(spark: SparkSession, query: str, index: DataFrame, freq: DataFrame, sites: DataFrame, dict_: DataFrame | None, settings: SearchSettings = SearchSettings(), mode: str = "narrowing") -> tuple[DataFrame, DataFrame]:
    """The ranked pages of a query and the lemma rows they were ranked by. A query of particles alone finds nothing."""
    found = X.query_lemmas(query_words(spark, query), dict_).collect()  # the words of one query
    names = F.col("lemma").isin(sorted({r["lemma"] for r in found}))
    words = spark.createDataFrame(found, "word string, lemma string")
    known = cut(freq.filter(names).select("site_id", "lemma", "frequency"))
    ranked = cut(ranked_lemmas(pick_lemmas(words, known), known, sites))
    return relevance(candidates(index.filter(names), ranked, settings, mode)), ranked
