"""Statistics of the configured sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.access import count_by_site
from quillon.schemas import INDEXING


def site_statistics(configured: DataFrame, site: DataFrame, page: DataFrame, lemma: DataFrame, offset_seconds: int = 0) -> DataFrame:
    """A row (url, name, status, statusTime, error, pages, lemmas) for each configured site (url, name).

    A site that the table lacks gets an empty status, time 0 and no pages. Of sites with one url the first by id counts. Times are
    epoch seconds of the stored wall clock at a fixed offset.
    """
    columns = [c for c in site.columns if c != "name"]
    site = site.groupBy("url").agg(F.min_by(F.struct(*columns), "site_id").alias("_s")).select("_s.*")
    pages, lemmas = count_by_site(page, "_p"), count_by_site(lemma, "_l")
    time = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', status_time)")
    return (
        configured.select("url", "name").join(site, "url", "left").join(pages, "site_id", "left").join(lemmas, "site_id", "left")
        .select(
            "url", "name", F.coalesce("status", F.lit("")).alias("status"), F.coalesce(time - offset_seconds, F.lit(0)).cast("long").alias("statusTime"),
            F.col("last_error").alias("error"), F.coalesce("_p", F.lit(0)).cast("long").alias("pages"), F.coalesce("_l", F.lit(0)).cast("long").alias("lemmas"),
        )
    )


def total_statistics(detail: DataFrame) -> DataFrame:
    """One row (sites, pages, lemmas, indexing) over the detailed rows; lemmas count once per site."""
    return detail.agg(
        F.count("*").alias("sites"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.coalesce(F.sum("lemmas"), F.lit(0)).alias("lemmas"),
        F.coalesce(F.bool_or(F.col("status") == INDEXING), F.lit(False)).alias("indexing"),
    )
