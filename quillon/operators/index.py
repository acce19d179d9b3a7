"""Building and maintaining the inverted index: term counts, document frequencies, change-sets.

An index is two tables: postings (site_id, page_id, lemma, rating) and frequencies (site_id, lemma,
frequency), the number of the site's pages that hold the lemma. Every change derives both from one
change-set, so they can't drift apart. Nothing is collected.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions.html import token_text
from quillon.schemas import MSG_PAGE_REQUEST

KEYS = ("site_id", "page_id")


class Index(NamedTuple):
    """The index's two tables."""

    postings: DataFrame
    frequencies: DataFrame


def term_counts(pages: DataFrame, content: Column, dict_: DataFrame | None = None, html: bool = True) -> DataFrame:
    """Postings (site_id, page_id, lemma, rating) of pages (site_id, page_id, ...): each lemma's count in the page.

    Words are counted before the dictionary is joined, so the join sees each word of a page once.
    """
    text = token_text(content) if html else content
    words = X.token_rows(pages, text, *KEYS).groupBy(*KEYS, "lang", "word").agg(F.count("*").alias("n"))
    return X.index_lemmas(words, dict_).groupBy(*KEYS, "lemma").agg(F.sum("n").cast("float").alias("rating"))


def frequencies(postings: DataFrame) -> DataFrame:
    """Document frequency of each lemma of a site; postings hold each (page, lemma) once."""
    return postings.groupBy("site_id", "lemma").agg(F.count("*").alias("frequency"))


def build(pages: DataFrame, content: Column, dict_: DataFrame | None = None, html: bool = True) -> Index:
    """An index from nothing."""
    p = term_counts(pages, content, dict_, html)
    return Index(p, frequencies(p))


def indexable(pages: DataFrame, mode: str = "crawl") -> DataFrame:
    """The pages whose text is indexed: those of code 200. ``crawl`` passes over the others; ``single`` raises for them."""
    ok = F.coalesce(F.col("code") == 200, F.lit(False))
    if mode == "single":
        wrong = F.raise_error(F.concat(F.lit(MSG_PAGE_REQUEST), F.coalesce(F.col("code").cast("string"), F.lit(""))))
        return pages.withColumn("code", F.when(ok, F.col("code")).otherwise(wrong.cast("int")))
    if mode != "crawl":
        raise ValueError(mode)
    return pages.filter(ok)


def unique_pages(pages: DataFrame) -> DataFrame:
    """One page for each (site, path): the one with the smallest id."""
    return pages.groupBy("site_id", "path").agg(F.min("page_id").alias("page_id"))


def upsert_frequencies(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Adds a change (positive or negative) to the frequencies; lemmas at zero or below are purged."""
    return (
        old.select("site_id", "lemma", "frequency").unionByName(delta.select("site_id", "lemma", "frequency"))
        .groupBy("site_id", "lemma")
        .agg(F.sum("frequency").alias("frequency"))
        .filter("frequency > 0")
    )


def delete_pages(index: Index, gone: DataFrame) -> Index:
    """Removes the postings of pages (page_id) and lowers the frequencies of their lemmas."""
    gone = gone.select("page_id").distinct()
    lost = index.postings.join(gone, "page_id", "left_semi")
    minus = frequencies(lost).withColumn("frequency", -F.col("frequency"))
    return Index(index.postings.join(gone, "page_id", "left_anti").select(index.postings.columns), upsert_frequencies(index.frequencies, minus))


def add_pages(index: Index, new: DataFrame) -> Index:
    """Adds the postings of pages that the index does not hold."""
    return Index(index.postings.unionByName(new.select(index.postings.columns)), upsert_frequencies(index.frequencies, frequencies(new)))


def reindex_pages(index: Index, new: DataFrame) -> Index:
    """Replaces the pages of ``new`` by their new postings. The old ones go only with the new at hand."""
    return add_pages(delete_pages(index, new), new)


def insert_postings(rows: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Postings to insert: distinct rows (site_id, page_id, lemma, rating) whose lemma the site knows."""
    return rows.distinct().join(lemmas.select("site_id", "lemma"), ["site_id", "lemma"])


def decrease(freq: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Frequencies lowered by one for the given (site_id, lemma)."""
    return freq.join(lemmas.select("site_id", "lemma").distinct().withColumn("_d", F.lit(1)), ["site_id", "lemma"], "left").select(
        "site_id", "lemma", (F.col("frequency") - F.coalesce("_d", F.lit(0))).alias("frequency")
    )


def purge_zero(freq: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Without those of the given (site_id, lemma) whose frequency is zero or less."""
    at = lemmas.select("site_id", "lemma").distinct().withColumn("_d", F.lit(True))
    return freq.join(at, ["site_id", "lemma"], "left").filter(F.col("_d").isNull() | (F.col("frequency") > 0)).drop("_d")


def wipe(df: DataFrame) -> DataFrame:
    """The table without its rows."""
    return df.filter(F.lit(False))
