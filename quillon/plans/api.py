"""The five endpoints as functions from a request to a JSON string."""

from __future__ import annotations

import json
import logging
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import schemas as S
from quillon.functions import html as H
from quillon.functions import text as X
from quillon.functions import urls as U
from quillon.operators import access, index, search, stats
from quillon.operators.crawl import crawl_sites
from quillon.operators.search import RequestError
from quillon.operators.snippet import snippet_udf
from quillon.sources.fetch import fetch_pages, http_get
from quillon.sources.store import BUCKETS, BY_PAGE, SCHEMAS, Conflict, Store
from quillon.sources.tables import cut
from quillon.streaming.ingest import replace_pages

log = logging.getLogger(__name__)


def _answer(status: int, **body) -> tuple[int, str]:
    return status, json.dumps(body, ensure_ascii=False)


def _guarded(message: str, work: Callable[[], tuple[int, str]]) -> tuple[int, str]:
    try:
        return work()
    except RequestError as e:
        return _answer(400, result=False, error=str(e))
    except Exception:
        log.exception(message)
        return _answer(500, result=False, error=message)


def search_rows(spark: SparkSession, tables: dict[str, DataFrame], req: S.SearchRequest, settings: S.SearchSettings = S.SearchSettings()) -> tuple[int, list[dict]]:
    """The number of hits and the result page's rows."""
    sites, limit = search.check_request(req, tables["site"], settings)
    dict_ = X.dictionary(tables["lemma_dict"]) if "lemma_dict" in tables else None
    ranks, ranked = search.search_ranks(spark, req.query, tables["search_index"], tables["lemma"], sites, dict_, settings)
    ranks = ranks.persist()
    try:
        count = ranks.count()
        if not count or req.offset >= count:
            return count, []
        part = search.result_page(ranks, req.offset, limit)
        lemmas = [r[0] for r in ranked.select("lemma").distinct().collect()]  # the lemmas of one query
        forms = None
        if dict_ is not None:
            hit = dict_.filter(F.arrays_overlap("normal_forms", F.array(*map(F.lit, lemmas)))).select("word", "normal_forms")
            forms = {r[0]: list(r[1]) for r in hit.collect()}  # the forms of one query's lemmas
        rows = search.decorate(part, tables["page"], tables["site"], H.title(F.col("content")), snippet_udf(set(lemmas), forms, True, settings.snippet_max_size, settings.snippet_part_size)(F.col("content")))
        rows = rows.orderBy(F.desc("relevance"), "page_id").drop("page_id")
        return count, [r.asDict() for r in rows.collect()]  # a result page
    finally:
        ranks.unpersist()


def get_search(spark: SparkSession, tables: dict[str, DataFrame], req: S.SearchRequest, settings: S.SearchSettings = S.SearchSettings()) -> tuple[int, str]:
    """GET search."""

    def work() -> tuple[int, str]:
        count, data = search_rows(spark, tables, req, settings)
        return _answer(200, result=True, count=count, data=data)

    return _guarded(S.MSG_FAIL_SEARCH, work)


def get_statistics(spark: SparkSession, tables: dict[str, DataFrame], configured: DataFrame) -> tuple[int, str]:
    """GET statistics; fields that are null are left out."""

    def work() -> tuple[int, str]:
        detail = stats.site_statistics(configured, tables["site"], tables["page"], tables["lemma"]).persist()
        total = stats.total_statistics(detail).first().asDict()
        rows = [json.loads(r[0]) for r in detail.orderBy("url").select(F.to_json(F.struct("*"))).collect()]  # the configured sites
        detail.unpersist()
        return _answer(200, result=True, statistics={"total": total, "detailed": rows})

    return _guarded(S.MSG_FAIL_STATISTICS, work)


class Indexer:
    """start, stop and single-page indexing over the tables of a store; one job at a time.

    ``dictionary`` (lang, form, normal_form, form_rank, info) gives the lemmas, as it does for searching. ``web`` fetches links for the crawl, ``get``
    one page (code, content, error); by default both ask the web."""

    def __init__(self, spark: SparkSession, root: str, settings: S.Settings, dictionary: DataFrame | None = None, web: Callable[[DataFrame], DataFrame] | None = None, get: Callable[[str], tuple[int | None, str, str | None]] | None = None):
        self.spark, self.store, self.settings = spark, Store(spark, root), settings
        self.dictionary = None if dictionary is None else X.dictionary(dictionary)
        self.web = web or (lambda links: fetch_pages(links, settings.user_agent, settings.referrer))
        self.get = get or (lambda link: http_get(link, settings.user_agent, settings.referrer))
        self._job: threading.Thread | None = None
        self._stopped = threading.Event()

    @property
    def active(self) -> bool:
        return self._job is not None and self._job.is_alive()

    def tables(self) -> dict[str, DataFrame]:
        """All tables of the newest state."""
        return self.store.tables()

    def _site_rows(self, status: str) -> DataFrame:
        rows = self.spark.createDataFrame([(k, c.url, c.name) for k, c in enumerate(self.settings.sites, 1)], "site_id int, url string, name string")
        return rows.select("*", F.lit(status).alias("status"), F.expr("localtimestamp()").alias("status_time"), F.lit(None).cast("string").alias("last_error"))

    def start_indexing(self) -> tuple[int, str]:
        """Wipes all tables, sets the configured sites to being indexed and crawls them in the background."""

        def work() -> tuple[int, str]:
            if self.active:
                raise RequestError(S.MSG_ALREADY_INDEXING)
            self._stopped.clear()
            state = self.store.manifest()
            none = {n: self.spark.createDataFrame([], s) for n, s in SCHEMAS.items() if n != "site"}
            state = self.store.commit({**state, "marks": {}}, whole={"site": self._site_rows(S.INDEXING)} | {n: df for n, df in none.items() if n == "lemma"}, touched={n: (none[n], list(range(BUCKETS))) for n in BY_PAGE})
            self._job = threading.Thread(target=self._crawl, args=(state,), daemon=True)
            self._job.start()
            return _answer(200, result=True)

        return _guarded(S.MSG_FAIL_START, work)

    def _crawl(self, state: dict) -> None:
        sc = self.spark.sparkContext
        sc.setJobGroup("quillon-indexing", "indexing", True)
        site = self.store.read("site", state=state)
        try:
            pages, errors = crawl_sites(site, self.web, self._stopped.is_set)
            postings = cut(index.term_counts(index.indexable(pages, "crawl"), F.col("content"), self.dictionary))
            failed = errors if not self._stopped.is_set() else site.select("site_id", F.lit(S.MSG_STOPPED).alias("error"))
            every = list(range(BUCKETS))
            self.store.commit(state, whole={"site": access.final_status(site, F.expr("localtimestamp()"), failed), "lemma": index.frequencies(postings)}, touched={"page": (pages, every), "search_index": (postings, every)})
        except Conflict:
            log.info("the crawl was stopped and its result left out")
        except Exception:
            log.exception(S.MSG_INDEX_ERROR)
            message = S.MSG_STOPPED if self._stopped.is_set() else S.MSG_INDEX_ERROR
            try:
                self.store.commit(state, whole={"site": access.final_status(site, F.expr("localtimestamp()"), site.select("site_id", F.lit(message).alias("error")))})
            except Conflict:
                log.info("stopped")

    def wait(self, seconds: float | None = None) -> None:
        """Until the job ends."""
        if self._job is not None:
            self._job.join(seconds)

    def stop_indexing(self) -> tuple[int, str]:
        """Ends the crawl before its next round, waits for it, and marks sites that are still being indexed as stopped."""

        def work() -> tuple[int, str]:
            busy = access.site_statuses(self.store.read("site")).filter(F.col("status") == S.INDEXING)
            if not self.active and busy.isEmpty():
                raise RequestError(S.MSG_NOT_INDEXING)
            self._stopped.set()
            self.wait()
            state = self.store.manifest()
            site = self.store.read("site", state=state)
            if not site.filter(F.col("status") == S.INDEXING).isEmpty():
                self.store.commit(state, whole={"site": access.stop_indexing_sites(site, F.expr("localtimestamp()"))})
            return _answer(200, result=True)

        return _guarded(S.MSG_FAIL_STOP, work)

    def index_page(self, url: str) -> tuple[int, str]:
        """Fetches one page of a configured site and replaces its postings. A failed fetch leaves the old page and marks the site as failed."""

        def work() -> tuple[int, str]:
            one = self.spark.createDataFrame([(url,)], "u string")
            link, domain, path = one.select(U.close_slash(U.url_decoded(F.col("u"))).alias("l")).select("l", U.domain_link(F.col("l")), U.relative_link(F.col("l"))).first()
            name = next((s.name for s in self.settings.sites if s.url == domain), None)
            if name is None:
                raise RequestError(S.MSG_OUTSIDE)
            state = self.store.manifest()
            site = self.store.read("site", state=state)
            site_id = access.site_by_url(site, domain).agg(F.min("site_id")).first()[0]
            if site_id is None:
                site_id = (site.agg(F.max("site_id")).first()[0] or 0) + 1

            def with_site(status: str, error: str | None) -> DataFrame:
                row = self.spark.createDataFrame([(site_id, domain, name, status, error)], "site_id int, url string, name string, status string, last_error string").withColumn("status_time", F.expr("localtimestamp()"))
                return site.filter(F.col("site_id") != site_id).unionByName(row)

            code, content, error = self.get(link)
            if error is not None or code != 200:
                message = S.MSG_PAGE_PROCESS if error is not None else f"{S.MSG_PAGE_REQUEST}{code}"
                self.store.commit(state, whole={"site": with_site(S.FAILED, f"{message} - {link}")})
                if error is not None:
                    raise RuntimeError(error)
                raise RequestError(message)
            page = self.store.read("page", state=state)
            old = access.page_at(page, site_id, path).agg(F.min("page_id")).first()[0]
            page_id = old if old is not None else (page.agg(F.max("page_id")).first()[0] or 0) + 1
            new = self.spark.createDataFrame([(page_id, site_id, path, code, content)], S.PAGE)
            replace_pages(self.store, state, new, index.term_counts(new, F.col("content"), self.dictionary), whole={"site": with_site(S.INDEXED, None)})
            return _answer(200, result=True)

        return _guarded(S.MSG_FAIL_PAGE, work)
