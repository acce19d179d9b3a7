"""Table schemas and settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SITE = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("url", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("status_time", T.TimestampNTZType()),
    T.StructField("last_error", T.StringType()),
])
PAGE = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("site_id", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("code", T.IntegerType()),
    T.StructField("content", T.StringType()),
])
LEMMA = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("lemma", T.StringType()),
    T.StructField("frequency", T.LongType()),
])
SEARCH_INDEX = T.StructType([
    T.StructField("site_id", T.IntegerType()),
    T.StructField("page_id", T.LongType()),
    T.StructField("lemma", T.StringType()),
    T.StructField("rating", T.FloatType()),
])
LEMMA_DICT = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("form", T.StringType()),
    T.StructField("normal_form", T.StringType()),
    T.StructField("form_rank", T.IntegerType()),
    T.StructField("info", T.StringType()),
])
TABLES = {"site": SITE, "page": PAGE, "lemma": LEMMA, "search_index": SEARCH_INDEX, "lemma_dict": LEMMA_DICT}

INDEXING, INDEXED, FAILED = STATUSES = ("INDEXING", "INDEXED", "FAILED")

# The texts of the API's errors.
MSG_ALREADY_INDEXING = "Индексация уже запущена"
MSG_NOT_INDEXING = "Индексация не запущена"
MSG_STOPPED = "Индексация остановлена пользователем"
MSG_INDEX_ERROR = "Ошибка индексации"
MSG_OUTSIDE = "Данная страница находится за пределами сайтов, указанных в конфигурационном файле"
MSG_PAGE_REQUEST = "Ошибка запроса страницы: "
MSG_PAGE_PROCESS = "Ошибка обработки страницы"
MSG_EMPTY_QUERY = "Задан пустой поисковый запрос"
MSG_NO_SITES = "Сайты для поиска не проиндексированы"
MSG_FAIL_STATISTICS = "Ошибка получения статистики"
MSG_FAIL_START = "Ошибка индексации сайтов"
MSG_FAIL_STOP = "Ошибка остановки индексации сайтов"
MSG_FAIL_PAGE = "Ошибка индексации страницы"
MSG_FAIL_SEARCH = "Ошибка поиска"


@dataclass(frozen=True)
class SiteConfig:
    """An entry of the allow-list."""

    url: str
    name: str


@dataclass(frozen=True)
class SearchSettings:
    """Limits of search and snippets."""

    default_limit: int = 20
    page_count_limit: int = 2500
    page_start_count_limit: int = 4000
    lemmas_count_for_page_limit: int = 3
    snippet_max_size: int = 180
    snippet_part_size: int = 30
    time_zone: str = "+00:00"


@dataclass(frozen=True)
class SearchRequest:
    """A search as the endpoint takes it; limit 0 means the default limit."""

    query: str
    offset: int = 0
    limit: int = 0
    site: str | None = None


@dataclass(frozen=True)
class Settings:
    """The whole configuration."""

    sites: tuple[SiteConfig, ...] = ()
    search: SearchSettings = field(default_factory=SearchSettings)
    user_agent: str = "quillon"
    referrer: str = ""
