"""Registered queries for the operators that the catalogue's own do not reach, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.functions import urls as U
from quillon.operators import access as A
from quillon.operators import crawl, index, search, snippet
from quillon.plans.catalog import ACCEPT, D_DOCS, DICT, DOC_TERMS, FULL, PAGE_QUERY, REL, STAT, _full, _stat, docs, query
from quillon.schemas import MSG_EMPTY_QUERY, MSG_NO_SITES, SearchRequest, SearchSettings
from quillon.sources.tables import cut, read_pages, read_table

TERMS = (*DOC_TERMS, *PAGE_QUERY.split())
TERMS_SQL = ", ".join(f"'{t}'" for t in TERMS)
# a form's normal forms by rank, then by name
FORMS = "nf AS (SELECT lang, form AS word, list(normal_form ORDER BY r, normal_form) AS forms FROM (SELECT lang, form, normal_form, coalesce(form_rank, 0) AS r FROM lemma_dict WHERE form IS NOT NULL AND normal_form IS NOT NULL GROUP BY ALL) GROUP BY lang, form)"
SURFACE = D_DOCS + """, sw AS (SELECT page_id, unnest(regexp_extract_all(text, '[а-яёА-ЯЁa-zA-Z]+')) AS w, generate_subscripts(regexp_extract_all(text, '[а-яёА-ЯЁa-zA-Z]+'), 1) AS pos FROM d),
lw AS (SELECT *, lower(w) AS word, CASE WHEN regexp_matches(lower(w), '[а-яё]') THEN 'ru' ELSE 'en' END AS lang FROM sw)"""


@query("q44_url_decode", "SELECT DISTINCT page_id, path FROM page WHERE page_id IS NOT NULL")
def q44(s, d):
    """Paths survive being encoded and decoded."""
    page = read_table(s, d, "page").filter("page_id is not null")
    return page.select("page_id", U.url_decoded(F.url_encode("path")).alias("path")).distinct()


@query("q45_query_lemmas", f"WITH {DICT}, {FORMS} SELECT DISTINCT word, unnest(forms) AS lemma FROM nf WHERE NOT EXISTS (SELECT 1 FROM dict WHERE dict.lang = nf.lang AND dict.word = nf.word AND dict.particle)")
def q45(s, d):
    """All forms of the dictionary as words of a query."""
    raw = read_table(s, d, "lemma_dict")
    return X.query_lemmas(raw.filter("form is not null and normal_form is not null").select("lang", F.col("form").alias("word")).distinct(), X.dictionary(raw))


@query("q46_word_languages", f"WITH {SURFACE} SELECT page_id, lang, count(*) AS n FROM lw GROUP BY ALL")
def q46(s, d):
    words = docs(s, d).select("page_id", F.explode(X.surface_words(F.col("text"))).alias("w"))
    return words.groupBy("page_id", X.word_language(F.col("w")).alias("lang")).agg(F.count("*").alias("n"))


@query("q47_words_by_lemmas", f"""WITH {SURFACE}, {FORMS}, hit AS (SELECT page_id, w, pos, coalesce(nf.forms, [lw.word]) AS forms FROM lw LEFT JOIN nf ON nf.lang = lw.lang AND nf.word = lw.word),
first AS (SELECT page_id, forms[1] AS lemma, w, min(pos) AS pos FROM hit WHERE list_has_any(forms, [{TERMS_SQL}]) GROUP BY ALL) SELECT page_id, lemma, string_agg(w, '|' ORDER BY pos) AS words FROM first GROUP BY ALL""")
def q47(s, d):
    got = X.words_by_lemmas(docs(s, d), F.col("text"), X.dictionary(read_table(s, d, "lemma_dict")), list(TERMS), "page_id")
    return got.select("page_id", "lemma", F.array_join("words", "|").alias("words"))


OK_EDGES = ACCEPT + f", oke AS (SELECT DISTINCT acc.site_id, acc.path, {REL} AS to_path FROM acc JOIN pg USING (page_id) WHERE pg.code = 200)"


@query("q48_page_scan", f"""WITH {OK_EDGES} SELECT pg.page_id, pg.code, CASE WHEN pg.code = 200 THEN coalesce(length(pg.content), 0) ELSE 0 END AS size,
 CASE WHEN pg.code = 200 THEN coalesce((SELECT string_agg(to_path, ' ' ORDER BY to_path) FROM oke WHERE oke.site_id = pg.site_id AND oke.path = pg.path), '') ELSE '' END AS links FROM pg""")
def q48(s, d):
    got = crawl.page_scan(read_pages(s, d), read_table(s, d, "site"))
    return got.select("page_id", "code", F.length("content").cast("long").alias("size"), F.array_join("sub_links", " ").alias("links"))


@query("q49_known_paths", "SELECT DISTINCT p.page_id FROM page p JOIN (SELECT DISTINCT site_id, path FROM page WHERE page_id % 2 <> 0) l ON l.site_id = p.site_id AND l.path = p.path WHERE p.page_id IS NOT NULL")
def q49(s, d):
    """Stored pages whose site and path a page of an odd id has."""
    page = read_table(s, d, "page").filter("page_id is not null").select("page_id", "site_id", "path")
    return A.known_paths(page, page.filter("page_id % 2 <> 0").select("site_id", "path")).select("page_id").distinct()


@query("q50_indexable_pages", "SELECT DISTINCT page_id FROM page WHERE page_id IS NOT NULL AND code = 200")
def q50(s, d):
    return index.indexable(read_table(s, d, "page").filter("page_id is not null").select("page_id", "code")).select("page_id").distinct()


@query("q51_final_status", "WITH f AS (SELECT site_id, min(path) AS error FROM page WHERE code >= 400 GROUP BY site_id) SELECT s.site_id, s.url, CASE WHEN f.error IS NULL THEN 'INDEXED' ELSE 'FAILED' END AS status, f.error AS last_error FROM site s LEFT JOIN f USING (site_id)")
def q51(s, d):
    """Sites of which a page failed are failed."""
    failed = read_table(s, d, "page").filter("code >= 400").select("site_id", F.col("path").alias("error"))
    return A.final_status(read_table(s, d, "site"), F.expr("localtimestamp()"), failed).select("site_id", "url", "status", "last_error")


@query("q52_wiped", "SELECT * FROM (VALUES ('lemma', 0::BIGINT), ('page', 0), ('search_index', 0), ('site', 0)) AS t(name, n)")
def q52(s, d):
    """All four tables without their rows."""
    counts = [index.wipe(read_table(s, d, t)).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("search_index", "lemma", "page", "site")]
    return reduce(DataFrame.unionByName, counts)


@query("q53_lemma_order", f"""SELECT site_id, lemma, frequency, CAST(row_number() OVER (PARTITION BY site_id ORDER BY frequency NULLS FIRST, lemma) AS INT) AS k
 FROM lemma WHERE lemma IN ({TERMS_SQL}) AND site_id IN (SELECT site_id FROM site WHERE status <> 'INDEXING')""")
def q53(s, d):
    """Lemma rows of the searchable sites, the rarest first."""
    rows = A.lemma_rows(read_table(s, d, "lemma"), s.createDataFrame([(t,) for t in TERMS], "lemma string"), A.searchable_sites(read_table(s, d, "site")))
    return rows.select("site_id", "lemma", "frequency", F.row_number().over(Window.partitionBy("site_id").orderBy("frequency", "lemma")).alias("k"))


@query("q54_paging_walk", f"WITH {FULL} SELECT page_id, (row_number() OVER (ORDER BY abs_rank DESC, page_id) - 1) // 100 * 100 AS start FROM res")
def q54(s, d):
    """All result pages one after another, as a reader who asks for more gets them."""
    ranks = cut(_full(s, d))
    parts = [part.select("page_id", F.lit(start).cast("long").alias("start")) for start, part in search.walk(ranks, 100)]
    return reduce(DataFrame.unionByName, parts, s.createDataFrame([], "page_id long, start long"))


_ROW = "'url': url, 'name': name, 'status': status, 'statusTime': statusTime"


@query("q55_statistics_json", f"WITH {STAT} SELECT url, CAST(CASE WHEN error IS NULL THEN to_json({{{_ROW}, 'pages': pages, 'lemmas': lemmas}}) ELSE to_json({{{_ROW}, 'error': error, 'pages': pages, 'lemmas': lemmas}}) END AS VARCHAR) AS row FROM st")
def q55(s, d):
    """The JSON rows of the statistics; null fields are left out."""
    return _stat(s, d).select("url", F.to_json(F.struct("*")).alias("row"))


@query("q56_crawl_sites", f"""WITH RECURSIVE {ACCEPT}, one AS (SELECT * FROM pg WHERE site_id IS NOT NULL AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY site_id, path ORDER BY page_id) = 1),
home AS (SELECT *, CASE WHEN path = min(path) OVER (PARTITION BY site_id) THEN '/' ELSE path END AS at FROM one),
edge AS (SELECT DISTINCT h.site_id, h.at, {REL} AS to_path FROM acc JOIN home h ON h.page_id = acc.page_id WHERE h.code = 200),
walk(site_id, path) AS (SELECT site_id, '/' FROM site UNION SELECT e.site_id, e.to_path FROM walk w JOIN edge e ON e.site_id = w.site_id AND e.at = w.path)
SELECT w.site_id, w.path, CASE WHEN h.page_id IS NULL THEN 404 ELSE h.code END AS code, CASE WHEN h.code = 200 THEN coalesce(length(h.content), 0) ELSE 0 END AS size FROM walk w LEFT JOIN home h ON h.site_id = w.site_id AND h.at = w.path""")
def q56(s, d):
    """A crawl of all sites from their roots, for which each site's first page stands; what is not stored answers 404."""
    pages = read_pages(s, d).filter("site_id is not null and path is not null")
    first = pages.groupBy("site_id", "path").agg(F.min("page_id").alias("page_id"))
    root = first.groupBy("site_id").agg(F.min("path").alias("_root"))
    one = pages.join(first.select("page_id"), "page_id", "left_semi").join(root, "site_id").withColumn("path", F.when(F.col("path") == F.col("_root"), "/").otherwise(F.col("path")))
    got, _ = crawl.crawl_sites(read_table(s, d, "site").select("site_id", "url"), crawl.stored_web(one))
    return got.select("site_id", "path", "code", F.length("content").cast("long").alias("size"))


def _outcome(site: DataFrame, req: SearchRequest) -> tuple[str, int, int]:
    try:
        sites, limit = search.check_request(req, site, SearchSettings())
        return "", sites.count(), limit
    except search.RequestError as e:
        return str(e), 0, 0


@query("q57_request_checks", f"""SELECT 'all' AS name, '' AS error, count(*) AS sites, 20 AS row_limit FROM site WHERE status <> 'INDEXING' UNION ALL SELECT 'empty', '{MSG_EMPTY_QUERY}', 0, 0 UNION ALL SELECT 'unknown', '{MSG_NO_SITES}', 0, 0
 UNION ALL SELECT 'busy', '{MSG_NO_SITES}', 0, 0 UNION ALL SELECT 'failed', '', count(*), 7 FROM site WHERE url = (SELECT min(url) FROM site WHERE status = 'FAILED') AND status <> 'INDEXING'""")
def q57(s, d):
    """What becomes of requests: without a query, for all sites, one that is not known, being indexed, or failed."""
    site = read_table(s, d, "site")
    failed = site.filter("status = 'FAILED'").agg(F.min("url")).first()[0]
    busy = s.createDataFrame([(1, "u", "n", "INDEXING", None, None)], site.schema)
    cases = {"all": (site, SearchRequest("x")), "empty": (site, SearchRequest("")), "unknown": (site, SearchRequest("x", site="?")), "busy": (busy, SearchRequest("x", site="u")), "failed": (site, SearchRequest("x", limit=7, site=failed))}
    return s.createDataFrame([(n, *_outcome(*c)) for n, c in cases.items()], "name string, error string, sites long, row_limit int")


# text, lemmas and snippet: fragments, their ends (white space at 30, 32, 34, ... counts, so the one at 35 or 31 does not), whole words,
# several spellings, and words that lie apart
SNIPPETS = (
    ("short cat text", "cat", "<b>cat</b> text"),
    ("cat.", "cat", "<b>cat</b>."),
    ("the cat", "cat", ""),
    ("no match", "cat", ""),
    ("cat and dog here", "cat dog", "<b>cat</b> and <b>dog</b> here...<b>dog</b>"),
    ("", "cat", ""),
    ("a cat sat on the mat in the old house by the river and a dog ran away from it all day", "cat dog", "<b>cat</b> sat on the mat in the old house by...<b>dog</b> ran away from it all day"),
    ("cats and a cat, category: cat2 is here", "cat", "<b>cat</b>, category: cat2 is here"),
    ("Cat CAT cat sits on a very long wooden bench today", "cat", "<b>Cat</b> <b>CAT</b> <b>cat</b> sits on a very long wooden"),
)


@query("q31_snippet_cases", "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, (_, _, x) in enumerate(SNIPPETS)) + ") AS t(n, snippet)")
def q31c(s: SparkSession, d: str) -> DataFrame:
    """Small texts, worked out by hand from the defined behaviour."""
    rows = s.createDataFrame([(k, t, q.split()) for k, (t, q, _) in enumerate(SNIPPETS)], "n int, text string, lemmas array<string>")
    return rows.select("n", snippet.snippet_of("text", "lemmas").alias("snippet"))
