"""The registered queries of the engine's own operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import html as H
from quillon.functions import text as X
from quillon.functions import urls as U
from quillon.operators import access as A
from quillon.operators import crawl, index, search, stats
from quillon.operators.snippet import snippet_udf
from quillon.schemas import SearchSettings
from quillon.sources.tables import cut, if_small, read_pages, read_table

#: The words of the example searches, over documents and over pages.
DOC_TERMS = ("printer", "orchard", "gentle", "cable")
PAGE_QUERY = "старый принтер хранит хлеб"
LOW = SearchSettings(page_start_count_limit=40, lemmas_count_for_page_limit=2, page_count_limit=30)

Q = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def docs(s: SparkSession, d: str) -> DataFrame:
    """Documents as pages: the source is the site; documents without a source or a text are on no site."""
    t = read_table(s, d, "documents")
    return t.filter("source is not null and text is not null").select(F.col("source").alias("site_id"), F.col("doc_id").alias("page_id"), "text", "lang")


def doc_index(s: SparkSession, d: str) -> index.Index:
    return index.build(docs(s, d), F.col("text"), None, html=False)


def page_urls(s: SparkSession, d: str) -> DataFrame:
    site = read_table(s, d, "site").select("site_id", "url", "name", "status")
    pages = read_table(s, d, "page").filter("page_id is not null").select("page_id", "site_id", "path", "code").distinct()
    return pages.join(site, "site_id").select("*", F.concat("url", "path").alias("link"))


P_URLS = "pu AS (SELECT DISTINCT p.page_id, p.site_id, p.path, p.code, s.url, s.url || p.path AS link FROM page p JOIN site s ON p.site_id = s.site_id WHERE p.page_id IS NOT NULL)"
D_DOCS = "d AS (SELECT source AS site_id, doc_id AS page_id, text, lang FROM documents WHERE source IS NOT NULL AND text IS NOT NULL)"
D_TOK = D_DOCS + ", w AS (SELECT site_id, page_id, unnest(list_concat(regexp_extract_all(lower(text), '[а-яё]+'), regexp_extract_all(lower(text), '[a-z]+'))) AS lemma FROM d)"
D_TF = D_TOK + ", tf AS (SELECT site_id, page_id, lemma, CAST(count(*) AS FLOAT) AS rating FROM w GROUP BY ALL)"
D_DF = D_TF + ", df AS (SELECT site_id, lemma, count(*) AS frequency FROM tf GROUP BY site_id, lemma)"
PAGES = "pg AS (SELECT page_id, any_value(site_id) AS site_id, any_value(path) AS path, any_value(code) AS code, any_value(content) AS content FROM page WHERE page_id IS NOT NULL GROUP BY page_id)"


@query("q01_domain_link", f"WITH {P_URLS} SELECT page_id, regexp_extract(link, '^.*[/]{{2}}[^/]*') AS domain FROM pu")
def q01(s, d):
    return page_urls(s, d).select("page_id", U.domain_link(F.col("link")).alias("domain"))


@query("q02_relative_path", f"WITH {P_URLS}, x AS (SELECT page_id, link, regexp_extract(link, '^.*[/]{{2}}[^/]*') AS dom FROM pu) SELECT page_id, CASE WHEN dom = '' THEN link ELSE replace(link, dom, '') END AS rel FROM x")
def q02(s, d):
    return page_urls(s, d).select("page_id", U.relative_link(F.col("link")).alias("rel"))


@query("q03_close_slash", f"WITH {P_URLS} SELECT page_id, CASE WHEN link = '' OR link LIKE '%/' THEN link ELSE link || '/' END AS closed FROM pu")
def q03(s, d):
    return page_urls(s, d).select("page_id", U.close_slash(F.col("link")).alias("closed"))


@query("q04_link_mask", f"WITH {P_URLS} SELECT page_id, starts_with(link, url || '/') AND (regexp_full_match(substr(link, length(url) + 2), '[^?#.]*') OR regexp_full_match(substr(link, length(url) + 2), '[^?#\\n]*\\.html/?')) AS accepted FROM pu")
def q04(s, d):
    return page_urls(s, d).select("page_id", F.rlike(F.col("link"), U.link_mask(F.col("url"))).alias("accepted"))


def _links(s, d):
    pages = read_pages(s, d).join(if_small(read_table(s, d, "site").select("site_id", "url")), "site_id")
    return U.extract_links(pages, F.col("url"), F.col("content"), "page_id", "site_id", "path")


LINKS = PAGES + """, raw AS (SELECT g.page_id, g.site_id, g.path, s.url, unnest(regexp_extract_all(g.content, '(?i)<a\\s+[^>]*?href="([^"]*)"', 1)) AS h,
 generate_subscripts(regexp_extract_all(g.content, '(?i)<a\\s+[^>]*?href="([^"]*)"', 1), 1) - 1 AS pos FROM pg g JOIN site s ON g.site_id = s.site_id),
abs_ AS (SELECT *, CASE WHEN h LIKE '/%' THEN regexp_extract(url, '^.*[/]{2}[^/]*') || h WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN url LIKE '%/' THEN url || h ELSE url || '/' || h END AS a FROM raw),
links AS (SELECT page_id, site_id, path, url, CAST(pos AS INT) AS pos, CASE WHEN a LIKE '%/' THEN a ELSE a || '/' END AS link FROM abs_ WHERE a <> '')"""
ACCEPT = LINKS + """, acc AS (SELECT DISTINCT page_id, site_id, path, url, link FROM links WHERE link <> url || path AND NOT contains(regexp_extract(url, '^.*[/]{2}[^/]*') || '/', link)
 AND starts_with(link, url || '/') AND (regexp_full_match(substr(link, length(url) + 2), '[^?#.]*') OR regexp_full_match(substr(link, length(url) + 2), '[^?#\\n]*\\.html/?')))"""


@query("q05_link_extract", f"WITH {LINKS} SELECT page_id, pos, link FROM links")
def q05(s, d):
    return _links(s, d).select("page_id", "pos", "link")


def _accepted(s, d):
    return U.accept_links(_links(s, d), F.concat("site_url", "path"), "page_id", "site_id", "path")


@query("q06_sublink_accept", f"WITH {ACCEPT} SELECT page_id, link FROM acc")
def q06(s, d):
    return _accepted(s, d).select("page_id", "link")


REL = "CASE WHEN regexp_extract(link, '^.*[/]{2}[^/]*') = '' THEN link ELSE replace(link, regexp_extract(link, '^.*[/]{2}[^/]*'), '') END"


@query("q07_new_links", f"WITH {ACCEPT}, l AS (SELECT DISTINCT site_id, {REL} AS path FROM acc) SELECT l.site_id, l.path FROM l WHERE NOT EXISTS (SELECT 1 FROM page p WHERE p.site_id = l.site_id AND p.path = l.path)")
def q07(s, d):
    links = _accepted(s, d).select("site_id", U.relative_link(F.col("link")).alias("path")).distinct()
    return A.new_links(links, read_table(s, d, "page"))


EDGES = ACCEPT + f", edge AS (SELECT DISTINCT site_id, path, {REL} AS to_path FROM acc), stored AS (SELECT DISTINCT site_id, path FROM pg WHERE site_id IS NOT NULL AND path IS NOT NULL)"


@query("q08_crawl_reachable", f"WITH {EDGES} SELECT site_id, path, 0 AS level FROM stored UNION ALL SELECT site_id, to_path, 1 FROM (SELECT DISTINCT site_id, to_path FROM edge) e WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.site_id = e.site_id AND s.path = e.to_path)")
def q08(s, d):
    """From all stored pages."""
    pages = read_pages(s, d)
    links = crawl.page_links(pages, read_table(s, d, "site"))
    return crawl.reachable(pages.select("site_id", "path").filter("path is not null and site_id is not null"), links)


@query("q08_crawl_levels", f"""WITH RECURSIVE {EDGES}, seed AS (SELECT site_id, min(path) AS path FROM stored GROUP BY site_id),
walk(site_id, path, level) AS (SELECT site_id, path, 0 FROM seed UNION SELECT e.site_id, e.to_path, w.level + 1 FROM walk w JOIN edge e ON e.site_id = w.site_id AND e.path = w.path WHERE w.level < 100)
SELECT site_id, path, CAST(min(level) AS INT) AS level FROM walk GROUP BY site_id, path""")
def q08l(s, d):
    """From one page of each site, round by round."""
    pages = read_pages(s, d)
    links = cut(crawl.page_links(pages, read_table(s, d, "site")).distinct())
    return crawl.reachable(pages.filter("path is not null and site_id is not null").groupBy("site_id").agg(F.min("path").alias("path")), links)


@query("q09_body_tokens", f"""WITH {PAGES}, t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(content, '(?is)<head\\b.*?</head\\s*>|<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&[#0-9A-Za-z]+;', ' ', 'g') AS x FROM pg),
w AS (SELECT page_id, unnest(regexp_extract_all(lower(x), '[a-z]+')) AS token FROM t) SELECT page_id, token, count(*) AS n FROM w GROUP BY ALL""")
def q09(s, d):
    t = read_pages(s, d).select("page_id", F.explode(X.tokens(H.token_text(F.col("content")), X.EN)).alias("token"))
    return t.groupBy("page_id", "token").agg(F.count("*").alias("n"))


@query("q10_title", f"""WITH {PAGES}, t AS (SELECT page_id, regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1) AS x FROM pg),
u AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&') AS x FROM t) SELECT page_id, coalesce(trim(regexp_replace(x, '\\s+', ' ', 'g')), '') AS title FROM u""")
def q10(s, d):
    return read_pages(s, d).select("page_id", H.title(F.col("content")).alias("title"))


@query("q11_meta_description", f"""WITH {PAGES} SELECT page_id, coalesce(regexp_extract(content, '(?i)<meta\\s+name="description"\\s+content="([^"]*)"', 1), '') AS description FROM pg""")
def q11(s, d):
    return read_pages(s, d).select("page_id", H.description(F.col("content")).alias("description"))


def _tokens(lang, letters):
    sql = f"WITH {D_DOCS}, w AS (SELECT page_id, unnest(regexp_extract_all(lower(text), '[{letters}]+')) AS token FROM d) SELECT page_id, token, count(*) AS n FROM w GROUP BY ALL"

    def q(s, d):
        return docs(s, d).select("page_id", F.explode(X.tokens(F.col("text"), lang)).alias("token")).groupBy("page_id", "token").agg(F.count("*").alias("n"))

    return sql, q


_sql, _q = _tokens(X.EN, "a-z")
query("q12_tokens_en", _sql)(_q)
_sql, _q = _tokens(X.RU, "а-яё")
query("q13_tokens_ru", _sql)(_q)

DICT = """dict AS (SELECT lang, form AS word, arg_min(normal_form, (coalesce(form_rank, 0), normal_form)) AS first_form,
 bool_or(coalesce(CASE WHEN lang = 'ru' THEN list_has_any(regexp_split_to_array(upper(info), '[\\s,|]+'), ['МЕЖД', 'ПРЕДЛ', 'СОЮЗ', 'ЧАСТ']) ELSE list_has_any(regexp_split_to_array(upper(info), '[\\s,|]+'), ['PREP', 'ARTICLE', 'CONJ']) END, false)) AS particle
 FROM lemma_dict WHERE form IS NOT NULL AND normal_form IS NOT NULL GROUP BY lang, form)"""
LANG_WORDS = D_DOCS + """, lw AS (SELECT site_id, page_id, 'ru' AS lang, unnest(regexp_extract_all(lower(text), '[а-яё]+')) AS word FROM d
 UNION ALL SELECT site_id, page_id, 'en', unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM d)"""
LEMMAS = LANG_WORDS + ", " + DICT + ", lem AS (SELECT lw.site_id, lw.page_id, coalesce(dict.first_form, lw.word) AS lemma FROM lw LEFT JOIN dict ON lw.lang = dict.lang AND lw.word = dict.word WHERE NOT coalesce(dict.particle, false))"


@query("q14_particle_filter", f"WITH {LANG_WORDS}, {DICT} SELECT lw.lang, lw.word, count(*) AS n FROM lw LEFT JOIN dict ON lw.lang = dict.lang AND lw.word = dict.word WHERE NOT coalesce(dict.particle, false) GROUP BY ALL")
def q14(s, d):
    words = X.token_rows(docs(s, d), F.col("text")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    return words.join(X.dictionary(read_table(s, d, "lemma_dict")), ["lang", "word"], "left").filter(~F.coalesce("particle", F.lit(False))).select("lang", "word", "n")


@query("q15_term_count", f"WITH {LEMMAS} SELECT site_id, page_id, lemma, CAST(count(*) AS DOUBLE) AS rating FROM lem GROUP BY ALL")
def q15(s, d):
    return index.term_counts(docs(s, d), F.col("text"), X.dictionary(read_table(s, d, "lemma_dict")), html=False).withColumn("rating", F.col("rating").cast("double"))


@query("q16_lemma_frequency", f"WITH {LEMMAS} SELECT site_id, lemma, count(DISTINCT page_id) AS frequency FROM lem GROUP BY ALL")
def q16(s, d):
    return index.build(docs(s, d), F.col("text"), X.dictionary(read_table(s, d, "lemma_dict")), html=False).frequencies


@query("q17_postings_join", "SELECT DISTINCT i.site_id, i.page_id, i.lemma, CAST(i.rating AS DOUBLE) AS rating FROM search_index i WHERE EXISTS (SELECT 1 FROM lemma l WHERE l.site_id = i.site_id AND l.lemma = i.lemma)")
def q17(s, d):
    known = read_table(s, d, "lemma").select("site_id", "lemma").distinct()
    return index.insert_postings(read_table(s, d, "search_index"), known).select("site_id", "page_id", "lemma", F.col("rating").cast("double").alias("rating"))


@query("q18_union_distinct", "SELECT site_id, lemma FROM lemma UNION SELECT site_id, lemma FROM search_index")
def q18(s, d):
    cols = ("site_id", "lemma")
    return read_table(s, d, "lemma").select(*cols).union(read_table(s, d, "search_index").select(*cols)).distinct()


HALVES = D_TF + ", a AS (SELECT site_id, lemma, count(*) AS f FROM tf WHERE page_id % 2 = 0 GROUP BY ALL), b AS (SELECT site_id, lemma, count(*) AS f FROM tf WHERE page_id % 2 <> 0 GROUP BY ALL)"


@query("q19_frequency_upsert", f"WITH {HALVES} SELECT site_id, lemma, CAST(sum(f) AS BIGINT) AS frequency FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL")
def q19(s, d):
    p = cut(doc_index(s, d).postings)
    return index.upsert_frequencies(index.frequencies(p.filter("page_id % 2 = 0")), index.frequencies(p.filter("page_id % 2 <> 0")))


@query("q20_page_reindex", f"WITH {D_TF}, odd AS (SELECT * FROM tf WHERE page_id % 2 <> 0 OR length(lemma) > 5) SELECT site_id, lemma, count(*) AS frequency FROM odd GROUP BY ALL")
def q20(s, d):
    """Every page of an even id comes again with its short words gone."""
    old = cut(doc_index(s, d).postings)
    old = index.Index(old, index.frequencies(old))
    again = old.postings.filter("page_id % 2 = 0 and length(lemma) > 5")
    empty = old.postings.filter("page_id % 2 = 0").select("page_id").distinct()
    return index.add_pages(index.delete_pages(old, empty), again).frequencies


@query("q21_zero_lemma_purge", f"WITH {D_DF} SELECT site_id, lemma, frequency - 1 AS frequency FROM df WHERE frequency - 1 > 0")
def q21(s, d):
    f = doc_index(s, d).frequencies
    return index.purge_zero(index.decrease(f, f), f)


@query("q22_query_lemma_pick", """WITH lm AS (SELECT lemma, max(frequency) AS f FROM lemma GROUP BY lemma), cand AS (SELECT DISTINCT form AS word, normal_form AS lemma FROM lemma_dict WHERE form IS NOT NULL AND normal_form IS NOT NULL),
r AS (SELECT c.word, c.lemma, row_number() OVER (PARTITION BY c.word ORDER BY lm.f DESC NULLS LAST, c.lemma) AS k FROM cand c LEFT JOIN lm ON c.lemma = lm.lemma) SELECT DISTINCT lemma FROM r WHERE k = 1""")
def q22(s, d):
    cand = read_table(s, d, "lemma_dict").filter("form is not null and normal_form is not null").select(F.col("form").alias("word"), F.col("normal_form").alias("lemma")).distinct()
    return search.pick_lemmas(cand, read_table(s, d, "lemma"))


VALS = ", ".join(f"('{t}')" for t in DOC_TERMS)
HIT = D_DF + f""", hit AS (SELECT df.* FROM df JOIN (VALUES {VALS}) AS q(lemma) ON df.lemma = q.lemma)"""
RANKED = HIT + f""", full_site AS (SELECT site_id FROM hit GROUP BY site_id HAVING count(*) = {len(DOC_TERMS)}),
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY h.site_id ORDER BY h.frequency, h.lemma) AS k FROM hit h JOIN full_site f ON h.site_id = f.site_id)"""


def narrowed_sql(cap: int, late: int, common: int, ranked: str = RANKED) -> str:
    return ranked + f""", capped AS (SELECT r.site_id, r.k, i.page_id, i.rating, row_number() OVER (PARTITION BY r.site_id, r.k ORDER BY i.page_id) AS pr FROM tf i JOIN ranked r ON i.site_id = r.site_id AND i.lemma = r.lemma),
post AS (SELECT *, row_number() OVER (PARTITION BY site_id, page_id ORDER BY k) AS rn FROM capped WHERE k > 1 OR pr <= {cap}),
depth AS (SELECT site_id, page_id, max(CASE WHEN rn = k THEN k ELSE 0 END) AS d, CAST(sum(rating) AS DOUBLE) AS abs_rank FROM post GROUP BY site_id, page_id),
size AS (SELECT r.site_id, r.k, r.frequency, count(d.page_id) AS s FROM ranked r LEFT JOIN depth d ON d.site_id = r.site_id AND d.d >= r.k GROUP BY ALL),
lagged AS (SELECT *, lag(s) OVER (PARTITION BY site_id ORDER BY k) AS prev_s FROM size),
stop AS (SELECT site_id, max(k) AS n, min(CASE WHEN s = 0 THEN k END) AS kzero, min(CASE WHEN s = 0 OR s = prev_s OR (k > {late} AND frequency > {common}) THEN k END) AS kstop FROM lagged GROUP BY site_id),
cut AS (SELECT site_id, coalesce(kstop - 1, n) AS need FROM stop WHERE kzero IS NULL OR kzero > kstop),
res AS (SELECT d.site_id, d.page_id, abs_rank, abs_rank / max(abs_rank) OVER () AS relevance FROM depth d JOIN cut c ON d.site_id = c.site_id AND d.d >= c.need AND d.d > 0)"""


FULL = narrowed_sql(4000, 3, 2500)


def term_index(s: SparkSession, d: str) -> index.Index:
    """The part of the documents' index that a search for ``DOC_TERMS`` reads."""
    postings = index.term_counts(docs(s, d), F.col("text"), None, html=False).filter(F.col("lemma").isin(list(DOC_TERMS)))
    postings = cut(postings)
    return index.Index(postings, index.frequencies(postings))


def _ranked(s, d):
    i = term_index(s, d)
    terms = s.createDataFrame([(t,) for t in DOC_TERMS], "lemma string")
    return i, search.ranked_lemmas(terms, i.frequencies)


@query("q23_lemma_lookup", f"WITH {HIT} SELECT site_id, lemma, frequency FROM hit")
def q23(s, d):
    f = term_index(s, d).frequencies
    return A.lemma_rows(f, s.createDataFrame([(t,) for t in DOC_TERMS], "lemma string"), f)


@query("q24_site_division", f"WITH {RANKED} SELECT site_id, lemma, frequency, CAST(k AS INT) AS k FROM ranked")
def q24(s, d):
    return _ranked(s, d)[1]


@query("q25_candidate_pages", f"WITH {narrowed_sql(40, 2, 30)} SELECT site_id, page_id FROM res")
def q25(s, d):
    i, r = _ranked(s, d)
    return search.candidates(i.postings, r, LOW).select("site_id", "page_id")


def _full(s, d):
    i, r = _ranked(s, d)
    return search.relevance(search.candidates(i.postings, r))


@query("q26_ranked_pages", f"WITH {FULL} SELECT site_id, page_id, abs_rank, relevance FROM res")
def q26(s, d):
    return _full(s, d)


@query("q27_result_count", f"WITH {FULL} SELECT count(*) AS n FROM res")
def q27(s, d):
    return _full(s, d).agg(F.count("*").alias("n"))


@query("q28_result_page", f"WITH {FULL} SELECT page_id, relevance FROM res ORDER BY abs_rank DESC, page_id LIMIT 10 OFFSET 10")
def q28(s, d):
    return search.result_page(_full(s, d), 10, 10).select("page_id", "relevance")


def page_postings(s: SparkSession, d: str) -> DataFrame:
    """The stored postings, each once."""
    return read_table(s, d, "search_index").filter("lemma is not null").groupBy("site_id", "page_id", "lemma").agg(F.max("rating").alias("rating"))


@query("q29_search_full", f"WITH {FULL}, top AS (SELECT * FROM res ORDER BY abs_rank DESC, page_id LIMIT 20) SELECT t.page_id, t.site_id AS site, d.lang, relevance FROM top t JOIN documents d ON d.doc_id = t.page_id")
def q29(s, d):
    top = search.result_page(_full(s, d), 0, 20)
    meta = docs(s, d).select("page_id", "lang")
    return meta.join(F.broadcast(top), "page_id").select("page_id", F.col("site_id").alias("site"), "lang", "relevance")


Q_WORDS = ", ".join(f"('{w}')" for w in PAGE_QUERY.split())
P_POST = "tf AS (SELECT site_id, page_id, lemma, max(rating) AS rating FROM search_index WHERE lemma IS NOT NULL GROUP BY ALL)"
# the query's lemmas, picked by their highest frequency, and the sites that know them all, over the stored postings of the pages
P_RANKED = P_POST + f""", df AS (SELECT site_id, lemma, count(*) AS frequency FROM tf GROUP BY ALL), {DICT},
cand AS (SELECT DISTINCT q.word, coalesce(d.normal_form, q.word) AS lemma FROM (VALUES {Q_WORDS}) AS q(word) LEFT JOIN (SELECT DISTINCT form, normal_form FROM lemma_dict WHERE lang = 'ru' AND form IS NOT NULL AND normal_form IS NOT NULL) d ON d.form = q.word
 WHERE NOT EXISTS (SELECT 1 FROM dict WHERE lang = 'ru' AND word = q.word AND particle)),
best AS (SELECT lemma, max(frequency) AS f FROM df GROUP BY lemma),
pick AS (SELECT DISTINCT lemma FROM (SELECT c.lemma, row_number() OVER (PARTITION BY c.word ORDER BY b.f DESC NULLS LAST, c.lemma) AS n FROM cand c LEFT JOIN best b ON b.lemma = c.lemma) WHERE n = 1),
hit AS (SELECT df.* FROM df JOIN pick USING (lemma) WHERE df.site_id IN (SELECT site_id FROM site WHERE status <> 'INDEXING')),
full_site AS (SELECT site_id FROM hit GROUP BY site_id HAVING count(*) = (SELECT count(*) FROM pick)),
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY h.site_id ORDER BY h.frequency, h.lemma) AS k FROM hit h JOIN full_site f ON h.site_id = f.site_id)"""
TITLE = """title AS (SELECT page_id, coalesce(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(content, '(?is)<title[^>]*>(.*?)</title>', 1),
 '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')), '') AS title FROM pg)"""
P_TOP = f"""WITH {narrowed_sql(4000, 3, 2500, P_RANKED)}, {PAGES}, {TITLE}, top AS (SELECT * FROM res ORDER BY abs_rank DESC, page_id LIMIT 20)
, rows_ AS (SELECT t.page_id, s.url AS site, s.name AS "siteName", pg.path AS uri, title.title, t.relevance FROM top t JOIN pg USING (page_id) JOIN title USING (page_id) JOIN site s ON s.site_id = pg.site_id)"""


def _page_search(s, d) -> DataFrame:
    postings = page_postings(s, d)
    ranks, _ = search.search_ranks(s, PAGE_QUERY, postings, index.frequencies(postings), A.searchable_sites(read_table(s, d, "site")), X.dictionary(read_table(s, d, "lemma_dict")))
    return ranks


@query("q29_search_pages", P_TOP + " SELECT * FROM rows_")
def q29p(s, d):
    top = search.result_page(_page_search(s, d), 0, 20)
    return search.decorate(top, read_pages(s, d), read_table(s, d, "site"), H.title(F.col("content")))


@query("q30_surface_forms", f"""WITH {D_DOCS}, w AS (SELECT page_id, unnest(regexp_extract_all(text, '[а-яёА-ЯЁa-zA-Z]+')) AS word FROM d) SELECT page_id, lower(word) AS lemma, count(DISTINCT word) AS forms FROM w WHERE lower(word) IN ({", ".join(repr(t) for t in DOC_TERMS)}) GROUP BY ALL""")
def q30(s, d):
    w = docs(s, d).select("page_id", F.explode(X.surface_words(F.col("text"))).alias("word")).filter(F.lower("word").isin(list(DOC_TERMS)))
    return w.groupBy("page_id", F.lower("word").alias("lemma")).agg(F.countDistinct("word").alias("forms"))


@query("q31_snippet")
def q31(s, d):
    top = search.result_page(_full(s, d), 0, 20).select("page_id", "relevance")
    text = docs(s, d).select("page_id", "text").join(F.broadcast(top), "page_id")
    return text.select("page_id", snippet_udf(set(DOC_TERMS), None, html=False)(F.col("text")).alias("snippet"))


SITES = ("https://кухня.test", "https://melody-tortor.test", "https://crawler-onzu.test", "https://legend-garzulis.example")
IN_SITES = ", ".join(f"'{u}'" for u in SITES)


@query("q32_indexed_sites", "SELECT site_id, url FROM site WHERE status <> 'INDEXING'")
def q32(s, d):
    return A.searchable_sites(read_table(s, d, "site")).select("site_id", "url")


@query("q33_sites_by_url", f"SELECT site_id, url FROM site WHERE url IN ({IN_SITES})")
def q33(s, d):
    return A.sites_by_urls(read_table(s, d, "site"), SITES).select("site_id", "url")


@query("q33_site_by_url", f"SELECT site_id, url FROM site WHERE url = '{SITES[1]}'")
def q33b(s, d):
    return A.site_by_url(read_table(s, d, "site"), SITES[1]).select("site_id", "url")


@query("q34_site_status_list", "SELECT status FROM site")
def q34(s, d):
    return A.site_statuses(read_table(s, d, "site"))


@query("q35_stop_indexing", "SELECT site_id, CASE WHEN site_id % 2 = 0 OR status = 'INDEXING' THEN 'FAILED' ELSE status END AS status, CASE WHEN site_id % 2 = 0 OR status = 'INDEXING' THEN 'Индексация остановлена пользователем' ELSE last_error END AS last_error FROM site")
def q35(s, d):
    """Sites of an even id are set to being indexed first."""
    site = read_table(s, d, "site").withColumn("status", F.when(F.col("site_id") % 2 == 0, "INDEXING").otherwise(F.col("status")))
    return A.stop_indexing_sites(site, F.expr("localtimestamp()")).select("site_id", "status", "last_error")


@query("q36_page_lookup", "SELECT DISTINCT page_id, site_id, path FROM page WHERE site_id = 3 AND path = (SELECT min(path) FROM page WHERE site_id = 3)")
def q36(s, d):
    page = read_table(s, d, "page")
    path = page.filter("site_id = 3").agg(F.min("path")).first()[0]
    return A.page_at(page, 3, path).select("page_id", "site_id", "path").distinct()


@query("q37_page_lemmas", "SELECT site_id, lemma FROM search_index WHERE page_id = (SELECT min(page_id) FROM search_index)")
def q37(s, d):
    i = read_table(s, d, "search_index")
    return A.page_lemmas(i, i.agg(F.min("page_id")).first()[0])


@query("q37_summed_ranks", "SELECT page_id, sum(CAST(rating AS DOUBLE)) AS abs_rank FROM search_index WHERE (site_id, lemma) IN (SELECT site_id, lemma FROM lemma WHERE frequency > 20) GROUP BY page_id")
def q37r(s, d):
    i = read_table(s, d, "search_index")
    return A.summed_ranks(i, read_table(s, d, "lemma").filter("frequency > 20"), i)


STAT = """p AS (SELECT site_id, count(*) AS n FROM page GROUP BY site_id), l AS (SELECT site_id, count(*) AS n FROM lemma GROUP BY site_id),
cfg AS (SELECT DISTINCT url, min(name) OVER (PARTITION BY url) AS name FROM site WHERE site_id % 3 <> 0 UNION ALL SELECT 'https://nowhere.test', 'Nowhere'),
one AS (SELECT * FROM site QUALIFY row_number() OVER (PARTITION BY url ORDER BY site_id) = 1),
st AS (SELECT c.url, c.name, coalesce(s.status, '') AS status, coalesce(CAST(floor(epoch(s.status_time)) AS BIGINT), 0) AS statusTime, s.last_error AS error, coalesce(p.n, 0) AS pages, coalesce(l.n, 0) AS lemmas
 FROM cfg c LEFT JOIN one s ON c.url = s.url LEFT JOIN p ON p.site_id = s.site_id LEFT JOIN l ON l.site_id = s.site_id)"""


def _stat(s, d):
    site = read_table(s, d, "site")
    cfg = site.filter("site_id % 3 <> 0").groupBy("url").agg(F.min("name").alias("name")).unionByName(s.createDataFrame([("https://nowhere.test", "Nowhere")], "url string, name string"))
    return stats.site_statistics(cfg, site, read_table(s, d, "page"), read_table(s, d, "lemma"))


@query("q38_stats_detail", f"WITH {STAT} SELECT * FROM st")
def q38(s, d):
    return _stat(s, d)


@query("q39_stats_total", f"WITH {STAT} SELECT count(*) AS sites, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(lemmas) AS BIGINT) AS lemmas, bool_or(status = 'INDEXING') AS indexing FROM st")
def q39(s, d):
    return stats.total_statistics(_stat(s, d))


@query("q40_wipe", "SELECT * FROM page WHERE false")
def q40(s, d):
    return index.wipe(read_table(s, d, "page"))


@query("q41_search_json", P_TOP + " SELECT page_id, CAST(to_json({'site': site, 'siteName': \"siteName\", 'uri': uri, 'title': title, 'relevance': relevance}) AS VARCHAR) AS row FROM rows_")
def q41(s, d):
    """The JSON rows of a result page; null fields are left out."""
    rows = q29p(s, d)
    return rows.select("page_id", F.to_json(F.struct("site", "siteName", "uri", "title", "relevance")).alias("row"))


@query("q42_unique_pages", "SELECT site_id, path, min(page_id) AS page_id FROM page WHERE page_id IS NOT NULL GROUP BY site_id, path")
def q42(s, d):
    return index.unique_pages(read_table(s, d, "page").filter("page_id is not null").select("site_id", "path", "page_id"))


@query("q43_strict_and", f"WITH {RANKED} SELECT i.site_id, i.page_id, sum(CAST(i.rating AS DOUBLE)) AS abs_rank FROM tf i JOIN ranked r ON i.site_id = r.site_id AND i.lemma = r.lemma GROUP BY ALL HAVING count(*) = {len(DOC_TERMS)}")
def q43(s, d):
    i, r = _ranked(s, d)
    return search.candidates(i.postings, r, mode="strict_and")
