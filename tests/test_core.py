import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import html as H
from quillon.functions import text as X
from quillon.functions import urls as U
from quillon.operators import access, crawl, index, search, stats
from quillon.operators.snippet import make_snippet
from quillon.schemas import MSG_EMPTY_QUERY, MSG_NO_SITES, SITE, SearchRequest, SearchSettings


@pytest.mark.parametrize("url, domain, rel", [
    ("https://a.com", "https://a.com", "/"), ("https://a.com/x/y", "https://a.com", "/x/y/"), ("https://a.com/x//y/z", "https://a.com/x//y", "/z/"),
    ("https://a.com?x=1", "https://a.com?x=1", "/"), ("http://r.com/?u=http://b.com/c", "http://r.com/?u=http://b.com", "/c/"), ("no-scheme/x", "", "no-scheme/x/"),
])
def test_links(spark, url, domain, rel):
    df = spark.createDataFrame([(url,)], "u string")
    row = df.select(U.domain_link(F.col("u")), U.relative_link(U.close_slash(F.col("u")))).first()
    assert tuple(row) == (domain, rel)


def test_link_acceptance(spark):
    cases = {"x/": True, "x.html/": True, "v1.2/y.html/": True, "v1.2/y/": False, "x.pdf/": False, "x?q=1/": False, "x#t/": False}
    links = [f"https://a.com/{k}" for k in cases] + ["http://a.com/x/", "https://www.a.com/x/", "https://a.com/"]
    df = spark.createDataFrame([(1, "https://a.com", x) for x in links], "page_id int, site_url string, link string")
    got = {r["link"] for r in U.accept_links(df, F.lit("https://a.com/me/"), "page_id").collect()}
    assert got == {f"https://a.com/{k}" for k, ok in cases.items() if ok}


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, MP3 don't Привет ЁЖ!",), ("réel",), ("",), (None,)], "t string")
    got = [tuple(r) for r in df.select(X.tokens(F.col("t"), "en"), X.tokens(F.col("t"), "ru")).collect()]
    assert got == [(["hello", "mp", "don", "t"], ["привет", "ёж"]), (["r", "el"], []), ([], []), (None, None)]


def test_particles_and_normal_forms(spark):
    raw = spark.createDataFrame([("ru", "и", "и", 0, "СОЮЗ"), ("ru", "часть", "часть", 0, "С жр"), ("ru", "стали", "стать", 0, "Г"), ("ru", "стали", "сталь", 1, "С"), ("ru", "стали", "сталь", 1, "С")], "lang string, form string, normal_form string, form_rank int, info string")
    words = spark.createDataFrame([("ru", w) for w in ("и", "часть", "стали", "небыло")], "lang string, word string")
    d = X.dictionary(raw)
    assert {r["lemma"] for r in X.index_lemmas(words, d).collect()} == {"часть", "стать", "небыло"}
    assert {tuple(r) for r in X.query_lemmas(words, d).collect()} == {("часть", "часть"), ("стали", "стать"), ("стали", "сталь"), ("небыло", "небыло")}


def _narrow(posts, order, freq, s):
    cur = None
    for k, lemma in enumerate(order, 1):
        new = set(posts[lemma]) if cur is None else cur & set(posts[lemma])
        if not new:
            return set()
        if k == 1:
            cur = set(sorted(new)[: s.page_start_count_limit])
            continue
        if len(new) == len(cur) or (k > s.lemmas_count_for_page_limit and freq[lemma] > s.page_count_limit):
            break
        cur = new
    return cur


def test_narrowing_equals_procedure(spark):
    r = random.Random(3)
    rows, want = [], {}
    s = SearchSettings(page_start_count_limit=5, lemmas_count_for_page_limit=2, page_count_limit=8)
    for site in range(40):
        posts = {x: r.sample(range(1, 15), r.randint(1, 12)) for x in "abcd"}
        freq = {x: len(p) for x, p in posts.items()}
        want[site] = _narrow(posts, sorted(posts, key=lambda x: (freq[x], x)), freq, s)
        rows += [(site, p, x, 1.0) for x, ps in posts.items() for p in ps]
    df = spark.createDataFrame(rows, "site_id int, page_id long, lemma string, rating float")
    ranked = search.ranked_lemmas(spark.createDataFrame([(x,) for x in "abcd"], "lemma string"), index.frequencies(df))
    got = {k: set() for k in want}
    for row in search.candidates(df, ranked, s).collect():
        got[row["site_id"]].add(row["page_id"])
    assert got == want


def test_early_stop_and_relevance(spark):
    posts = {"A": {1: 1, 2: 1}, "B": {1: 1, 2: 1, 3: 1}, "C": {1: 5, 3: 1, 4: 1, 5: 1}}
    df = spark.createDataFrame([(1, p, x, float(n)) for x, ps in posts.items() for p, n in ps.items()], "site_id int, page_id long, lemma string, rating float")
    ranked = search.ranked_lemmas(spark.createDataFrame([(x,) for x in posts], "lemma string"), index.frequencies(df))
    got = {r["page_id"]: r["relevance"] for r in search.relevance(search.candidates(df, ranked)).collect()}
    assert got == {1: 1.0, 2: pytest.approx(2 / 7)}
    assert {r["page_id"] for r in search.candidates(df, ranked, mode="strict_and").collect()} == {1}


def test_reindex(spark):
    old = spark.createDataFrame([(1, 1, "a", 1.0), (1, 1, "b", 1.0), (1, 2, "b", 1.0), (1, 2, "c", 1.0)], "site_id int, page_id long, lemma string, rating float")
    new = spark.createDataFrame([(1, 1, "c", 1.0), (1, 1, "d", 1.0)], old.schema)
    after = index.reindex_pages(index.Index(old, index.frequencies(old)), new)
    assert {r["lemma"]: r["frequency"] for r in after.frequencies.collect()} == {"b": 1, "c": 2, "d": 1}
    back = index.reindex_pages(after, old.filter("page_id = 1"))
    assert {tuple(r) for r in back.postings.collect()} == {tuple(r) for r in old.collect()}


@pytest.mark.parametrize("text, lemmas, want", [
    ("short cat text", {"cat"}, "<b>cat</b> text"), ("cat.", {"cat"}, "<b>cat</b>."), ("the cat", {"cat"}, ""), ("no match", {"cat"}, ""),
    ("cat and dog here", {"cat", "dog"}, "<b>cat</b> and <b>dog</b> here...<b>dog</b>"), ("", {"cat"}, ""), (None, {"cat"}, ""),
])
def test_snippets(text, lemmas, want):
    assert make_snippet(text, lemmas) == want


def test_html(spark):
    page = "<html><head><title> A &amp;  B </title><style>x</style></head><body><p>foo<b>bar</b></p><script>var a='</p>1'</script>&copy; one</body></html>"
    df = spark.createDataFrame([(page,)], "c string")
    row = df.select(H.title(F.col("c")), H.description(F.col("c")), H.display_text(F.col("c"))).first()
    assert tuple(row) == ("A & B", "", "foobar © one")


def test_statistics(spark):
    site = spark.createDataFrame([(1, "u1", "n", "INDEXING", None, None), (9, "u1", "again", "FAILED", None, None), (3, "u3", "n", "INDEXED", None, None)], SITE)
    cfg = spark.createDataFrame([("u1", "one"), ("u2", "two")], "url string, name string")
    page = spark.createDataFrame([(1,)] * 3 + [(3,)], "site_id int")
    lemma = spark.createDataFrame([(1,)] * 2 + [(3,)], "site_id int")
    d = stats.site_statistics(cfg, site, page, lemma)
    assert {r["url"]: (r["status"], r["pages"], r["lemmas"], r["statusTime"]) for r in d.collect()} == {"u1": ("INDEXING", 3, 2, 0), "u2": ("", 0, 0, 0)}
    assert tuple(stats.total_statistics(d).first()) == (2, 3, 2, True)


def test_crawl_ends_on_cycles(spark):
    links = spark.createDataFrame([(1, "/", "/a/"), (1, "/a/", "/b/"), (1, "/b/", "/"), (1, "/x/", "/y/")], "site_id int, path string, to_path string")
    got = {(r["path"], r["level"]) for r in crawl.reachable(spark.createDataFrame([(1, "/")], "site_id int, path string"), links).collect()}
    assert got == {("/", 0), ("/a/", 1), ("/b/", 2)}


def test_deep_crawl(spark, monkeypatch):
    monkeypatch.setattr(crawl, "FOLD", 3)
    rows = [(1, "/" if not k else f"/p{k}/", 200, f'<a href="/p{k + 1}">next</a> <a href="/">home</a>') for k in range(7)]
    site = spark.createDataFrame([(1, "http://a.test")], "site_id int, url string")
    web = crawl.stored_web(spark.createDataFrame(rows, "site_id int, path string, code int, content string"))
    pages, errors = crawl.crawl_sites(site, web)
    assert {(r["path"], r["code"]) for r in pages.collect()} == {("/" if not k else f"/p{k}/", 200 if k < 7 else 404) for k in range(8)}
    assert errors.isEmpty() and pages.select("page_id").distinct().count() == 8
    links = spark.createDataFrame([(1, f"/{k}", f"/{k + 1}") for k in range(8)], "site_id int, path string, to_path string")
    got = crawl.reachable(spark.createDataFrame([(1, "/0")], "site_id int, path string"), links)
    assert {(r["path"], r["level"]) for r in got.collect()} == {(f"/{k}", k) for k in range(9)}


def test_requests(spark):
    site = spark.createDataFrame([(1, "u1", "n", "INDEXING", None, None), (2, "u2", "n", "FAILED", None, None)], SITE)
    for req, message in ((SearchRequest(""), MSG_EMPTY_QUERY), (SearchRequest("x", site="u1"), MSG_NO_SITES), (SearchRequest("x", site="?"), MSG_NO_SITES)):
        with pytest.raises(search.RequestError, match=message):
            search.check_request(req, site, SearchSettings())
    sites, limit = search.check_request(SearchRequest("x", site="u2"), site, SearchSettings())
    assert limit == 20 and [r["site_id"] for r in sites.collect()] == [2]
    stopped = {r["site_id"]: r["status"] for r in access.stop_indexing_sites(site, F.expr("localtimestamp()")).collect()}
    assert stopped == {1: "FAILED", 2: "FAILED"}


def test_streaming_ingest(spark, tmp_path):
    from quillon.sources.store import Store
    from quillon.streaming.ingest import fold_batch, ingest

    columns = "page_id long, site_id int, path string, code int, content string"
    store = Store(spark, str(tmp_path / "store"))
    rows = [(1, 1, "/", 200, "<p>red cat</p>"), (2, 1, "/b", 200, "red dog"), (3, 1, "/c", 404, ""), (None, 1, "/d", 200, "red"), (4, 1, "/e", None, "red")]
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest(store, str(tmp_path / "in"), str(tmp_path / "c")).awaitTermination()
    assert {r["lemma"]: r["frequency"] for r in store.read("lemma").collect()} == {"red": 2, "cat": 1, "dog": 1}
    spark.createDataFrame([(2, 1, "/b", 200, "blue dog")], columns).write.mode("append").parquet(str(tmp_path / "in"))
    ingest(store, str(tmp_path / "in"), str(tmp_path / "c")).awaitTermination()
    want = {"red": 1, "cat": 1, "dog": 1, "blue": 1}
    assert {r["lemma"]: r["frequency"] for r in store.read("lemma").collect()} == want
    number = store.manifest()["number"]
    fold_batch(store, spark.createDataFrame(rows, columns), 0)  # taken in before
    assert store.manifest()["number"] == number
    store.compact()
    store.clean()
    assert {r["lemma"]: r["frequency"] for r in store.read("lemma").collect()} == want
    assert {(r["page_id"], r["content"]) for r in store.read("page").collect()} == {(1, "<p>red cat</p>"), (2, "blue dog")}
