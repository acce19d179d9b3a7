import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quillon import schemas as S
from quillon.operators import crawl, index
from quillon.plans import api
from quillon.sources import config, fetch
from quillon.sources.store import Conflict, Store

PAGES = "site_id int, path string, code int, content string"
DICT = [("ru", "принтеры", "принтер", 0, "С"), ("ru", "принтером", "принтер", 0, "С"), ("ru", "старых", "старый", 0, "П"), ("ru", "и", "и", 0, "СОЮЗ")]
SETTINGS = config.from_mapping({"sites": [{"url": "http://a.test", "name": "A"}, {"url": "http://b.test", "name": "B"}], "search": {"default_limit": 5}})


def _page(title, body, *links):
    return f"<html><head><title>{title}</title></head><body><p>{body}</p>{''.join(f'<a href={chr(34)}{x}{chr(34)}>x</a>' for x in links)}</body></html>"


@pytest.fixture()
def indexer(spark, tmp_path):
    rows = [
        (1, "/", 200, _page("Root", "Старые принтеры и хлеб", "/a", "/gone", "/broken", "http://else.test/")),
        (1, "/a/", 200, _page("A", "Работа с принтером сегодня", "/")), (1, "/gone/", 404, "not here"), (1, "/broken/", 200, "x"), (1, "/hidden/", 200, "never linked"),
        (2, "/", 200, _page("B root", "хлеб и сыр", "/b")), (2, "/b/", 200, _page("B", "свежий хлеб")),
    ]
    web = crawl.stored_web(spark.createDataFrame(rows, PAGES))

    def answer(links):
        got = web(links)
        broken = F.col("path") == "/broken/"
        return got.withColumn("error", F.when(broken, F.lit("Internal error: ValueError"))).withColumn("code", F.when(~broken, F.col("code")))

    one = {"http://a.test/new/": (200, _page("New", "много старых принтеров принтером"), None), "http://a.test/slow/": (None, "", "timed out")}
    dictionary = spark.createDataFrame(DICT, "lang string, form string, normal_form string, form_rank int, info string")
    return api.Indexer(spark, str(tmp_path / "store"), SETTINGS, dictionary, answer, lambda link: one.get(link, (404, "", None)))


def _search(spark, indexer, query, **how):
    dictionary = spark.createDataFrame(DICT, "lang string, form string, normal_form string, form_rank int, info string")
    status, text = api.get_search(spark, indexer.tables() | {"lemma_dict": dictionary}, S.SearchRequest(query, **how), SETTINGS.search)
    return status, json.loads(text)


def test_crawl_index_and_search(spark, indexer):
    assert indexer.stop_indexing() == (400, json.dumps({"result": False, "error": S.MSG_NOT_INDEXING}, ensure_ascii=False))
    assert indexer.start_indexing() == (200, '{"result": true}')
    assert json.loads(indexer.start_indexing()[1])["error"] == S.MSG_ALREADY_INDEXING
    indexer.wait()
    tables = indexer.tables()
    assert {(r["site_id"], r["path"], r["code"], bool(r["content"])) for r in tables["page"].collect()} == {(1, "/", 200, True), (1, "/a/", 200, True), (1, "/gone/", 404, False), (2, "/", 200, True), (2, "/b/", 200, True)}
    assert {r["url"]: (r["status"], r["last_error"]) for r in tables["site"].collect()} == {"http://a.test": (S.FAILED, "Internal error: ValueError: http://a.test/broken/"), "http://b.test": (S.INDEXED, None)}
    status, got = _search(spark, indexer, "принтеры")  # both inflected forms are found by the dictionary's lemma
    assert status == 200 and got["count"] == 2 and {r["uri"] for r in got["data"]} == {"/", "/a/"}
    assert got["data"][0]["relevance"] == 1.0 and "<b>" in got["data"][0]["snippet"] and set(got["data"][0]) == {"site", "siteName", "uri", "title", "snippet", "relevance"}
    assert _search(spark, indexer, "хлеб", site="http://b.test")[1]["count"] == 2
    assert _search(spark, indexer, "хлеб", offset=3)[1] == {"result": True, "count": 3, "data": []}
    assert _search(spark, indexer, "")[0] == 400 and _search(spark, indexer, "и")[1]["count"] == 0
    status, text = api.get_statistics(spark, tables, config.sites_table(spark, SETTINGS))
    got = json.loads(text)["statistics"]
    assert status == 200 and got["total"]["sites"] == 2 and got["total"]["pages"] == 5 and not got["total"]["indexing"]
    assert [("error" in r, r["pages"]) for r in got["detailed"]] == [(True, 3), (False, 2)]


def test_one_page(spark, indexer):
    assert json.loads(indexer.index_page("http%3A%2F%2Fa.test%2Fnew")[1]) == {"result": True}
    assert _search(spark, indexer, "принтер")[1]["count"] == 1
    lemmas = {r["lemma"]: r["frequency"] for r in indexer.tables()["lemma"].collect()}
    assert lemmas["принтер"] == 1
    indexer.index_page("http://a.test/new/")
    assert {r["lemma"]: r["frequency"] for r in indexer.tables()["lemma"].collect()} == lemmas
    assert json.loads(indexer.index_page("http://else.test/x")[1])["error"] == S.MSG_OUTSIDE
    assert indexer.index_page("http://a.test/none")[0] == 400
    site = indexer.tables()["site"].first()
    assert (site["status"], site["last_error"]) == (S.FAILED, S.MSG_PAGE_REQUEST + "404 - http://a.test/none/")
    assert indexer.index_page("http://a.test/slow") == (500, json.dumps({"result": False, "error": S.MSG_FAIL_PAGE}, ensure_ascii=False))
    assert indexer.tables()["site"].first()["last_error"] == S.MSG_PAGE_PROCESS + " - http://a.test/slow/"
    assert _search(spark, indexer, "принтер")[1]["count"] == 1  # the page is still there


def test_stop(spark, indexer):
    web, gate = indexer.web, threading.Event()

    def slow(links):
        gate.wait(20)
        return web(links)

    indexer.web = slow
    indexer.start_indexing()
    stopper = threading.Thread(target=indexer.stop_indexing)
    stopper.start()
    while not indexer._stopped.is_set():
        time.sleep(0.05)
    gate.set()
    stopper.join()
    assert {(r["status"], r["last_error"]) for r in indexer.tables()["site"].collect()} == {(S.FAILED, S.MSG_STOPPED)}


def test_failures_answer_500(spark):
    assert json.loads(api.get_search(spark, {}, S.SearchRequest("x"))[1])["error"] == S.MSG_FAIL_SEARCH
    assert api.get_statistics(spark, {}, None)[0] == 500


def test_crawl_failure_marks_sites(spark, indexer):
    def web(links):
        raise OSError("no network")

    indexer.web = web
    indexer.start_indexing()
    indexer.wait()
    assert {(r["status"], r["last_error"]) for r in indexer.tables()["site"].collect()} == {(S.FAILED, S.MSG_INDEX_ERROR)}


def test_a_change_is_whole_or_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    lemma = lambda *rows: spark.createDataFrame(list(rows), S.LEMMA)
    first = store.commit(store.manifest(), append={"lemma": lemma((1, "a", 2), (1, "b", 1))})
    bad = lemma((1, "z", 9)).withColumn("frequency", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.commit(first, whole={"site": spark.createDataFrame([(1, "u", "n", "INDEXED", None, None)], S.SITE)}, append={"lemma": bad})
    assert store.manifest() == first and store.read("site").isEmpty()
    store.commit(first, append={"lemma": lemma((1, "b", -1))})
    with pytest.raises(Conflict):
        store.commit(first, append={"lemma": lemma((1, "c", 1))})
    assert {r["lemma"]: r["frequency"] for r in store.read("lemma").collect()} == {"a": 2}


def test_fetch(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/slow/":
                time.sleep(2)
            code = 200 if self.path != "/missing/" else 404
            body = f"{self.headers['User-Agent']} {self.headers.get('Referer')} день".encode("cp1251")
            self.send_response(code)
            self.send_header("Content-Type", "text/html; charset=windows-1251")
            self.end_headers()
            try:
                self.wfile.write(body)
            except OSError:
                pass

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    rows = [(1, p, root + p) for p in ("/", "/missing/", "/slow/")] + [(2, "/", "http://127.0.0.1:9/"), (3, "/", "nonsense")]
    links = spark.createDataFrame(rows, "site_id int, path string, link string")
    started = time.time()
    got = {(r["site_id"], r["path"]): (r["code"], r["content"], r["error"]) for r in fetch.fetch_pages(links, "agent", "http://from.test", delay=0.2, timeout=1).collect()}
    server.shutdown()
    assert time.time() - started > 0.6
    assert got[1, "/"] == (200, "agent http://from.test день", None) and got[1, "/missing/"] == (404, "", None)
    assert got[1, "/slow/"] == (None, "", "timed out")
    assert got[2, "/"] == (None, "", "Internal error: ConnectionRefusedError") and got[3, "/"] == (None, "", "Internal error: ValueError")


def test_modes_of_a_page_that_failed(spark):
    pages = spark.createDataFrame([(1, 200), (2, 404), (3, None)], "page_id long, code int")
    assert [r["page_id"] for r in index.indexable(pages).collect()] == [1]
    with pytest.raises(Exception, match=S.MSG_PAGE_REQUEST + "404"):
        index.indexable(pages.filter("page_id = 2"), "single").collect()


def test_config(tmp_path, spark):
    with pytest.raises(ValueError, match="twice"):
        config.from_mapping({"sites": [{"url": "u"}, {"url": "u"}]})
    assert [tuple(r) for r in config.sites_table(spark, SETTINGS).collect()] == [(0, "http://a.test", "A"), (1, "http://b.test", "B")]
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("sites:\n  - {url: 'http://x.test'}\nsearch: {default_limit: 7}\nuser_agent: me\n")
    got = config.from_yaml(str(tmp_path / "c.yaml"))
    assert got.search.default_limit == 7 and got.sites[0].name == "http://x.test" and got.user_agent == "me"
