"""Every operator over nulls, empty and long texts, repeated rows, ties, empty tables and columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from quillon.llm import main_body, near_duplicates, packing, repair, residue, site_lines, splitting, term_counts, tokens

LONG = "Старый принтер хранит хлеб возле моста. " * 1000
ROWS = [
    (1, 1, LONG), (2, 1, LONG), (2, 1, LONG), (3, 1, None), (4, 1, ""), (5, 1, " \n\t\n "), (6, None, "no site at all"), (None, 1, "no id"), (7, 2, "x" * 100_000),
    (8, 2, "<<<>>> &&& &#xFFFFFFFF; <a href=\"unclosed\n</p></div></html>"), (9, 2, "\x00퟿​￾ �"), (10, 2, "<p>Lorem ipsum dolor sit amet</p>"), (11, 3, "one\r\ntwo\rthree"),
]
CLASH = ("key", "id", "page", "source", "text", "node", "label", "size", "group", "_p", "_n", "_s", "_k", "h", "n", "piece")


def _pages(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, site_id int, content string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def model():
    return repair.Model({w: 50 for w in ("старый", "принтер", "хранит", "хлеб", "возле", "моста")})


@pytest.fixture(scope="module", params=["odd", "empty"])
def pages(spark, request):
    return _pages(spark, ROWS if request.param == "odd" else [])


def _all(df):
    return {tuple(r) for r in df.collect()}


def test_lines(spark, pages):
    got = _all(site_lines.repeated_lines(pages.dropDuplicates(["page_id"])))
    assert got == set()
    clean = {r[0]: r[1] for r in site_lines.without_lines(pages.dropDuplicates(["page_id"]), spark.createDataFrame([(11, 1)], "page long, line_no int")).collect()}
    if clean:
        assert clean[11] == "one\r" and clean[3] is None and clean[4] == "" and clean[5] == " \n\t\n " and clean[1] == LONG and None not in clean


def test_bodies(spark, pages, model):
    sites = spark.createDataFrame([(1, None), (1, "Brand"), (None, "x"), (2, "")], "site_id int, name string")
    got = _all(main_body.main_body(pages, sites, model))
    assert {k for k, _ in got} <= {1, 2, 6, 7, 8, 9, 11} and not any(n < 0 for _, n in got)


def test_near_duplicates(pages):
    one = pages.dropDuplicates(["page_id"])
    got = {(r["id"], r["group"]) for r in near_duplicates.similar_groups(one, "page_id", "content").collect()}
    assert got == ({(1, 1), (2, 1)} if not one.isEmpty() else set())


def test_repair(pages, model):
    got = {r["key"]: (r["garbled"], r["text"] == r["restored"]) for r in repair.restore_rows(pages.filter("page_id is not null"), model, "page_id", "content").collect()}
    if got:
        assert got[9][0] and got[1] == (False, True) and got[4] == (False, True) and 3 not in got
    assert repair.build_model(pages).count("нет") == 0


def test_terms(pages):
    got = {r[0]: (r[1], r[2]) for r in term_counts.term_frequencies(pages, "content", "site_id").collect()}
    if got:
        assert got[LONG.strip().lower()] == (3, 1) and got["no site at all"] == (1, 0) and "" not in got


def test_residue(pages, model):
    got = {r["page"] for r in residue.find_residue(pages, model).collect()}
    assert got == ({10} if not pages.isEmpty() else set())


def test_tokens_containers_and_pieces(pages):
    pytest.importorskip("public_tokenizers")
    ids = [(r["key"], r["ids"]) for r in tokens.encode_texts(pages, "page_id", "content").collect()]
    assert len(ids) == pages.count() and all(x == [] for k, x in ids if k in (3, 4))
    sizes = tokens.token_sizes(pages, "page_id", "content").filter("key is not null").withColumn("size", F.lit("clash"))
    load, per = {}, {}
    for k, _, _, n, box in packing.pack(sizes.select("key", "tokens", "size"), 2048).collect():
        load[box] = load.get(box, 0) + n
        per[k] = per.get(k, 0) + n
    want = {}
    for k, n in sizes.select("key", "tokens").collect():
        want[k] = want.get(k, 0) + n
    assert per == want and max(load.values(), default=0) <= 2048
    pieces = splitting.split_oversized(pages, "page_id", "content").collect()
    assert {r["key"] for r in pieces} == ({1, 2, 7} if ids else set()) and all(r["tokens"] <= 2048 for r in pieces)
