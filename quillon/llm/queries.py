"""The registered queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import main_body, near_duplicates, packing, repair, residue, site_lines, splitting, term_counts, tokens
from quillon.sources.tables import read_pages, read_table

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _repeated(s: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(read_pages(s, d))


@query("p1_found")
def p1_found(s, d):
    return _repeated(s, d).select(F.col("page").alias("page_id"), "line_no")


@query("p1_clean")
def p1_clean(s, d):
    return site_lines.without_lines(read_pages(s, d), _repeated(s, d))


def _model(s: SparkSession, d: str) -> repair.Model:
    """Words of the pages as delivered; a page delivered twice counts twice, which changes no decision."""
    return repair.build_model(read_table(s, d, "page"))


@query("p4_found")
def p4_found(s, d):
    model = _model(s, d)
    pages = repair.garbled(read_table(s, d, "page").filter("page_id is not null"), model, "page_id", "content").distinct()
    sites = repair.garbled(read_table(s, d, "site").filter("site_id is not null"), model, "site_id", "url").distinct()
    kinds = ((F.lit("page"), pages), (F.lit("site"), sites))
    a, b = (x.select(k.alias("record_kind"), F.col("key").cast("long").alias("record_id")) for k, x in kinds)
    return a.unionByName(b)


@query("p4_restored")
def p4_restored(s, d):
    """(page_id, content) of the garbled pages, restored as far as possible."""
    rows = repair.restore_rows(read_pages(s, d), _model(s, d), "page_id", "content")
    return rows.filter("garbled").select(F.col("key").alias("page_id"), F.col("restored").alias("content"))


@query("p6_found")
def p6_found(s, d):
    return residue.find_residue(read_table(s, d, "page").filter("page_id is not null"), _model(s, d)).select(F.col("page").alias("page_id")).distinct()


def _terms(s: SparkSession, d: str) -> DataFrame:
    return term_counts.term_frequencies(read_table(s, d, "lemma"), "lemma", "site_id", "frequency")


# white space beyond the blank is trimmed like Python's strip
_P5 = """WITH t AS (SELECT nfc_normalize(lower(trim(nfc_normalize(lemma), ' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　'))) AS lemma, site_id, frequency FROM lemma WHERE frequency > 0),
s AS (SELECT lemma, CAST(sum(frequency) AS BIGINT) AS occurrences, count(DISTINCT site_id) AS sites FROM t WHERE lemma <> '' GROUP BY lemma)"""


@query("p5_found", _P5 + ", n AS (SELECT count(DISTINCT page_id) AS n FROM page) SELECT lemma, 'rare' AS mark FROM s WHERE occurrences <= 2 UNION ALL SELECT lemma, 'common' FROM s, n WHERE occurrences >= 0.3 * n")
def p5_found(s, d):
    pages = read_table(s, d, "page").agg(F.countDistinct("page_id")).first()[0]
    # exact: 10 * total >= 3 * pages
    return term_counts.marks(_terms(s, d), F.lit(3 * pages) / 10).select(F.col("term").alias("lemma"), "mark")


@query("p5_terms", _P5 + " SELECT * FROM s")
def p5_terms(s, d):
    return _terms(s, d).select(F.col("term").alias("lemma"), "occurrences", F.col("records").alias("sites"))


CAPACITY = LIMIT = 2048
OVERLAP = 128


@query("p7_ids")
def p7_ids(s, d):
    return tokens.encode_texts(read_table(s, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query("p8_containers")
def p8_containers(s, d):
    sizes = tokens.token_sizes(read_table(s, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, CAPACITY).withColumnRenamed("key", "doc_id")


def _pieces(s: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(read_table(s, d, "documents"), "doc_id", "text", LIMIT, OVERLAP).withColumnRenamed("key", "doc_id")


@query("p9_found")
def p9_found(s, d):
    return _pieces(s, d).filter("piece = 0").select("doc_id")


@query("p9_pieces")
def p9_pieces(s, d):
    return _pieces(s, d)


def _groups(s: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_groups(read_pages(s, d), "page_id", "content", threshold=0.6, width=3, least_words=40)


@query("p3_found")
def p3_found(s, d):
    return near_duplicates.pairs_of_groups(_groups(s, d)).select(F.col("a").alias("page_id_a"), F.col("b").alias("page_id_b"))


@query("p3_groups")
def p3_groups(s, d):
    """(page_id, group_id): one row for each page that is similar to another."""
    return _groups(s, d).select(F.col("id").alias("page_id"), F.col("group").alias("group_id"))


@query("p2_found")
def p2_found(s, d):
    pages, sites = read_pages(s, d), read_table(s, d, "site")
    return main_body.main_body(pages, sites, _model(s, d)).withColumnRenamed("page", "page_id")
