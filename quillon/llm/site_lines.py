"""Lines repeated excessively within one source's pages.

A line is known by the letters of its visible text, lower-cased. Its page count within the source is set
against its uses outside by a log-likelihood ratio (G2, one-sided): each other source that holds the line uses it
once, however often it repeats it, so a notice that many sources repeat is in excess on each of them, while a
phrase that many sources use now and then is not. All lines on two pages or more of their source are tested, and the
Benjamini-Hochberg procedure picks those in significant excess. An exact floor of pages and of the share of the
source's pages follows.

Scale: a page gives one row for each of its lines; rows are counted map-side before the shuffle on
(source, line), so a source or a line that holds a third of all rows is spread. The p-values are cut at a
threshold found from a histogram of G2 of fixed size; nothing that grows reaches the driver.

Defined results: a null content has no lines; rows without a page or a source id are left out; repeated
deliveries of a page count once; empty lines and lines without letters are never excess; where no page
lies outside (one source), nothing can be compared, and every line is in excess that the floors allow.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.visible import visible
from quillon.sources.tables import cut, if_small

NOT_LETTER = re.compile(r"[\W\d_]+")
#: G2 is binned for the threshold: bins of 1/STEP up to TOP.
STEP, TOP = 100, 200


def line_key(text: str) -> str:
    """The letters of a text, lower-cased."""
    key = NOT_LETTER.sub("", text.lower())
    return key if key.isalpha() else "".join(c for c in key if c.isalpha())


def page_lines(pages: DataFrame, source: str = "site_id", page: str = "page_id", content: str = "content") -> DataFrame:
    """Rows (source, page, key, line_no, first) of the lines that hold letters. first: the key's first line of the page."""
    kind = pages.select(F.col(source).alias("source"), F.col(page).alias("page"), F.col(content).alias("content")).filter("source is not null and page is not null and content is not null")

    def split(batches):
        for b in batches:
            at, keys, nos, first = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                seen = set()
                for n, line in enumerate(visible(text).split("\n")):
                    if line and (k := line_key(line)):
                        h = xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass"))
                        at.append(i)
                        keys.append(h)
                        nos.append(n)
                        first.append(h not in seen)
                        seen.add(h)
            take = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(keys, pa.binary()), pa.array(nos, pa.int32()), pa.array(first, pa.bool_())], ["source", "page", "key", "line_no", "first"])

    s, p = kind.schema["source"].dataType.simpleString(), kind.schema["page"].dataType.simpleString()
    return kind.mapInArrow(split, f"source {s}, page {p}, key binary, line_no int, first boolean")


def _g2(a: Column, n: Column, b: Column, m: Column) -> Column:
    """One-sided log-likelihood ratio of a of n against b of m; 0 where there is no excess."""
    rate = (a + b) / (n + m)

    def part(x: Column, e: Column) -> Column:
        return F.when((x > 0) & (e > 0), x * F.log(x / e)).otherwise(0.0)

    g = 2 * (part(a, n * rate) + part(n - a, n * (1 - rate)) + part(b, m * rate) + part(m - b, m * (1 - rate)))
    return F.when(m <= 0, F.lit(float(TOP))).when(a * m > b * n, F.greatest(g, F.lit(0.0))).otherwise(0.0)


def fdr_threshold(bins: list[tuple[int, int]], q: float) -> float:
    """The least G2 that Benjamini-Hochberg at level q rejects, from (bin, hypotheses) rows; infinite if none."""
    total, above, best = sum(n for _, n in bins), 0, math.inf
    for k, n in sorted(bins, reverse=True):
        above += n
        if 0.5 * math.erfc(math.sqrt(k / STEP / 2)) <= q * above / total:
            best = k / STEP
    return best


def tested_lines(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(source, key, a, n, g2) of the lines on at least two pages of their source. sizes: (source, n), the pages of each source."""
    sizes = sizes.select("source", F.col("n").cast("double").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("all_pages"))
    counts = lines.groupBy("source", "key").agg(F.sum(F.col("first").cast("int")).cast("double").alias("a"))
    counts = counts.join(if_small(sizes), "source")  # before the two uses of the counts, so that they share one shuffle
    uses = counts.groupBy("key").agg(F.count("*").cast("double").alias("sources"), F.max("a").alias("most")).filter("most >= 2")
    tests = counts.filter("a >= 2").join(uses, "key").join(F.broadcast(total), F.lit(True))
    return tests.select("source", "key", "a", "n", _g2(F.col("a"), F.col("n"), F.col("sources") - 1, F.col("all_pages") - F.col("n")).alias("g2"))


def excess_lines(lines: DataFrame, sizes: DataFrame, min_pages: int = 4, min_share: float = 0.05, q: float = 0.05) -> DataFrame:
    """(source, key, pages, share, g2) of the lines in significant excess at the false discovery rate ``q`` and above the floors."""
    tests = cut(tested_lines(lines, sizes))
    bins = tests.groupBy(F.least(F.floor(F.col("g2") * STEP), F.lit(TOP * STEP)).cast("int").alias("k")).count()
    least = fdr_threshold([tuple(r) for r in bins.collect()], q)  # at most TOP * STEP + 1 rows
    excess = tests.filter(F.col("g2") >= F.lit(least))
    return excess.filter((F.col("a") >= min_pages) & (F.col("a") >= min_share * F.col("n"))).select("source", "key", F.col("a").cast("long").alias("pages"), (F.col("a") / F.col("n")).alias("share"), "g2")


def repeated_lines(pages: DataFrame, source: str = "site_id", page: str = "page_id", content: str = "content", **how) -> DataFrame:
    """(page, line_no) of all occurrences of lines in excess; options as of ``excess_lines``."""
    sizes = cut(pages.filter(F.col(source).isNotNull() & F.col(page).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n")))
    lines = cut(page_lines(pages, source, page, content))
    found = excess_lines(lines, sizes, **how).select("source", "key")
    return lines.join(found, ["source", "key"], "left_semi").select("page", "line_no")


def without_lines(pages: DataFrame, drop: DataFrame, page: str = "page_id", content: str = "content") -> DataFrame:
    """(page, content) with the lines (page, line_no) left out: an anti-join, and the rest put together by position.

    A page whose lines all go has an empty content, a null content stays null. One row for each page id; rows without one are left out."""
    rows = pages.filter(F.col(page).isNotNull()).select(F.col(page).alias("_p"), F.col(content).alias("_c"))
    lines = rows.select("_p", F.posexplode(F.split("_c", "\n", -1)).alias("_n", "_line"))
    kept = lines.join(drop.select(F.col("page").alias("_p"), F.col("line_no").alias("_n")).distinct(), ["_p", "_n"], "left_anti")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_line"))), lambda x: x["_line"]), "\n")
    ends = rows.select("_p", F.when(F.col("_c").isNotNull(), F.lit(-1)).alias("_n"), F.lit(None).cast("string").alias("_line"))  # keeps pages without lines
    whole = kept.unionByName(ends).groupBy("_p").agg(F.max("_n").isNotNull().alias("_some"), text.alias("_text"))
    return whole.select(F.col("_p").alias(page), F.when(F.col("_some"), F.col("_text")).alias(content))
