"""Pages that arrive as a stream are folded into the index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators.index import frequencies, indexable, term_counts
from quillon.schemas import PAGE
from quillon.sources.store import Store
from quillon.sources.tables import cut


def replace_pages(store: Store, state: dict, pages: DataFrame, postings: DataFrame, whole: dict[str, DataFrame] | None = None, marks: dict | None = None) -> dict:
    """The state after pages are put in place of those of the same id, with their postings. Only the buckets of these pages are read and
    written; the frequencies get the difference of the new and the old postings."""
    ids = pages.select("page_id").distinct()
    buckets = [r[0] for r in ids.select(store.bucket(F.col("page_id"))).distinct().collect()]  # at most BUCKETS
    old = store.read("search_index", buckets, state)
    minus = frequencies(old.join(ids, "page_id", "left_semi")).withColumn("frequency", -F.col("frequency"))
    new = cut(postings)
    delta = frequencies(new).unionByName(minus).groupBy("site_id", "lemma").agg(F.sum("frequency").alias("frequency")).filter("frequency <> 0")
    rest = {n: store.read(n, buckets, state).join(ids, "page_id", "left_anti") for n in ("search_index", "page")}
    return store.commit(
        state, whole=whole, append={"lemma": delta}, marks=marks,
        touched={"search_index": (rest["search_index"].unionByName(new.select(rest["search_index"].columns)), buckets), "page": (rest["page"].unionByName(pages.select(rest["page"].columns)), buckets)},
    )


def fold_batch(store: Store, batch: DataFrame, batch_id: int, stream: str = "pages", dict_: DataFrame | None = None) -> None:
    """Puts the batch's pages of code 200 in place. A batch that the store has taken in already changes nothing."""
    state = store.manifest()
    if state["marks"].get(stream, -1) >= batch_id:
        return
    pages = cut(indexable(batch.filter("page_id is not null")).dropDuplicates(["page_id"]))
    replace_pages(store, state, pages, term_counts(pages, F.col("content"), dict_), marks={stream: batch_id})


def ingest(store: Store, source_dir: str, checkpoint: str, stream: str = "pages", dict_: DataFrame | None = None) -> StreamingQuery:
    """A query that folds the page files of a folder into the store, each file once, until all present ones are done."""
    pages = store.spark.readStream.schema(PAGE).parquet(source_dir)
    return (
        pages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda df, k: fold_batch(store, df, k, stream, dict_))
        .start()
    )
