"""The engine's four tables below one folder, changed together.

A manifest names the folders that make up each table. A change writes new folders beside the old ones and then
a manifest of the next number under its final name, by one rename: readers see the old state or the new one, of all
tables, and a change that fails leaves nothing that is read. Of two changes at once one fails.

``page`` and ``search_index`` lie in ``BUCKETS`` buckets by page id, so a change rewrites the buckets of its pages and no others.
``lemma`` is a log: each change appends signed frequencies, which add up when the table is read, and ``compact`` folds the log. ``site``
is small and written whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.schemas import LEMMA, PAGE, SEARCH_INDEX, SITE

BUCKETS = 64
SCHEMAS = {"site": SITE, "page": PAGE, "search_index": SEARCH_INDEX, "lemma": LEMMA}
BY_PAGE = ("page", "search_index")


class Conflict(RuntimeError):
    """Another change was committed first."""


class Store:
    """Tables under ``root``; ``open_`` is cheap, each read looks for the newest manifest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(self.root)))
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest state: its number, the folders of each table by bucket, and marks of what was taken in."""
        numbers = self._numbers()
        if not numbers:
            return {"number": 0, "tables": {n: {} for n in SCHEMAS}, "marks": {}}
        stream = self._fs.open(self._path(f"{self.root}/manifest-{numbers[-1]:012d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, buckets: list[int] | None = None, state: dict | None = None) -> DataFrame:
        """A table, or some buckets of it. Frequencies of a lemma are summed, and lemmas without any left out."""
        folders = (state or self.manifest())["tables"][name]
        paths = sorted({p for b, own in folders.items() if buckets is None or b == "*" or int(b) in buckets for p in own})
        df = self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])
        if name == "lemma":
            df = df.groupBy("site_id", "lemma").agg(F.sum("frequency").alias("frequency")).filter("frequency > 0")
        return df

    def tables(self) -> dict[str, DataFrame]:
        """All tables of one state."""
        state = self.manifest()
        return {n: self.read(n, state=state) for n in SCHEMAS}

    @staticmethod
    def bucket(page_id):
        """The bucket of a page id column."""
        return F.pmod(F.xxhash64(page_id.cast("bigint")), F.lit(BUCKETS)).cast("int")

    def commit(self, state: dict, whole: dict[str, DataFrame] | None = None, touched: dict[str, tuple[DataFrame, list[int]]] | None = None, append: dict[str, DataFrame] | None = None, marks: dict | None = None) -> dict:
        """The state after a change of ``state``: tables written whole, buckets replaced (their new rows and numbers), rows appended."""
        tables = {n: {b: list(p) for b, p in own.items()} for n, own in state["tables"].items()}
        for name, df in (whole or {}).items():
            tables[name] = self._write(name, df)
        for name, (df, buckets) in (touched or {}).items():
            new = self._write(name, df)
            for b in buckets:
                tables[name].pop(str(b), None)
            tables[name] |= new
        for name, df in (append or {}).items():
            tables[name].setdefault("*", []).extend(self._write(name, df).get("*", []))
        after = {"number": state["number"] + 1, "tables": tables, "marks": {**state["marks"], **(marks or {})}}
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft), False)
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        at = self._path(f"{self.root}/manifest-{after['number']:012d}.json")
        if self._fs.exists(at) or not self._fs.rename(self._path(draft), at):
            self._fs.delete(self._path(draft), False)
            raise Conflict(f"state {after['number']} is there already")
        return after

    def _write(self, name: str, df: DataFrame) -> dict[str, list[str]]:
        at = f"{self.root}/{name}-{uuid.uuid4().hex}"
        df = df.select(*SCHEMAS[name].names)
        if name not in BY_PAGE:
            df.write.parquet(at)
            return {"*": [at]}
        df.withColumn("_bucket", self.bucket(F.col("page_id"))).repartition("_bucket").write.partitionBy("_bucket").parquet(at)
        names = (f.getPath().getName() for f in self._fs.listStatus(self._path(at)))
        return {n[8:]: [f"{at}/{n}"] for n in names if n.startswith("_bucket=")}

    def compact(self) -> dict:
        """The log of frequencies folded into one folder."""
        state = self.manifest()
        return self.commit(state, whole={"lemma": self.read("lemma", state=state)})

    def clean(self) -> None:
        """Deletes the folders and manifests that the newest state does not name. No reader may be at work on an older one."""
        state = self.manifest()
        kept = {p[len(self.root) + 1 :].split("/")[0] for own in state["tables"].values() for paths in own.values() for p in paths} | {f"manifest-{state['number']:012d}.json"}
        for f in self._fs.listStatus(self._path(self.root)):
            if f.getPath().getName() not in kept:
                self._fs.delete(f.getPath(), True)
