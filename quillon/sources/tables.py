"""Reading and writing the engine's tables.

Pages may be delivered more than once. ``read_pages`` drops the repeats without moving any page's
content: the repeats are found on the id column alone, by file and row position, and are then
anti-joined from the scan.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The most repeated deliveries that are broadcast; beyond it the anti-join shuffles.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, as it lies there."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_deliveries(df: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each key of a file-backed DataFrame: the first by file and position.

    Rows without a key are dropped. Only the key column is shuffled, and the positions of the repeats are broadcast if they are few; if
    not, the rows are shuffled once by position. A DataFrame without files (as in tests) falls back to ``dropDuplicates``.
    """
    try:
        placed = df.select(key, F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
        placed.schema  # noqa: B018  resolves the hidden columns
    except AnalysisException:
        return df.filter(F.col(key).isNotNull()).dropDuplicates([key])
    at = F.struct("_f", "_r")
    keep = placed.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min(at).alias("_at"))
    extra = (
        placed.join(keep.filter("_n > 1"), key)
        .filter(at != F.col("_at"))
        .select(F.col("_f").alias("_xf"), F.col("_r").alias("_xr"))
    )
    few = extra.limit(broadcast_rows + 1).count() <= broadcast_rows
    body = df.filter(F.col(key).isNotNull()).select("*", F.col("_metadata.file_path").alias("_f"), F.col("_metadata.row_index").alias("_r"))
    x = F.broadcast(extra) if few else extra
    return body.join(x, (F.col("_r") == F.col("_xr")) & (F.col("_f") == F.col("_xf")), "left_anti").drop("_f", "_r")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page table, each page once."""
    return first_deliveries(read_table(spark, sf_dir, "page"), "page_id")


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The DataFrame with a broadcast hint if it has no more rows than that; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where it is unset, a folder of our own
    in local mode; on a cluster an error, as no machine's own folder can be read by the others."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _clean(spark: SparkSession, root: str) -> None:
    if spark.sparkContext._jsc is not None:
        _delete(spark, root)


_ROOTS: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read again: lineage ends there. All such tables of an
    application lie in one folder, which goes when the driver's process ends; ``uncut`` drops one before that."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_clean, spark, root)
    at = f"{root}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._cut_path = at
    return out


def uncut(*tables: DataFrame | None) -> None:
    """Deletes tables that ``cut`` wrote, where nothing reads them any more."""
    for df in tables:
        if df is not None and getattr(df, "_cut_path", None):
            _delete(df.sparkSession, df._cut_path)
