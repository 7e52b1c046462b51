"""What the operators of this subpackage share: reading tables, cutting lineage, even chunks of rows."""

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where none is named, a session on one machine takes a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="veinway-"))
    return sc.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """The same rows, stored in the shared folder: computed once, and not again when executors are lost."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Removes an intermediate folder from whatever store holds it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_KEPT: dict[tuple, Any] = {}


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """make(), once a Python worker, for what an operator remembers from one task to the next.

    A worker holds one such thing: when another operator asks for its own, the one before goes.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)  # what was freed goes back to the system
        gc.set_threshold(200_000, 50, 100)  # many long-lived objects, few cycles
        _KEPT[key] = make()
    return _KEPT[key]


def held_out(doc_id: Column | str) -> Column:
    """True for the fifth of documents whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 5 == 0, F.lit(False))


def numbered(df: DataFrame, by: str, order: list[Column], name: str, n_rows: int, chunk_rows: int = 4000) -> DataFrame:
    """Adds `name`: a gapless number from 0 within each value of the column `by`.

    Rows are dealt by a hash of the order columns into chunks of about `chunk_rows`, whatever
    their value of `by`; a value that holds most rows is thus numbered by many tasks. Only a count
    for each chunk and value is added up across tasks. Rows that tie in all order columns get
    different numbers.
    """
    chunks = max(1, -(-n_rows // chunk_rows))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy(by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_chunk", by).agg(F.count("*").alias("_n")).select(
        "_chunk", by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy("_chunk", by).orderBy(*order)
    return (
        dealt.repartition(F.col("_chunk"))
        .withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, ["_chunk", by])
        .withColumn(name, F.col("_start") + F.col("_rank"))
        .drop("_chunk", "_start", "_rank")
    )
