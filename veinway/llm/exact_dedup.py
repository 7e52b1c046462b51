"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary (Spark's freqItems, a fixed number of counters merged over partitions) names
every digest that may be frequent. Those are counted exactly, and the ones that are frequent are
resolved where their rows lie, against a broadcast table of at most 1/support rows. All other
digests have at most support * n rows each, so an ordinary shuffle deals them evenly.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.llm.common import pinned

#: White space that counts as one space when texts are compared.
SPACES = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, support: float = 0.001) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space becomes one space; a null text
    counts as empty. Of equal texts the smallest doc_id stays; a null doc_id only if all are null.
    Exactly one row of a group is kept: among rows that repeat the smallest doc_id, the first in
    the order in which they were read. An empty table gives an empty result.
    """
    rows, rest, winners = split_by_weight(docs, support)
    hot = rows.join(F.broadcast(winners), "text_sha256")
    w = Window.partitionBy("text_sha256")
    cold = rest.withColumn("group_size", F.count("*").over(w)).withColumn("best", F.min(_rank()).over(w))
    columns = [
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("tag") == F.col("best.tag")).alias("kept"), "text_sha256",
    ]
    return hot.select(*columns).unionAll(cold.select(*columns))


def deduplicated(docs: DataFrame, support: float = 0.001) -> DataFrame:
    """The documents without exact copies, in their own columns: of equal texts the row with the smallest doc_id.

    Rows that repeat doc_id and text leave one row; which of them is decided by a hash of the other columns.
    """
    _, _, winners = split_by_weight(docs, support)
    full = docs.select(F.struct("*").alias("row"), "doc_id", _digest().alias("sha"), F.xxhash64(*[c for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]).alias("tie"))
    won = winners.select(F.col("text_sha256").alias("sha"), F.col("best.doc_id").alias("best"))
    order = Window.partitionBy("sha").orderBy(F.col("doc_id").asc_nulls_last(), "tie")
    hot = full.join(F.broadcast(won), "sha").filter(F.col("doc_id").eqNullSafe(F.col("best"))).drop("best")
    cold = full.join(F.broadcast(won), "sha", "left_anti")
    first = hot.unionByName(cold).withColumn("at", F.row_number().over(order)).filter("at = 1")
    return first.select("row.*")


def _digest():
    return F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " "), 256)


def _rank():
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")


def split_by_weight(docs: DataFrame, support: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all rows with digest and tag, rows of digests that are not frequent, the frequent digests)."""
    rows = pinned(docs.select("doc_id", _digest().alias("text_sha256"), F.monotonically_increasing_id().alias("tag")))
    n = rows.count()
    found = rows.stat.freqItems(["text_sha256"], support)
    candidates = found.select(F.explode("text_sha256_freqItems").alias("text_sha256")).distinct()
    winners = pinned(
        rows.join(F.broadcast(candidates), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.count("*").alias("group_size"), F.min(_rank()).alias("best"))
        .filter(F.col("group_size") > F.lit(support * n))
    )  # fewer than 1 / support rows
    rest = rows.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    return rows, rest, winners
