"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

Groups of equal texts stay together. Groups are summed by Spark; those that are large against a
shard stand alone, the others are bundled by a hash of their digest. The number of units is thus
bounded by two parameters, whatever the input, and the differencing runs over units only.
"""

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import numbered, pinned


def differencing(sizes: list[int], k: int) -> list[int]:
    """Which of k shards each size belongs to.

    Every size starts as a partial partition (size, 0, ..., 0). The two partials with the largest
    spread are combined, the fullest part of one with the emptiest of the other, until one is left.
    """
    if not sizes:
        return []
    sums = {i: [s] + [0] * (k - 1) for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made: dict[int, tuple[int, int, list[int]]] = {}
    new = len(sizes)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        x, y = sums.pop(a), sums.pop(b)
        joined = [x[i] + y[k - 1 - i] for i in range(k)]
        order = sorted(range(k), key=lambda i: -joined[i])
        least = joined[order[-1]]
        sums[new] = [joined[i] - least for i in order]
        made[new] = (a, b, order)
        heapq.heappush(heap, (-sums[new][0], new))
        new += 1
    shard_of: dict[int, list[int]] = {heap[0][1]: list(range(k))}
    for node in range(new - 1, len(sizes) - 1, -1):
        a, b, order = made[node]
        slots = shard_of.pop(node)
        left, right = [0] * k, [0] * k
        for slot, i in enumerate(order):
            left[i] = right[k - 1 - i] = slots[slot]
        shard_of[a], shard_of[b] = left, right
    return [shard_of[i][0] for i in range(len(sizes))]


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, bundles: int = 16384, giants: int = 4096) -> DataFrame:
    """Deals rows into `n_shards` shards of nearly equal bytes; equal texts share a shard.

    A row's size is the UTF-8 bytes of its text plus 1. Returns doc_id, size, text_crc32, law,
    shard, slot (gapless from 0 within a shard) and grown_shard (always null for this law).
    Null texts form one group of their own, of size 1 a row and crc 0; empty texts another.
    Repeated rows, also with a repeated or null doc_id, are all returned, each with its own slot.
    An empty table gives an empty result; other columns of the input are not looked at.

    At most `giants` groups hold more than a `giants`-th of all bytes each; these are units of
    their own, all others fall into `bundles` units. A group of more bytes than a shard's share
    still stays whole, and the others make up for it as far as they can.
    """
    spark = docs.sparkSession
    rows = pinned(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode("text", "utf-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"null").cast("binary")).alias("digest"),
        )
    )
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    giant = F.col("bytes") > F.lit(total.bytes // giants)
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles)).cast("int")
    units = (
        groups.select(F.when(giant, F.col("digest")).alias("digest"), F.when(~giant, bundle).alias("bundle"), "bytes")
        .groupBy("digest", "bundle").agg(F.sum("bytes").alias("bytes"))
        .collect()
    )  # at most giants + bundles rows
    units.sort(key=lambda u: (-u.bytes, u.bundle if u.bundle is not None else -1, bytes(u.digest or b"")))
    placed = list(zip(units, differencing([u.bytes for u in units], n_shards), strict=True))
    alone = spark.createDataFrame([(u.digest, s) for u, s in placed if u.bundle is None], "digest binary, alone int")
    bundled = spark.createDataFrame([(u.bundle, s) for u, s in placed if u.bundle is not None], "bundle int, bundled int")
    dealt = (
        rows.withColumn("bundle", bundle)
        .join(F.broadcast(alone), "digest", "left")
        .join(F.broadcast(bundled), "bundle", "left")
        .withColumn("shard", F.coalesce("alone", "bundled"))
        .select("doc_id", "size", "text_crc32", "shard")
    )
    out = numbered(dealt, "shard", [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", total.n)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
