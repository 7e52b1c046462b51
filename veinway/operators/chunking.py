"""Greedy chunks in order: a row joins the open chunk unless the budget would be passed, whatever the key's size.

Greedy filling looks sequential, but what a block of rows does depends on one number alone: how full
the chunk is that comes in. Each block is turned into a table from that number to how full the last
chunk goes out and how many chunks began; most entries of it fall together. Going over these tables in
order gives each block its start, and then all blocks are filled at once. One long key is thus spread over many tasks.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinway.lineage import pinned

NOTHING = -1  # fill of a chunk that has not begun


def transition(sizes: np.ndarray, budget: int) -> tuple[list[int], list[int], list[int], int, int, int]:
    """(above, fills, begun, total, fresh fill, fresh begun) of a block.

    A chunk that comes in with more than above[k] (the largest such one) goes out as fills[k] after
    begun[k] new chunks; below all of them it takes in the whole block, whose size is total. The fresh ones are for nothing coming in.
    """
    n = len(sizes)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    after = np.maximum(np.searchsorted(upto[1:], upto[:-1] + budget, "right"), np.arange(n) + 1)  # where a chunk from i on is full
    fill, begun = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        j = int(after[i])
        fill[i], begun[i] = (int(upto[n] - upto[i]), 0) if j >= n else (fill[j], begun[j] + 1)
    above, fills, counts = [], [], []
    for i in range(n):
        if upto[i] > budget:
            break
        if i and sizes[i] == 0:
            continue
        low = int(budget - upto[i + 1])
        if fills and (fills[-1], counts[-1]) == (fill[i], begun[i] + 1):
            above[-1] = low
        else:
            above.append(low)
            fills.append(fill[i])
            counts.append(begun[i] + 1)
    return above, fills, counts, int(upto[n]), fill[0], begun[0]


def chunked(rows: DataFrame, key: str, order: list[str], size: Column, budget: int, block: int = 10_000, name: str = "chunk") -> DataFrame:
    """The rows with a chunk number from 0 within each key, in order, filled greedily up to the budget.

    A row that is larger than the budget has a chunk of its own. Sizes are whole numbers; null ones
    count as 0. Rows that tie in the order are taken in any order. `block` rows are planned
    together; one row of plan for each block is read in order, key by key.
    """
    if rows.isEmpty():
        return rows.withColumn(name, F.lit(0).cast("long"))
    held = rows.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), F.col(key).alias("key"), F.struct(*order).alias("at"), F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = pinned(held.repartitionByRange(parts, "key", "at").sortWithinPartitions("key", "at").withColumns({"part": F.spark_partition_id(), "n": F.monotonically_increasing_id()}))
    ordered = ordered.withColumn("block", F.floor(F.col("n") % (1 << 33) / block))  # of one partition, and cut where the key changes
    text = ordered.withColumn("k", F.to_json(F.struct("key")))

    def plans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []

        def out(frame: pd.DataFrame) -> pd.DataFrame:
            first = frame.iloc[0]
            made = transition(frame["size"].to_numpy(np.int64), budget)
            return pd.DataFrame([(first.k, first.part, first.block, first.n, *made)], columns=PLAN)

        for batch in batches:
            for _, piece in batch.groupby(["k", "part", "block"], sort=False):
                if waiting and tuple(waiting[0].iloc[0][["k", "part", "block"]]) != tuple(piece.iloc[0][["k", "part", "block"]]):
                    yield out(pd.concat(waiting))
                    waiting = []
                waiting.append(piece)
        if waiting:
            yield out(pd.concat(waiting))

    kinds = "k string, part int, block long, n long, above array<long>, fills array<long>, begun array<long>, total long, fresh long, fresh_begun long"
    plan = text.select("k", "part", "block", "n", "size").mapInPandas(plans, kinds)

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key_now, fill, chunk = None, NOTHING, 0
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.k != key_now:
                    key_now, fill, chunk = r.k, NOTHING, 0
                out.append((r.k, r.part, r.block, fill, chunk))
                if fill == NOTHING:
                    fill, chunk = r.fresh, chunk + r.fresh_begun
                else:
                    met = next((i for i, low in enumerate(r.above) if fill > low), None)
                    fill, chunk = (fill + r.total, chunk) if met is None else (r.fills[met], chunk + r.begun[met])
            yield pd.DataFrame(out, columns=["k", "part", "block", "fill", "first"])

    begun = pinned(plan.repartition("k").sortWithinPartitions("k", "n").mapInPandas(starts, "k string, part int, block long, fill long, first long"))

    def fill_block(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n")
        fill, chunk, out = int(frame["fill"].iloc[0]), int(frame["first"].iloc[0]), []
        for s in frame["size"].tolist():
            if fill != NOTHING and fill + s > budget:
                fill, chunk = s, chunk + 1
            else:
                fill = s if fill == NOTHING else fill + s
            out.append(chunk)
        return pd.DataFrame({"n": frame["n"], "chunk": out})

    numbered = text.select("k", "part", "block", "n", "size").join(begun, ["k", "part", "block"]).groupBy("k", "part", "block").applyInPandas(fill_block, "n long, chunk long")
    return ordered.select("n", "row").join(numbered, "n").select("row.*", F.col("chunk").alias(name))


PLAN = ["k", "part", "block", "n", "above", "fills", "begun", "total", "fresh", "fresh_begun"]


def commit_text(diff: Column, age_days: Column) -> Column:
    """What of a commit's diff is read: all of it for 180 days, 500 characters up to 540 days, then nothing. Null diffs count as empty."""
    return F.when(age_days < 180, F.coalesce(diff, F.lit(""))).when(age_days < 540, F.coalesce(F.left(diff, F.lit(500)), F.lit(""))).otherwise("")
