"""Bounded breadth-first traversal from many seeds at once, a join per level."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinway.lineage import pinned
from veinway.operators.upserts import swapped


def live(edges: DataFrame, as_of: Column, least_confidence: float, days: int) -> DataFrame:
    """Edges that are confident enough and seen recently enough to be followed."""
    return edges.filter((F.col("confidence") >= least_confidence) & (F.col("last_seen") > as_of - F.expr(f"INTERVAL {int(days)} DAYS")))


#: Up to so many ids or edges are sent to every task; more are shuffled.
FEW = 100_000


def few_values(rows: DataFrame, column: str, most: int = FEW) -> DataFrame | None:
    """The distinct values of a column, stored, where there are no more than `most`; None where a sketch, which shuffles nothing, or a count says that there are."""
    if rows.agg(F.approx_count_distinct(column)).first()[0] > most:
        return None
    found = pinned(rows.select(column).distinct())
    return found if found.count() <= most else None


#: The sieve of ids: so many bits (16 MB), two for each id. It is of use up to MOST_SIEVED ids, where it lets about 15 % of the others through.
SIEVE_BITS, MOST_SIEVED = 27, 1 << 25


def _slots(value: Column) -> list[Column]:
    h = F.xxhash64(value)
    return [F.shiftrightunsigned(h, 64 - SIEVE_BITS), h.bitwiseAND((1 << SIEVE_BITS) - 1)]


def _bit(slot: Column) -> Column:
    return slot.bitwiseAND(63).cast("int")


def sieve(rows: DataFrame, column: str) -> DataFrame:
    """One row, _sieve: the bits of all values of the column, by words of 64."""
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("slot")))).alias("bits")
    found = rows.select(F.explode(F.array(*_slots(F.col(column)))).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(bits).toArrow()
    words = np.zeros(1 << SIEVE_BITS - 6, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return rows.sparkSession.createDataFrame(pa.table({"_sieve": pa.array([words], pa.list_(pa.int64()))}))


def among(ids: DataFrame, few: int = FEW) -> tuple[Callable[[DataFrame, str], DataFrame], bool]:
    """keep(rows, column) gives the rows whose column is among the ids (one column, stored) without shuffling rows; and whether it gives no others.

    Ids up to `few` are sent to every task, of more the sieve is, which lets some others through; of more than
    MOST_SIEVED ids all rows are given.
    """
    name = ids.columns[0]
    known = ids if ids.count() <= few else few_values(ids, name, few)
    if known is not None:
        return lambda rows, column: rows.join(F.broadcast(known.withColumnRenamed(name, column)), column, "left_semi").select(*rows.columns), True
    if ids.agg(F.approx_count_distinct(name)).first()[0] > MOST_SIEVED:
        return lambda rows, column: rows, False
    bits = sieve(ids, name)

    def keep(rows: DataFrame, column: str) -> DataFrame:
        held = [F.getbit(F.get("_sieve", F.shiftright(s, 6).cast("int")), _bit(s)) == 1 for s in _slots(F.col(column))]
        return rows.crossJoin(F.broadcast(bits)).filter(held[0] & held[1]).select(*rows.columns)

    return keep, False


def walk(edges: DataFrame, seeds: DataFrame, max_depth: int, few: int = FEW, store: bool = True) -> DataFrame:
    """(seed, node, depth, via, confidence) for all nodes within max_depth of each seed, the seed itself excluded.

    depth is the least number of edges; via and confidence are the least edge type and the largest
    confidence among the edges that reach the node at that depth. Each level joins the frontier to
    the edges and takes off what was visited, so that no node is expanded twice for a seed. The first
    level needs one shuffle, as its nodes are the seeds. Only edges that may leave the frontier are shuffled to it,
    and they are sent to it if they are few; where a level reaches few nodes, only visits of those are compared.
    Edges are read at every level; `store` tells that they are dear to work out, so that is done once. Edges may repeat.
    """
    steps = edges.select("src", "dst", "etype", "confidence")
    steps = pinned(steps) if store else steps
    best = F.min("etype").alias("via"), F.max("confidence").alias("confidence")
    frontier = starts = pinned(seeds.select("seed").distinct()).withColumn("node", F.col("seed"))
    levels: list[DataFrame] = []
    for depth in range(1, max_depth + 1):
        if not levels:
            keep, _ = among(starts.select("seed"), few)
            first = keep(steps.filter("NOT dst <=> src"), "src").join(starts.select(F.col("seed").alias("src")), "src", "left_semi").groupBy("src", "dst").agg(*best)
            level = pinned(first.select(F.col("src").alias("seed"), F.col("dst").alias("node"), "via", "confidence", F.lit(depth).alias("depth")))
        else:
            keep, exact = among(frontier.select("node"), few)
            near = keep(steps, "src")
            if exact:
                near = pinned(near)
                near = F.broadcast(near) if near.count() <= few else near
            reached = frontier.join(near, F.col("node") == F.col("src")).groupBy("seed", "dst").agg(*best).withColumnRenamed("dst", "node")
            reached = pinned(reached.select("seed", "node", "via", "confidence", F.lit(depth).alias("depth")))
            if reached.isEmpty():
                break
            visited, at = starts, few_values(reached, "node", few)
            for each in levels:
                visited = visited.unionAll(each.select("seed", "node"))
            if at is not None:
                visited = pinned(visited.join(F.broadcast(at), "node", "left_semi").select("seed", "node"))
            level = reached if at is not None and visited.isEmpty() else pinned(reached.join(visited, ["seed", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        frontier = level.select("seed", "node")
    if not levels:
        return frontier.limit(0).select("seed", "node", F.lit(0).alias("depth"), F.lit("").alias("via"), F.lit(0.0).alias("confidence"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out.select("seed", "node", "depth", "via", "confidence")


def both_ways(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Forward and reverse walks that never mix; a node that both reach keeps the lesser depth, forward first."""
    back = swapped(edges)
    found = walk(edges, seeds, max_depth).withColumn("direction", F.lit("forward")).unionByName(
        walk(back, seeds, max_depth).withColumn("direction", F.lit("reverse"))
    )
    best = F.min(F.struct("depth", "direction", "via", "confidence")).alias("best")
    return found.groupBy("seed", "node").agg(best).select("seed", "node", "best.*")


def undirected(edges: DataFrame) -> DataFrame:
    return edges.unionByName(swapped(edges))
