"""Lookups over nodes, edges, items and logs: filtered pages, neighbours with their attributes, typed paths."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.operators.frontier import walk
from veinway.operators.upserts import swapped

# Edge types whose change breaks what depends on them.
BREAKING = ["IMPLEMENTS_CONTRACT", "HANDLES_ROUTE", "CALLS"]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of rows in an order that has no ties, with `total`: the number of rows on all pages."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def items_where(items: DataFrame, state: str | None = None, severity: str | None = None, domain: str | None = None) -> DataFrame:
    """Items of a state, a severity and with a domain among theirs; what is None is not looked at."""
    tests = [F.col("state") == state if state else None, F.col("severity") == severity if severity else None, F.array_contains("domains", domain) if domain else None]
    for test in tests:
        items = items if test is None else items.filter(test)
    return items


def entries_where(log: DataFrame, at: str, since: Column | None = None, until: Column | None = None, **equal: object) -> DataFrame:
    """Log entries from `since` to `until`, both included, whose columns have the values given."""
    log = log if since is None else log.filter(F.col(at) >= since)
    log = log if until is None else log.filter(F.col(at) <= until)
    for column, value in equal.items():
        log = log if value is None else log.filter(F.col(column) == F.lit(value))
    return log


def ranked_impact(found: DataFrame, limit: int) -> DataFrame:
    """The worst of what a change reaches: breaking first, then the largest risk, unknown risk last, then the least depth; ties by seed and node."""
    order = [F.desc("is_breaking"), F.desc_nulls_last("risk_score"), F.asc("depth"), F.asc("seed"), F.asc("node")]
    return found.withColumn("is_breaking", F.col("via").isin(BREAKING)).orderBy(*order).limit(limit)


def scoped_walk(edges: DataFrame, scope: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """A walk whose every node, seeds included, lies in the scope (id)."""
    inside = scope.select(F.col("id").alias("src")).distinct()
    kept = edges.join(inside, "src", "left_semi").join(inside.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return walk(kept, seeds.join(inside.withColumnRenamed("src", "seed"), "seed", "left_semi"), max_depth)


def dependent_files(edges: DataFrame, file_of: DataFrame, dirty: DataFrame, max_hops: int = 3) -> DataFrame:
    """(seed, file, hops): files that reach a dirty file (file) over so many edges between files; dirty files, whichever, are left out.

    Edges are drawn between the files (id, file) of their ends; those inside a file count nothing.
    """
    a, b = file_of.select(F.col("id").alias("src"), F.col("file").alias("_from")), file_of.select(F.col("id").alias("dst"), F.col("file").alias("_to"))
    between = edges.join(a, "src").join(b, "dst").filter("_from <> _to").groupBy(F.col("_from").alias("src"), F.col("_to").alias("dst")).agg(F.min("etype").alias("etype"), F.max("confidence").alias("confidence"))
    found = walk(swapped(between), dirty.select(F.col("file").alias("seed")), max_hops)
    return found.select("seed", F.col("node").alias("file"), F.col("depth").alias("hops")).join(dirty.select("file").distinct(), "file", "left_anti")


def edge_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_type, dst_type, etype, n): how many distinct edges (etype, src, dst) lead from a type of nodes (id, node_type) to another.

    Edges are dealt by their source once, for making them distinct and for the join alike; only counts by
    target go on to the second join.
    """
    one = edges.select("etype", "src", "dst").repartition("src").distinct()
    a, b = nodes.select(F.col("id").alias("src"), F.col("node_type").alias("src_type")), nodes.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type"))
    by_target = one.join(a, "src").groupBy("dst", "src_type", "etype").agg(F.count("*").alias("n"))
    return by_target.join(b, "dst").groupBy("src_type", "dst_type", "etype").agg(F.sum("n").alias("n"))


def with_lists(left: DataFrame, right: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """left with a sorted, joined list of the values that right has for its key; empty where there is none."""
    lists = right.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(value)), ",").alias(name))
    return left.join(lists, key, "left").withColumn(name, F.coalesce(name, F.lit("")))


def drift_snapshot(items: DataFrame, before: DataFrame) -> DataFrame:
    """One row: items by state and severity, and how many more or fewer there are than before."""
    n = lambda column, value: F.count_if(F.col(column) == value)
    counted = items.agg(
        F.count("*").alias("items"), *[n("state", s).alias(s) for s in ("open", "acknowledged", "in_flight", "resolved", "waived")],
        *[n("severity", s).alias(f"{s}_items") for s in ("critical", "high", "medium", "low")],
    )
    was = before.agg(F.count("*").alias("_was"))
    return counted.crossJoin(F.broadcast(was)).withColumn("delta", F.col("items") - F.col("_was")).drop("_was")


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_at = 1").drop("_at")
