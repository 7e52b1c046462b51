"""Connected components of a graph of edges, by contraction inside tasks and meetings at vertices."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import pinned


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(v, root), once for every vertex of edges (a, b); root is the least vertex of its component.

    In a round every task joins the edges it holds and labels their vertices with the least vertex
    they reach there. The labels of a vertex, one from a task at most however many neighbours it
    has, then meet in one task, which ties them to the least; then every label is replaced by its
    own label. Rounds end when nothing changes.
    Null vertices and loops are ignored; no edges give no rows.
    """
    kinds = ", ".join(f"{c} {edges.schema['a'].dataType.simpleString()}" for c in ("a", "b"))
    edges = edges.select("a", "b").filter(F.col("a") != F.col("b"))
    before = None
    for _ in range(most_rounds):
        met = pinned(edges.mapInPandas(_label, kinds).repartition(F.col("a")).mapInPandas(_meet, kinds).distinct())
        edges = pinned(_jump(met))
        state = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).distinct()


def _jump(edges: DataFrame) -> DataFrame:
    """Every label replaced by the least label that this label has itself.

    A label's own label is asked for once by each of a fixed number of parts, so that no task reads all vertices of a component.
    """
    parts = F.pmod(F.xxhash64("a"), F.lit(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = edges.withColumn("part", parts)
    up = edges.filter("a <> b").groupBy(F.col("a").alias("b")).agg(F.min("b").alias("up"))
    told = dealt.select("part", "b").distinct().join(up, "b")
    return dealt.join(told, ["part", "b"], "left").select("a", F.coalesce("up", "b").alias("b")).distinct()


def _label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(vertex, least vertex that it reaches over this task's edges), roots included."""
    up: dict = {}

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for batch in batches:
        for a, b in zip(batch["a"], batch["b"], strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    yield pd.DataFrame({"a": list(up), "b": [find(v) for v in up]}, dtype=object)


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every vertex with its least label, and its other labels with that label."""
    labels: dict = {}
    for batch in batches:
        for v, label in zip(batch["a"], batch["b"], strict=True):
            labels.setdefault(v, set()).add(label)
    out = {(v, min(found)) for v, found in labels.items()}
    for found in labels.values():
        least = min(found)
        out.update((label, least) for label in found if label != least)
    pairs = sorted(out)
    yield pd.DataFrame({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, dtype=object)
