"""Upserts, merges and differences of keyed tables, as joins and aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_edges(edges: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """One edge per (etype, src, dst) with the greatest confidence and the latest last_seen.

    With `endpoints` (a column id), edges whose ends are not both known are left out.
    """
    out = edges.groupBy("etype", "src", "dst").agg(F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"))
    if endpoints is not None:
        for end in ("src", "dst"):
            out = out.join(endpoints.select(F.col("id").alias(end)), end, "left_semi")
    return out


def pruned(edges: DataFrame, as_of: Column, days: int) -> DataFrame:
    """Marks edges that have not been seen for so many days."""
    return edges.withColumn("is_pruned", F.col("last_seen") < as_of - F.expr(f"INTERVAL {int(days)} DAYS"))


def swapped(edges: DataFrame) -> DataFrame:
    """The edges turned round: src and dst change places, all else stays."""
    other = {"src": "dst", "dst": "src"}
    return edges.select(*[F.col(other.get(c, c)).alias(c) for c in edges.columns])


def upsert_nodes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full-outer merge: new values win, missing ones are filled from the old row; `state` says what happened.

    Of new rows that repeat a key the one with the largest values, in their order, counts: the same one in every run.
    """
    best = F.max(F.struct(*dict.fromkeys(values))).alias("_new")
    new = new.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_new.`{v}`").alias(v) for v in values])
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    marked_a, marked_b = a.withColumn("_a", F.lit(True)).alias("a"), b.withColumn("_b", F.lit(True)).alias("b")
    state = F.when(F.col("_a").isNull(), "created").when(F.col("_b").isNull(), "kept").otherwise("updated")
    return marked_a.join(marked_b, on, "full").select(
        *[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[F.coalesce(f"b.{v}", f"a.{v}").alias(v) for v in values], state.alias("state")
    )


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: rows of old whose key comes again go, all new rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def artifact_changes(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Events for created and changed artifacts, by the hash of the trimmed content: keys, event_kind, old_hash, new_hash."""
    h = lambda df, name: df.select(*keys, F.sha2(F.trim(content), 256).alias(name))
    both = h(new, "new_hash").join(h(old, "old_hash"), keys, "left")
    kind = F.when(F.col("old_hash").isNull(), "created").when(F.col("old_hash") != F.col("new_hash"), "changed")
    return both.withColumn("event_kind", kind).filter("event_kind IS NOT NULL").select(*keys, "event_kind", "old_hash", "new_hash")


def unchanged(fresh: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Artifacts whose hash is unchanged and from which at least one node is derived."""
    return fresh.filter(F.col("old_hash") == F.col("new_hash")).join(derived, keys, "left_semi")


def strongest(edges: DataFrame, keys: list[str], evidence: str) -> DataFrame:
    """One row per key: the largest confidence, then the longest evidence, then the evidence itself."""
    order = [F.desc_nulls_last("confidence"), F.desc_nulls_last(F.length(evidence)), F.asc(evidence)]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return edges.withColumn("_at", at).filter("_at = 1").drop("_at")


def merge_entities(entities: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """The winner of each key by confidence and text lengths; its blank texts come from the next best that has one."""
    order = [F.desc_nulls_last("confidence"), *[F.desc(F.coalesce(F.length(t), F.lit(0))) for t in texts], *[F.asc_nulls_last(t) for t in texts]]
    w = Window.partitionBy(*keys).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = entities.withColumn("_at", F.row_number().over(w)).withColumns(
        {t: F.first(F.nullif(F.trim(t), F.lit("")), ignorenulls=True).over(whole) for t in texts}
    )
    return filled.filter("_at = 1").drop("_at")


def changed_hashes(old: DataFrame, new: DataFrame, key: str, hash_column: str) -> DataFrame:
    """Keys that are new or whose hash differs; deletions are not reported."""
    was = old.select(key, F.col(hash_column).alias("_was"))
    return new.join(was, key, "left").filter(F.col("_was").isNull() | (F.col("_was") != F.col(hash_column))).select(key)


def field_diff(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Differences of two field lists (keys, field, type, required): kind and severity.

    A missing required field or another type is breaking, a missing optional field a warning, an extra one info.
    """
    e = expected.select(*keys, "field", F.col("type").alias("expected_type"), "required")
    a = actual.select(*keys, "field", F.col("type").alias("actual_type"))
    both = e.join(a, [*keys, "field"], "full")
    kind = (
        F.when(F.col("expected_type").isNull(), "extra").when(F.col("actual_type").isNull(), "missing")
        .when(F.col("expected_type") != F.col("actual_type"), "type_mismatch")
    )
    severity = (
        F.when(F.col("kind") == "extra", "info").when((F.col("kind") == "missing") & ~F.col("required"), "warning").otherwise("breaking")
    )
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").withColumn("severity", severity).drop("required")
