"""Versions, guards and routing: what is current, what is unique, what goes where."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Mappings that results depend on.
CHECK_SEVERITY = {"breaking": "critical", "warning": "high", "info": "low"}
PERSONA_WORDS = {"vp": ["strategy", "budget", "risk", "cost"], "pm": ["roadmap", "feature", "user", "release"], "dev": ["code", "function", "bug", "class"]}
KIND_PRIORITY = ["class", "interface", "function", "method", "type", "constant"]


def current(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("valid_to").isNull())


def invalidated(rows: DataFrame, prefix: str, at: Column) -> DataFrame:
    """Closes the current versions whose urn starts with a prefix."""
    hit = F.col("valid_to").isNull() & F.col("urn").startswith(prefix)
    return rows.withColumn("valid_to", F.when(hit, at).otherwise(F.col("valid_to")))


def severity_of(kind: Column) -> Column:
    out = F.lit("medium")
    for k, v in CHECK_SEVERITY.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def resolve_unique(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left rows with the right row of their key, where there is exactly one."""
    one = right.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(c).alias(c) for c in right.columns if c != key]).filter("_n = 1").drop("_n")
    return left.join(one, key)


def ambiguous(terms: DataFrame, term: str, bucket: str, least: int = 2) -> DataFrame:
    """Terms that stand in at least so many buckets."""
    return terms.groupBy(term).agg(F.count_distinct(bucket).alias("buckets")).filter(F.col("buckets") >= least)


def persona(text: Column) -> Column:
    """The persona named by @name, else the one with most of its words; ties go vp, pm, dev; none is dev."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.split(low, "[^a-z@]+")
    hits = [F.size(F.array_intersect(words, F.array(*map(F.lit, w)))) for w in PERSONA_WORDS.values()]
    most = F.greatest(*hits)
    out = F.lit("dev")
    for name, n in reversed(list(zip(PERSONA_WORDS, hits, strict=True))):
        out = F.when((n == most) & (most > 0), name).otherwise(out)
    for name in PERSONA_WORDS:
        out = F.when(F.array_contains(words, f"@{name}"), name).otherwise(out)
    return out


def kind_order(kind: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, KIND_PRIORITY)), kind), F.lit(0)), F.lit(len(KIND_PRIORITY) + 1))


def numbered_batches(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """Adds batch: consecutive rows of a group in batches of at most so many."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(at / most))


def context_tiers(rows: DataFrame, by: str, near: Column, order: list[Column], t2: int = 3, t1: int = 10) -> DataFrame:
    """Adds tier: the first t2 near rows are T2, the next t1 of the others T1, the rest T0; what overflows T2 falls to T1."""
    first = rows.withColumn("_near", near).withColumn("_at", F.row_number().over(Window.partitionBy(by, "_near").orderBy(*order)))
    first = first.withColumn("_t2", F.col("_near") & (F.col("_at") <= t2))
    second = first.withColumn("_at", F.row_number().over(Window.partitionBy(by, "_t2").orderBy(*order)))
    return second.withColumn("tier", F.when(F.col("_t2"), "T2").when(F.col("_at") <= t1, "T1").otherwise("T0")).drop("_near", "_at", "_t2")


def endpoints_count(edges: DataFrame, file_of: DataFrame) -> DataFrame:
    """(file, edges): edges that begin or end in a file, both ways counted."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.join(file_of, "id").groupBy("file").agg(F.count("*").alias("edges"))


def with_template(rows: DataFrame, order: list[Column], templates: list[str], n: int) -> DataFrame:
    """The n best rows, each with the next of the templates in turn."""
    top = rows.orderBy(*order).limit(n)
    at = F.row_number().over(Window.orderBy(*order))
    return top.withColumn("template", F.element_at(F.array(*map(F.lit, templates)), (F.pmod(at, F.lit(len(templates))) + 1).cast("int")))
