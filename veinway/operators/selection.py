"""Filters, rankings, batches and roll-ups with fixed rules."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Words, caps and tables that results depend on.
ENTRY_PATTERNS = [
    r"@app\.(get|post|put|delete|patch|route)\b", r"@router\.(get|post|put|delete|patch)\b", r"@blueprint\.\w+", r"@api\.route\b", r"@celery\.task\b", r"@shared_task\b", r"@app\.task\b",
    r"@periodic_task\b", r"@schedule\b", r"@(RestController|Controller|RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping)\b",
    r"@(EventListener|KafkaListener|RabbitListener|JmsListener|SqsListener|ScheduledFuture|Scheduled)\b", r"@(CommandLineRunner|ApplicationRunner)\b",
    r"@(Get|Post|Put|Delete|Patch|Controller|EventPattern|MessagePattern|GrpcMethod)\b", r"router\.(get|post|put|delete|patch)\s*\(", r"func\s+\w*(Handler|Controller|Serve|Listen)\w*\s*\(",
    r"http\.(HandleFunc|Handle)\s*\(", r"gin\.(GET|POST|PUT|DELETE|PATCH)\s*\(", r"@click\.command\b", r"@click\.group\b", r"if\s+__name__\s*==\s*[\"']__main__[\"']\s*:",
    r"\bdef\s+(handle_|on_|process_|consume_)\w+", r"\bpublic\s+\w+\s+(handle|process|consume)\w*\s*\(",
]
TRIVIAL_NAMES = r"^(get|set|is|has)[A-Z]\w*$|^(equals|hashCode|toString|__init__|__repr__|__str__)$"
FIELD_CAPS = {"implement": 2000, "review": 1500, "explain": 800}
DETAIL = {"minimal": 2, "standard": 4, "verbose": None}
ROLES = {"controller": 1, "service": 2, "repository": 3}


def is_entry_point(*texts: Column) -> Column:
    """Whether a text holds an annotation, a registration or a name that marks a way into a program."""
    return F.coalesce(F.concat_ws(" ", *texts).rlike("|".join(f"(?:{p})" for p in ENTRY_PATTERNS)), F.lit(False))


def any_segment(name: Column, segments: list[str]) -> Column:
    """Whether a name holds one of the segments, in any case."""
    out = F.lit(False)
    for s in segments:
        out = out | F.contains(F.lower(name), F.lit(s.lower()))
    return out


def glob(pattern: str) -> str:
    """A glob as an anchored regular expression for any case."""
    import re

    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def triviality(name: Column, body: Column) -> Column:
    """Why a chunk is not worth reading: an accessor by name, four lines at most, or a bare return; null where it is."""
    lines = F.size(F.filter(F.split(body, "\n"), lambda x: F.trim(x) != ""))
    return (
        F.when(name.rlike(TRIVIAL_NAMES), "accessor").when(lines <= 4, "short").when(body.rlike(r"(?s)^\s*return [\w.]+;?\s*$"), "bare return")
    )


def unknown_types(edges: DataFrame, taxonomy: list[str]) -> DataFrame:
    """Edges whose type the taxonomy does not list."""
    return edges.filter(~F.col("etype").isin(taxonomy))


def semantic_tag(path: Column, rules: list[tuple[str, str]]) -> Column:
    """The tag of the first rule that a configuration path meets."""
    out = F.lit(None).cast("string")
    for pattern, tag in reversed(rules):
        out = F.when(path.rlike(pattern), tag).otherwise(out)
    return out


def capped_fields(df: DataFrame, task: str, text: str) -> DataFrame:
    return df.withColumn(text, F.left(text, F.lit(FIELD_CAPS.get(task, 800))))


def detail(df: DataFrame, level: str) -> DataFrame:
    """The first columns that a level of detail shows."""
    return df.select(*df.columns[: DETAIL[level]])


def class_batches(chunks: DataFrame, order: list[str], owner: str, size: str, most: int = 8, large: int = 800) -> DataFrame:
    """Adds batch: neighbours of one owner together, so many at most; large chunks stand alone."""
    w = Window.orderBy(*order) if not order[:-1] else Window.partitionBy(*order[:-1]).orderBy(order[-1])
    big = F.col(size) >= large
    new = F.lag(owner).over(w).isNull() | (F.lag(owner).over(w) != F.col(owner)) | big | F.coalesce(F.lag(size).over(w) >= large, F.lit(False))
    island = chunks.withColumn("_island", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keys = [*order[:-1], "_island"]
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(order[-1])) - 1
    return island.withColumn("batch", F.concat_ws(".", F.col("_island").cast("string"), F.floor(inside / most).cast("string"))).drop("_island")


def keep_best(rows: DataFrame, by: str, quality: Column, age_days: Column, tie: str, most: int = 200) -> DataFrame:
    """The `most` rows of each bucket with the largest quality, which halves by e every 30 days."""
    value = quality * F.exp(-age_days / 30)
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_value"), tie))
    return rows.withColumn("_value", value).withColumn("place", place).filter(F.col("place") <= most).drop("_value")


def one_per_role(files: DataFrame, by: str, role: Column, age: str, tie: str, n: int = 5) -> DataFrame:
    """A reading path: the oldest file of each role first, in order of roles, then the oldest others, n in all."""
    rank = F.lit(9)
    for name, place in ROLES.items():
        rank = F.when(role == name, place).otherwise(rank)
    first = F.row_number().over(Window.partitionBy(by, "_rank").orderBy(age, tie))
    path = files.withColumn("_rank", rank).withColumn("_first", (F.col("_rank") < 9) & (first == 1))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_first"), F.when(F.col("_first"), F.col("_rank")).otherwise(0), age, tie))
    return path.withColumn("position", place).filter(F.col("position") <= n).drop("_rank", "_first")


def recall(cases: DataFrame, expected: str, found: str) -> DataFrame:
    """Per case the share of expected items that were found; 1 where nothing was expected."""
    return cases.withColumn("recall", F.coalesce(F.try_divide(F.size(F.array_intersect(expected, found)), F.size(F.array_distinct(expected))), F.lit(1.0)))


def source_diversity(paths: DataFrame, by: str, path: str) -> DataFrame:
    """Distinct paths over paths; one half without any."""
    return paths.groupBy(by).agg(F.round(F.coalesce(F.try_divide(F.count_distinct(path), F.count(path)), F.lit(0.5)), 4).alias("diversity"))


def route_drift(routes: DataFrame, contracts: DataFrame) -> DataFrame:
    """Routes (path, method) against contracts: another method at the same path is breaking, an unknown path a warning."""
    from veinway.operators.text import normal_path

    r = routes.select("path", "method", normal_path(F.col("path")).alias("norm"))
    c = contracts.groupBy(normal_path(F.col("path")).alias("norm")).agg(F.collect_set("method").alias("methods"))
    both = r.join(c, "norm", "left")
    kind = F.when(F.col("methods").isNull(), "path_mismatch").when(~F.array_contains("methods", F.col("method")), "method_mismatch")
    return both.withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "path", "method", "kind", F.when(F.col("kind") == "method_mismatch", "breaking").otherwise("warning").alias("severity"),
        F.when(F.col("kind") == "method_mismatch", 0.80).otherwise(0.75).alias("confidence"),
    )


def with_price(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """Adds cost from a price table (model, input_rate, output_rate per million); models without one cost 1 and 3."""
    joined = calls.join(prices, model, "left")
    cost = (F.col("tokens_in") * F.coalesce("input_rate", F.lit(1.0)) + F.col("tokens_out") * F.coalesce("output_rate", F.lit(3.0))) / 1_000_000
    return joined.withColumn("cost", cost).drop("input_rate", "output_rate")
