"""Source trees and document stores as DataFrames."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File kinds that results depend on.
LANGUAGES = {
    "py": "python", "java": "java", "kt": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go",
    "rs": "rust", "rb": "ruby", "cs": "csharp", "php": "php", "scala": "scala", "sql": "sql", "yaml": "yaml", "yml": "yaml", "json": "json", "xml": "xml", "md": "markdown", "proto": "protobuf",
}
SKIPPED = r"(^|/)(node_modules|vendor|\.git|dist|build|target|__pycache__|\.venv)(/|$)"


def language(path: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return names[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def tier(path: Column, size: Column) -> Column:
    """skip, or how closely a file is worth reading: tests 5, configuration 3, large files 2, other code 1."""
    return (
        F.when(path.rlike(SKIPPED) | language(path).isNull() | (size == 0), "skip").when(path.rlike(r"(?i)(^|/)(tests?|spec)/|[._-](test|spec)\."), "tier5")
        .when(language(path).isin("yaml", "json", "xml", "markdown"), "tier3").when(size > 100_000, "tier2").otherwise("tier1")
    )


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, language, tier, skip_reason); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    reason = (
        F.when(F.col("path").rlike(SKIPPED), "vendored").when(language(F.col("path")).isNull(), "unknown language").when(F.col("length") == 0, "empty")
    )
    return files.withColumns({"language": language(F.col("path")), "tier": tier(F.col("path"), F.col("length")), "skip_reason": reason})


def changed_files(commits: DataFrame, files: DataFrame, since: Column, until: Column) -> DataFrame:
    """Listed files that commits (path, status, committed_at) between two times added, copied, modified, renamed or retyped."""
    touched = commits.filter(F.col("status").isin("A", "C", "M", "R", "T") & F.col("committed_at").between(since, until)).select("path").distinct()
    return files.join(touched, "path", "left_semi")


def write_store(entities: DataFrame, folder: str) -> None:
    """One folder of JSON lines per entity type."""
    entities.write.mode("overwrite").partitionBy("entity_type").json(folder)


def read_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def lookup(asked: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of a store (name, value) for asked names: by the name itself, else in lower case, else by what follows the last dot."""
    exact = store.groupBy("name").agg(F.max("value").alias("v1"))
    low = store.groupBy(F.lower("name").alias("low")).agg(F.max("value").alias("v2"))
    tail = store.groupBy(F.lower(F.regexp_extract("name", r"([^.]+)$", 1)).alias("tail")).agg(F.max("value").alias("v3"))
    keyed = asked.select("name", F.lower("name").alias("low"), F.lower(F.regexp_extract("name", r"([^.]+)$", 1)).alias("tail"))
    found = keyed.join(exact, "name", "left").join(low, "low", "left").join(tail, "tail", "left")
    return found.select("name", F.coalesce("v1", "v2", "v3").alias("value"))
