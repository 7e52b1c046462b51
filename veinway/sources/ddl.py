"""Schema text to columns: CREATE TABLE statements through a table function over native splitting."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLE = r"(?is)create\s+table\s+(?:if\s+not\s+exists\s+)?[\"`]?([\w.]+)[\"`]?\s*\((.*?)\)\s*(?:partition\s+by[^;]*)?;"
CONSTRAINT = r"(?i)^(primary|foreign|unique|constraint|check|exclude|index|key)\b"


def ddl_columns(scripts: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, table, position, column, type, nullable, is_primary_key, references) of every column definition.

    Comments are taken out first; definitions are cut at commas outside parentheses.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), r"--[^\n]*", ""), r"(?s)/\*.*?\*/", "")
    matches = F.regexp_extract_all(clean, F.lit(f"({TABLE})"), F.lit(1))
    tables = scripts.select(id_column, F.explode(matches).alias("m")).select(
        id_column, F.regexp_extract("m", TABLE, 1).alias("table"), F.regexp_extract("m", TABLE, 2).alias("body")
    )
    parts = tables.select(id_column, "table", F.posexplode(F.split("body", r",(?![^(]*\))")).alias("position", "part")).withColumn("part", F.trim(F.regexp_replace("part", r"\s+", " ")))
    part = F.col("part")
    columns = parts.filter((part != "") & ~part.rlike(CONSTRAINT))
    reference = F.nullif(F.regexp_extract(part, r"(?i)references ([\w.]+ ?\([^)]*\)|[\w.]+)", 1), F.lit(""))
    return columns.select(
        id_column, "table", "position", F.regexp_extract(part, r'^[\"`]?(\w+)', 1).alias("column"),
        F.lower(F.regexp_extract(part, r"(?i)^\S+ ([a-z_]+(?: ?\([^)]*\))?(?:\[\])?)", 1)).alias("type"),
        (~part.rlike(r"(?i)not null|primary key")).alias("nullable"), part.rlike(r"(?i)primary key").alias("is_primary_key"), reference.alias("references"),
    )
