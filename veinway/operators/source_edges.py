"""Edges that source text shows: what a class is given by injection, and which operation documents an endpoint."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What injection looks like (kind, language, type group, field group, pattern, confidence), surest first.
INJECTED = [
    ("@Autowired", "java", 1, 2, r"@(?:Autowired|Inject|Resource)\s+(?:private|protected|public)?\s+(?:final\s+)?(\w+)\s+(\w+)\s*;", 0.95),
    ("private final", "java", 1, 2, r"private\s+final\s+(\w+)\s+(\w+)\s*;", 0.88),
    ("field", "ts", 2, 1, r"(?:private|protected|public|readonly)\s+(?:readonly\s+)?(\w+)\s*:\s*(\w+)", 0.85),
    ("self", "python", 2, 1, r"self\.(\w+)\s*=\s*(\w+)\s*\(", 0.80),
]
CONSTRUCTOR, CONSTRUCTOR_CONFIDENCE = r"public\s+\w+\s*\(([^)]+)\)", 0.85
CLASSES = {"java": r"(?:public|private|protected)?\s+(?:class|interface|record)\s+(\w+)", "ts": r"class\s+(\w+)", "python": r"class\s+(\w+)"}
IMPORTS = {"ts": r"import\s+\{([^}]+)\}\s+from\s+['\"][^'\"]+['\"]", "python": r"from\s+[\w.]+\s+import\s+(.+)"}
VERBS = ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"]


def language(path: Column) -> Column:
    end = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.when(end == "java", "java").when(end.isin("ts", "tsx", "js", "jsx"), "ts").when(end == "py", "python")


def _found(kind: str, lang: str, type_group: int, field_group: int, pattern: str, confidence: float) -> Column:
    each = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(type_group)).alias("type"), F.regexp_extract_all("content", F.lit(pattern), F.lit(field_group)).alias("field"))
    rows = F.transform(each, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), x["type"].alias("type"), x["field"].alias("field")))
    return F.when(F.col("lang") == lang, rows).otherwise(F.array().cast("array<struct<kind:string,confidence:double,type:string,field:string>>"))


def injected(units: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst, confidence, evidence): the classes that a class in a unit (file_path, content) is given, where both are entities (name, external_id).

    Java: annotated fields, private final fields and the first constructor's parameters; TypeScript: fields of
    an imported type; Python: fields made of an imported class. An entity is met by its name or its last part, the
    full name first, then the least id. Of several signs of one edge the surest counts, then the first by
    its text. Units of other languages, without text or whose class is no entity give nothing.
    """
    known = entities.select("name", "external_id").dropna()
    keys = known.select(F.col("name").alias("key"), F.lit(0).alias("rank"), "external_id").unionAll(known.select(F.regexp_extract("name", r"([^.]*)$", 1), F.lit(1), "external_id"))
    by_key = keys.groupBy("key").agg(F.min(F.struct("rank", "external_id")).alias("best")).select("key", F.col("best.external_id").alias("external_id"))
    rows = units.select("file_path", "content", language(F.col("file_path")).alias("lang")).filter("lang IS NOT NULL AND content <> ''")
    stem = F.regexp_extract("file_path", r"([^/]*?)(?:\.java)?$", 1)
    own, names = F.lit(None).cast("string"), F.lit(None).cast("string")
    for lang, pattern in CLASSES.items():
        own = F.when(F.col("lang") == lang, F.regexp_extract("content", pattern, 1)).otherwise(own)
    for lang, pattern in IMPORTS.items():
        names = F.when(F.col("lang") == lang, F.array_join(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), ",")).otherwise(names)
    imported = F.transform(F.split(names, ","), lambda x: F.trim(F.regexp_replace(x, r"\sas\s.*$", "")))
    rows = rows.withColumns({"own": F.when((F.col("lang") == "java") & (own == ""), stem).otherwise(own), "imported": imported})
    parts = F.transform(F.split(F.regexp_extract("content", CONSTRUCTOR, 1), ","), lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " "))
    given = F.transform(F.filter(parts, lambda p: F.size(p) >= 2), lambda p: F.struct(F.lit("constructor").alias("kind"), F.lit(CONSTRUCTOR_CONFIDENCE).alias("confidence"), F.element_at(p, -2).alias("type"), F.element_at(p, -1).alias("field")))
    signs = F.concat(*[_found(*i) for i in INJECTED], F.when(F.col("lang") == "java", given).otherwise(F.array().cast("array<struct<kind:string,confidence:double,type:string,field:string>>")))
    each = rows.select("own", "lang", "imported", F.explode(signs).alias("s")).select("own", "lang", "imported", "s.*")
    each = each.filter((F.col("lang") == "java") | F.array_contains("imported", F.col("type")))
    met = each.join(by_key.select(F.col("key").alias("own"), F.col("external_id").alias("src")), "own").join(by_key.select(F.col("key").alias("type"), F.col("external_id").alias("dst")), "type")
    evidence = F.concat_ws(" ", "kind", "type", "field")
    return met.groupBy("src", "dst").agg(F.min(F.struct((-F.col("confidence")).alias("less"), evidence.alias("evidence"))).alias("best")).select("src", "dst", (-F.col("best.less")).alias("confidence"), "best.evidence")


def normal_path(path: Column) -> Column:
    """Double slashes become one, and one at the end goes."""
    one = F.regexp_replace(path, "/+", "/")
    return F.when(F.length(one) > 1, F.regexp_replace(one, "/$", "")).otherwise(one)


def endpoint(signature: Column) -> tuple[Column, Column]:
    """(method, path) of `VERB path` or of a mapping annotation; nulls for anything else."""
    s = F.trim(signature)
    verb = F.upper(F.regexp_extract(s, r"^(\S+)\s", 1))
    plain = verb.isin(VERBS)
    mapped = F.upper(F.regexp_extract(s, r"^@(Get|Post|Put|Patch|Delete)Mapping\(", 1))
    method = F.when(plain, verb).when(mapped != "", mapped)
    path = F.when(plain, F.trim(F.regexp_extract(s, r"^\S+\s+(.*)$", 1))).when(mapped != "", F.regexp_extract(s, r"\(.*?['\"]([^'\"]*)['\"]", 1))
    return method, F.nullif(path, F.lit(""))


def documented(operations: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(file, operation_id, path, method, endpoint): operations (as sources/openapi gives them) and the endpoints (id, signature) of the same method and normal path."""
    method, path = endpoint(F.col("signature"))
    code = endpoints.select(F.col("id").alias("endpoint"), method.alias("method"), normal_path(path).alias("norm")).dropna(subset=["method", "norm"])
    return operations.withColumn("norm", normal_path(F.col("path"))).join(code, ["method", "norm"]).select("file", "operation_id", "path", "method", "endpoint").distinct()
