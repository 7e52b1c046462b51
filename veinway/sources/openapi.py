"""Operations, parameters and schemas of OpenAPI documents, kept as variants.

Documents are JSON of version 2 or 3. Everything is taken apart in Spark: a document is one variant,
its objects are exploded by key, and references between schemas are followed by joins.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.lineage import pinned

METHODS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]


def parsed(files: DataFrame, content: str = "content") -> DataFrame:
    """(file, doc) of the files whose content is a JSON object; others have no row."""
    doc = F.try_parse_json(F.col(content))
    return files.select("file", doc.alias("doc")).filter(F.schema_of_variant("doc").startswith("OBJECT"))


def fields(rows: DataFrame, value: str, path: str, *keep: str) -> DataFrame:
    """(keep..., pos, key, value): the fields of the object, or elements of the array, at a path of a variant column."""
    at = F.try_variant_get(F.col(value), path, "variant")
    rows = rows.select(*keep, at.alias("_at"))
    return rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("_at").outer())).drop("_at")


def text(value: str, path: str) -> Column:
    return F.try_variant_get(F.col(value), path, "string")


REF = "$['$ref']"


def schema_ref(value: str, path: str = "$") -> Column:
    """The schema that a schema object names, itself or for its items; null for none."""
    return F.coalesce(text(value, path + REF[1:]), text(value, path + ".items" + REF[1:]))


def short(ref: Column) -> Column:
    return F.regexp_extract(ref, r"([^/]*)$", 1)


def operations(docs: DataFrame) -> DataFrame:
    """(file, path, method, operation_id, summary, tags, op): one row for each method of each path; op is its variant."""
    methods = fields(fields(docs, "doc", "$.paths", "file").withColumnsRenamed({"key": "path", "value": "item"}).drop("pos"), "item", "$", "file", "path")
    return methods.filter(F.lower("key").isin(METHODS) & F.schema_of_variant("value").startswith("OBJECT")).select(
        "file", "path", F.upper("key").alias("method"), F.coalesce(text("value", "$.operationId"), F.lit("")).alias("operation_id"),
        F.coalesce(text("value", "$.summary"), F.lit("")).alias("summary"), F.try_variant_get("value", "$.tags", "array<string>").alias("tags"), F.col("value").alias("op"),
    )


def payloads(ops: DataFrame) -> DataFrame:
    """(file, path, method, role, code, ref): the schemas that operations take (`request`) and give (`response`, by numeric code).

    Of several media types the first that names a schema counts; version 2 names it in a body parameter
    or in the response itself.
    """
    key = ["file", "path", "method"]
    media = fields(ops, "op", "$.requestBody.content", *key).withColumn("ref", schema_ref("value", "$.schema"))
    body = fields(ops, "op", "$.parameters", *key).filter(text("value", "$.in") == "body").withColumn("ref", schema_ref("value", "$.schema"))
    asked = media.withColumn("rank", F.lit(0)).unionByName(body.withColumn("rank", F.lit(1))).filter("ref IS NOT NULL")
    asked = asked.groupBy(*key).agg(F.min_by("ref", F.struct("rank", "pos")).alias("ref")).withColumns({"role": F.lit("request"), "code": F.lit(None).cast("int")})
    given = fields(ops, "op", "$.responses", *key).withColumn("code", F.expr("try_cast(key AS INT)")).filter("code IS NOT NULL").select(*key, "code", F.col("value").alias("response"))
    own = given.withColumn("ref", schema_ref("response", "$.schema")).select(*key, "code", "ref", F.lit(1).alias("rank"), F.lit(0).alias("pos"))
    typed = fields(given, "response", "$.content", *key, "code").withColumn("ref", schema_ref("value", "$.schema")).select(*key, "code", "ref", F.lit(0).alias("rank"), "pos")
    given = typed.unionByName(own).filter("ref IS NOT NULL").groupBy(*key, "code").agg(F.min_by("ref", F.struct("rank", "pos")).alias("ref")).withColumn("role", F.lit("response"))
    return asked.unionByName(given).select(*key, "role", "code", "ref")


def parameters(docs: DataFrame, ops: DataFrame) -> DataFrame:
    """(file, path, method, name, place, required): parameters of operations; those that are named by a reference are looked up.

    A reference to a parameter that is not there has the last part of its path as the name and no place.
    """
    own = fields(ops, "op", "$.parameters", "file", "path", "method").withColumn("ref", text("value", REF))
    shared = fields(docs, "doc", "$.components.parameters", "file").unionByName(fields(docs, "doc", "$.parameters", "file"))
    shared = shared.select("file", F.col("key").alias("ref_name"), F.col("value").alias("there"))
    met = own.withColumn("ref_name", short("ref")).join(shared, ["file", "ref_name"], "left").withColumn("it", F.coalesce("there", F.when(F.col("ref").isNull(), F.col("value"))))
    return met.select(
        "file", "path", "method", F.coalesce(text("it", "$.name"), "ref_name").alias("name"), text("it", "$.in").alias("place"),
        F.coalesce(F.try_variant_get("it", "$.required", "boolean"), F.lit(False)).alias("required"),
    )


def schemas(docs: DataFrame) -> DataFrame:
    """(file, name, type, required, schema): named schemas; one of the components goes before a definition of that name."""
    new = fields(docs, "doc", "$.components.schemas", "file").withColumn("rank", F.lit(0))
    old = fields(docs, "doc", "$.definitions", "file").withColumn("rank", F.lit(1))
    rows = new.unionByName(old).filter(F.schema_of_variant("value").startswith("OBJECT"))
    best = rows.withColumnRenamed("key", "name").withColumn("best", F.min("rank").over(Window.partitionBy("file", "name"))).filter("rank = best")
    return best.select(
        "file", "name", F.coalesce(text("value", "$.type"), F.lit("object")).alias("type"),
        F.coalesce(F.try_variant_get("value", "$.required", "array<string>"), F.array().cast("array<string>")).alias("required"), F.col("value").alias("schema"),
    )


def properties(named: DataFrame) -> DataFrame:
    """(file, name, property, type, ref) of each property of each named schema."""
    each = fields(named, "schema", "$.properties", "file", "name")
    return each.select("file", "name", F.col("key").alias("property"), F.coalesce(text("value", "$.type"), F.when(~F.schema_of_variant("value").startswith("OBJECT"), F.col("value").cast("string"))).alias("type"), schema_ref("value").alias("ref"))


def references(named: DataFrame) -> DataFrame:
    """(file, name, target): the schemas that a schema names in its properties, items or combinations."""
    parts = [properties(named).select("file", "name", "ref"), named.select("file", "name", schema_ref("schema").alias("ref"))]
    parts += [fields(named, "schema", f"$.{k}", "file", "name").select("file", "name", schema_ref("value").alias("ref")) for k in ("allOf", "anyOf", "oneOf")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("ref IS NOT NULL").select("file", "name", short(F.col("ref")).alias("target")).distinct()


def resolved(named: DataFrame) -> DataFrame:
    """(file, name, target, depth, missing, cyclic): everything that a schema is made of, over any number of references.

    depth is the least number of references; `missing` tells that no schema has that name, `cyclic` that
    a schema is part of itself. Schemas of different files don't meet. References are followed to the
    fixpoint, with all pairs that were found before taken off, so a cycle ends where it closes. The named
    schemas are stored, so documents are not read again for each place of a reference.
    """
    named = pinned(named)
    steps = pinned(references(named))
    frontier = found = pinned(steps.withColumn("depth", F.lit(1)))
    depth = 1
    while not frontier.isEmpty():
        depth += 1
        further = frontier.select("file", "name", F.col("target").alias("via")).join(steps.select("file", F.col("name").alias("via"), "target"), ["file", "via"]).select("file", "name", "target").distinct()
        frontier = pinned(further.join(found, ["file", "name", "target"], "left_anti").withColumn("depth", F.lit(depth)))
        found = found.unionByName(frontier)
    there = named.select("file", F.col("name").alias("target"), F.lit(True).alias("there")).distinct()
    return found.join(there, ["file", "target"], "left").select("file", "name", "target", "depth", F.col("there").isNull().alias("missing"), (F.col("name") == F.col("target")).alias("cyclic"))
