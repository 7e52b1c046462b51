"""Which entities matter to an endpoint, and which of them it enters by."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.lineage import pinned
from veinway.operators.matching import substring_join

# What is dropped and what counts how much.
LEAST_CONFIDENCE = 0.5
TYPE_PRIORITY = {"ApiEndpoint": 10, "DatabaseQuery": 9, "InterfaceMethod": 9, "Function": 8, "Class": 7, "class": 7, "SchemaField": 4, "DatabaseColumn": 3, "constant": 1}
OTHER_TYPE = 2
DIFF = r"(?i)^(Added|Removed|Modified)\s+(Constant|Field|Import):"
TEST = r"(?i)(Test|Tests|Spec|IT|IntegrationTest)$"
NOISE = r"(?i)(Constants?|Keys?|Enums?|Mapping|Mappings|Config|Properties|Messages?|Errors?)$"
LAYERS = ["controller", "controllers", "service", "services", "repository", "repositories", "repo", "repos", "handler", "handlers", "usecase", "usecases", "adapter", "adapters", "gateway", "gateways", "command", "query"]
GENERIC = ["api", "v1", "v2", "v3", "rest", "public", "private", "internal"]


def drop_reason(name: Column, kind: Column, confidence: Column, query_text: Column) -> Column:
    """Why an entity does not count, the first reason of several; null for one that does."""
    last = F.regexp_extract(name, r"([^.]*)$", 1)
    return (
        F.when(name.rlike(DIFF), "diff_artifact").when(F.lower(kind).isin("constant", "configkey"), "constant_type")
        .when((kind == "DatabaseQuery") & (F.coalesce(query_text, F.lit("")) == ""), "empty_query_text").when(confidence < LEAST_CONFIDENCE, "low_confidence")
        .when(last.rlike(TEST), "test_class").when(last.rlike(NOISE) & F.lower(kind).isin("class", ""), "noise_suffix")
    )


def endpoint_terms(endpoint: str) -> list[str]:
    """The words of a path that tell something: not generic, no numbers, three letters at least."""
    words = endpoint.lower().replace("-", "/").replace("_", "/").split("/")
    return sorted({w for w in words if len(w) > 2 and w not in GENERIC and not w.isdigit()})


def relevance(name: Column, kind: Column, file: Column, endpoint: str) -> Column:
    """0 to 10: four tenths of the type's priority, 3 for a file in a layer that matters, 3 for a name with one of the endpoint's words."""
    priority = F.lit(OTHER_TYPE)
    for k, v in TYPE_PRIORITY.items():
        priority = F.when(kind == k, v).otherwise(priority)
    layered = F.arrays_overlap(F.split(F.lower(file), r"[/\\.]"), F.array(*map(F.lit, LAYERS)))
    named = F.lit(False)
    for word in endpoint_terms(endpoint):
        named = named | F.contains(F.lower(name), F.lit(word))
    return priority * 0.4 + F.when(layered, 3.0).otherwise(0.0) + F.when(named, 3.0).otherwise(0.0)


def relevant(entities: DataFrame, endpoint: str, most: int = 60) -> DataFrame:
    """The `most` entities (name, entity_type, file, confidence, query_text) that matter most to an endpoint, with `relevance`.

    Ties go by confidence, then by name, type and file. Null names, types and files count as empty, a null confidence as 0.
    """
    name, kind, file = (F.coalesce(c, F.lit("")) for c in ("name", "entity_type", "file"))
    sure = F.coalesce("confidence", F.lit(0.0))
    kept = entities.filter(drop_reason(name, kind, sure, F.col("query_text")).isNull()).withColumn("relevance", F.round(relevance(name, kind, file, endpoint), 4))
    return kept.orderBy(F.desc("relevance"), F.desc(sure), "name", "entity_type", "file").limit(most)


def dropped(entities: DataFrame) -> DataFrame:
    """(reason, entities): how many entities go for which reason."""
    reason = drop_reason(F.coalesce("name", F.lit("")), F.coalesce("entity_type", F.lit("")), F.coalesce("confidence", F.lit(0.0)), F.col("query_text"))
    return entities.select(reason.alias("reason")).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("entities"))


def entry_points(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """(request, name, rung): the entities (name, entity_type, signature) by which requests (request, method, path) enter.

    Rung 1: endpoints whose signature holds the path and, where one is given, the method; 2: the path alone;
    3: endpoints and functions whose name holds the path's last part without braces, case aside. Only the
    first rung that gives anything counts for a request. Requests without a path have no entry. Both
    containments go through the gram index, so no request is held against every entity, and names are looked
    through only for requests that no path has met.
    """
    asked = requests.select("request", F.upper(F.coalesce("method", F.lit(""))).alias("method"), F.trim("path").alias("path")).filter("path <> ''").distinct()
    ends = entities.filter("entity_type = 'ApiEndpoint'").select("name", "signature").distinct()
    held = substring_join(ends, asked, "signature", "path").filter(F.contains("signature", "path"))
    rung = F.when((F.col("method") == "") | F.contains(F.upper("signature"), "method"), 1).otherwise(2)
    by_path = pinned(held.select("request", "name", rung.alias("rung")).distinct())
    first = by_path.groupBy("request").agg(F.min("rung").alias("rung"))
    parts = F.filter(F.split("path", "/"), lambda p: (p != "") & ~F.contains(p, F.lit("{")))
    tails = asked.withColumn("tail", F.lower(F.try_element_at(parts, F.lit(-1)))).filter("tail IS NOT NULL").select("request", "tail").distinct()
    named = entities.filter("entity_type IN ('ApiEndpoint', 'Function')").select("name").distinct()
    unmet = pinned(tails.join(first, "request", "left_anti").withColumn("tails", F.count("*").over(Window.partitionBy("request"))))
    below = lambda asking: substring_join(named, asking, "name", "tail").filter(F.contains(F.lower("name"), "tail")).select("request", "name", F.lit(3).alias("rung"))
    by_name, several = below(unmet.filter("tails = 1")), unmet.filter("tails > 1")
    if not several.isEmpty():  # only these can meet a name twice
        by_name = by_name.unionAll(below(several).distinct())
    return by_path.join(first, ["request", "rung"]).select("request", "name", "rung").unionByName(by_name)
