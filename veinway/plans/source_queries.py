"""Queries that read source material (blame output, interface documents) written for the rows of the sales tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.operators import source_edges
from veinway.plans.graph_tables import spread, table
from veinway.plans.registry import query
from veinway.sources import blame, openapi


def porcelain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, n, raw): a file for each supplier with a line for each of its order lines, committed by the order's customer.

    A commit says its author where it comes first in a file, and not again.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    firsts = lines.groupBy("l_suppkey", "l_orderkey").agg(F.min("l_linenumber").alias("first"))
    people = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderdate")
    rows = lines.join(firsts, ["l_suppkey", "l_orderkey"]).join(people, F.col("l_orderkey") == F.col("o_orderkey"))
    digest = F.md5(F.col("l_orderkey").cast("string"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)").cast("string")
    header = F.concat(digest, F.left(digest, F.lit(8)), F.lit(" "), F.col("l_linenumber").cast("string"), F.lit(" 1"))
    said = F.array(
        F.concat(F.lit("author "), "c_name"), F.concat(F.lit("author-mail <"), F.lower("c_name"), F.lit("@mail>")), F.concat(F.lit("author-time "), seconds),
        F.concat(F.lit("summary author of "), "c_name"),
    )
    none = F.array().cast("array<string>")
    source = F.concat(F.lit("\tauthor line "), F.col("l_linenumber").cast("string"))
    raws = F.concat(F.array(header), F.when(F.col("l_linenumber") == F.col("first"), said).otherwise(none), F.array(source))
    out = rows.select(F.concat(F.lit("src/"), F.col("l_suppkey").cast("string")).alias("file"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber") * 10).alias("at"), F.posexplode(raws).alias("pos", "raw"))
    return out.select("file", (F.col("at") + F.col("pos")).alias("n"), "raw")


@query("""SELECT 'src/' || l_suppkey AS file, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS INTEGER) AS line_no, c_name AS author,
lower(c_name) || '@mail' AS author_mail, md5(CAST(l_orderkey AS VARCHAR)) || left(md5(CAST(l_orderkey AS VARCHAR)), 8) AS commit_sha,
CAST(date_diff('second', TIMESTAMP '1970-01-01 00:00:00', date_trunc('second', o_orderdate)) AS BIGINT) AS commit_time, 'author line ' || l_linenumber AS content
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def blame_porcelain(spark, sf_dir):
    return blame.blame_lines(porcelain(spark, sf_dir)).withColumn("commit_time", F.unix_timestamp("commit_time"))


DOCUMENT = """{"openapi": "3.1.0", "paths": {"/customers/%d": {
"get": {"operationId": "get_%d", "tags": ["%s"], "parameters": [{"name": "id", "in": "path", "required": true}, {"$ref": "#/components/parameters/Page"}, {"$ref": "#/components/parameters/Lost"}],
 "responses": {"200": {"content": {"text/plain": {"schema": {"type": "string"}}, "application/json": {"schema": {"type": "array", "items": {"$ref": "#/components/schemas/Customer"}}}}}, "default": {"schema": {"$ref": "#/definitions/Error"}}}},
"put": {"requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Customer"}}}}, "responses": {"204": {}, "404": {"schema": {"$ref": "#/definitions/Error"}}}},
"x-note": {"get": {}}}},
"components": {"parameters": {"Page": {"name": "page", "in": "query"}}, "schemas": {
 "Customer": {"required": ["id"], "properties": {"id": {"type": "integer"}, "nation": {"$ref": "#/components/schemas/Nation_%d"}, "orders": {"type": "array", "items": {"$ref": "#/components/schemas/Order"}}}},
 "Order": {"allOf": [{"$ref": "#/components/schemas/%s"}, {"type": "object"}], "properties": {"owner": {"$ref": "#/components/schemas/Customer"}}}, "AUTOMOBILE": {"type": "string"}, "BUILDING": true}},
"definitions": {"Error": {"type": "object"}, "Order": {"type": "string"}}}"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, content): an interface document for each customer."""
    c = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), "c_custkey")
    return c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("file"), F.format_string(DOCUMENT, "c_custkey", "c_custkey", "c_mktsegment", "c_nationkey", "c_mktsegment").alias("content"))


@query("""SELECT 'c:' || c_custkey AS file, '/customers/' || c_custkey AS path, method, role, code, ref FROM customer, (VALUES
('GET', 'response', 200, '#/components/schemas/Customer'), ('PUT', 'request', NULL, '#/components/schemas/Customer'), ('PUT', 'response', 404, '#/definitions/Error')) v(method, role, code, ref)""")
def openapi_payloads(spark, sf_dir):
    return openapi.payloads(openapi.operations(openapi.parsed(documents(spark, sf_dir))))


@query("""SELECT 'c:' || c_custkey AS file, '/customers/' || c_custkey AS path, 'GET' AS method, 'get_' || c_custkey AS operation_id, c_mktsegment AS tag, name, place, required FROM customer, (VALUES
('id', 'path', true), ('page', 'query', false), ('Lost', NULL, false)) v(name, place, required)""")
def openapi_parameters(spark, sf_dir):
    docs = openapi.parsed(documents(spark, sf_dir))
    ops = openapi.operations(docs)
    found = openapi.parameters(docs, ops)
    return found.join(ops.select("file", "path", "method", "operation_id", F.col("tags")[0].alias("tag")), ["file", "path", "method"])


@query("""WITH s AS (SELECT 'c:' || c_custkey AS file, 'Nation_' || c_nationkey AS nation, c_mktsegment AS segment FROM customer), r AS (
    SELECT file, 'Customer' AS name, nation AS target, 1 AS depth FROM s UNION ALL SELECT file, 'Customer', 'Order', 1 FROM s UNION ALL SELECT file, 'Customer', segment, 2 FROM s UNION ALL SELECT file, 'Customer', 'Customer', 2 FROM s
    UNION ALL SELECT file, 'Order', segment, 1 FROM s UNION ALL SELECT file, 'Order', 'Customer', 1 FROM s UNION ALL SELECT file, 'Order', nation, 2 FROM s UNION ALL SELECT file, 'Order', 'Order', 2 FROM s)
SELECT *, target NOT IN ('Customer', 'Order', 'AUTOMOBILE', 'Error') AS missing, name = target AS cyclic FROM r""")
def openapi_references(spark, sf_dir):
    return openapi.resolved(openapi.schemas(openapi.parsed(documents(spark, sf_dir))))


@query("""WITH e AS (SELECT 'c:' || c_custkey AS endpoint, '/customers/' || c_custkey AS path, c_custkey % 4 AS kind FROM customer)
SELECT endpoint AS file, CASE WHEN kind = 1 THEN '' ELSE 'get_' || substr(endpoint, 3) END AS operation_id, path, CASE WHEN kind = 1 THEN 'PUT' ELSE 'GET' END AS method, endpoint FROM e WHERE kind < 3""")
def documented_endpoints(spark, sf_dir):
    """An endpoint for each customer, written in four ways, of which the last is a method that no document has."""
    key = F.col("c_custkey")
    form = F.when(key % 4 == 0, F.format_string("GET  /customers//%d/", key)).when(key % 4 == 1, F.format_string('@PutMapping("/customers/%d")', key)).when(key % 4 == 2, F.format_string("get /customers/%d", key)).otherwise(F.format_string("DELETE /customers/%d", key))
    endpoints = table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), key.cast("string")).alias("id"), form.alias("signature"))
    return source_edges.documented(openapi.operations(openapi.parsed(documents(spark, sf_dir))), endpoints)


UNITS = {
    "java": "package a.b;\npublic class Order%d {\n  @Autowired private Supplier%d mine;\n  private final Part%d part;\n  public Order%d(Supplier%d mine, @Named Part%d part, Customer%d who) { }\n}",
    "ts": "import { Supplier%2$d, Part%3$d } from './all'\nexport class Order%1$d { constructor(private readonly s: Supplier%2$d, public c: Customer%7$d) {} }",
    "py": "from shop import Part%3$d as P, Supplier%2$d\nclass Order%1$d:\n    def __init__(self):\n        self.s = Supplier%2$d()\n        self.p = Part%3$d()\n        self.c = Customer%7$d()",
}


@query("""WITH l AS (SELECT o_orderkey AS k, any_value(o_custkey) AS c, min(l_suppkey) AS s, max(l_partkey) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'o:' || k AS src, 's:' || s AS dst, CASE k % 3 WHEN 0 THEN 0.95 WHEN 1 THEN 0.85 ELSE 0.8 END::DOUBLE AS confidence,
    CASE k % 3 WHEN 0 THEN '@Autowired Supplier' || s || ' mine' WHEN 1 THEN 'field Supplier' || s || ' s' ELSE 'self Supplier' || s || ' s' END AS evidence FROM l
UNION ALL SELECT 'o:' || k, 'p:' || p, CASE k % 3 WHEN 0 THEN 0.88 ELSE 0.8 END::DOUBLE, CASE k % 3 WHEN 0 THEN 'private final Part' || p || ' part' ELSE 'self Part' || p || ' p' END FROM l WHERE k % 3 <> 1
UNION ALL SELECT 'o:' || k, 'c:' || c, 0.85::DOUBLE, 'constructor Customer' || c || ' who' FROM l WHERE k % 3 = 0""")
def injection_edges(spark, sf_dir):
    """A class for each order in one of three languages, with its supplier, part and customer; only what is imported counts in two of them."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s"), F.max("l_partkey").alias("p"))
    rows = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).withColumnRenamed("o_orderkey", "k").withColumnRenamed("o_custkey", "c")
    values = ("k", "s", "p", "k", "s", "p", "c")
    kind = F.when(F.col("k") % 3 == 0, "java").when(F.col("k") % 3 == 1, "ts").otherwise("py")
    content = F.when(kind == "java", F.format_string(UNITS["java"], *values)).when(kind == "ts", F.format_string(UNITS["ts"], *values)).otherwise(F.format_string(UNITS["py"], *values))
    units = rows.select(F.concat(F.lit("src/Order"), F.col("k").cast("string"), F.lit("."), kind).alias("file_path"), content.alias("content"))
    entity = lambda n, column, name, prefix: t(n).select(F.concat(F.lit(name), F.col(column).cast("string")).alias("name"), F.concat(F.lit(prefix), F.col(column).cast("string")).alias("external_id"))
    entities = entity("orders", "o_orderkey", "shop.Order", "o:").unionAll(entity("supplier", "s_suppkey", "Supplier", "s:")).unionAll(entity("part", "p_partkey", "x.y.Part", "p:")).unionAll(entity("customer", "c_custkey", "Customer", "c:"))
    return source_edges.injected(units, entities)
