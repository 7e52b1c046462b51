"""Queries for versions, guards and routing."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.operators import governance, versions
from veinway.plans.graph_tables import GRAPH_SQL, edges, nodes, table
from veinway.plans.registry import query


@query("""SELECT urn, CASE WHEN valid_to IS NULL AND urn LIKE 'brand:Brand#1%' THEN TIMESTAMP '2020-01-01' ELSE valid_to END AS valid_to
FROM (SELECT 'brand:' || p_brand || ':' || p_partkey AS urn, CASE WHEN p_size % 2 = 0 THEN TIMESTAMP '2019-01-01' END AS valid_to FROM part)""")
def invalidate_prefix(spark, sf_dir):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("brand:"), "p_brand", F.lit(":"), F.col("p_partkey").cast("string")).alias("urn"), F.when(F.col("p_size") % 2 == 0, at("2019-01-01")).alias("valid_to"))
    return versions.invalidated(rows, "brand:Brand#1", at("2020-01-01"))


@query("""WITH one AS (SELECT l_suppkey AS k, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09 GROUP BY 1 HAVING count(*) = 1) SELECT s_suppkey AS k, s_name, l_orderkey FROM supplier JOIN one ON k = s_suppkey""")
def unique_guard(spark, sf_dir):
    right = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.09").select(F.col("l_suppkey").alias("k"), "l_orderkey")
    return versions.resolve_unique(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name"), right, "k")


@query("SELECT l_partkey, count(DISTINCT l_returnflag) AS buckets FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) >= 2")
def ambiguous_terms(spark, sf_dir):
    return versions.ambiguous(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'critical' WHEN 'O' THEN 'high' ELSE 'medium' END AS severity FROM orders")
def check_severity(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "F", "breaking").when(F.col("o_orderstatus") == "O", "warning").otherwise("other")
    return table(spark, sf_dir, "orders").select("o_orderkey", versions.severity_of(kind).alias("severity"))


@query("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 16 AS batch FROM events")
def batch_plan(spark, sf_dir):
    return versions.numbered_batches(table(spark, sf_dir, "events"), "user_id", "event_id", 16).select("event_id", "user_id", "batch")


@query("""WITH f AS (SELECT *, n_chars < 1000 AS near FROM documents), a AS (SELECT *, near AND row_number() OVER (PARTITION BY source, near ORDER BY n_chars, doc_id) <= 3 AS t2 FROM f)
SELECT doc_id, CASE WHEN t2 THEN 'T2' WHEN row_number() OVER (PARTITION BY source, t2 ORDER BY n_chars, doc_id) <= 10 THEN 'T1' ELSE 'T0' END AS tier FROM a""")
def context_tiers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return versions.context_tiers(d, "source", F.col("n_chars") < 1000, [F.asc("n_chars"), F.asc("doc_id")]).select("doc_id", "tier")


@query(f"""WITH {GRAPH_SQL}, e AS (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) SELECT node_type AS file, count(*) AS edges FROM e JOIN nodes USING (id) GROUP BY 1""")
def file_edge_counts(spark, sf_dir):
    return versions.endpoints_count(edges(spark, sf_dir), nodes(spark, sf_dir).select("id", F.col("node_type").alias("file")))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR) AS added, round(sum(value), 2) AS cost FROM events GROUP BY 1")
def status_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts") > last - F.expr("INTERVAL 24 HOURS")).alias("added"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 2).alias("cost"))


@query("""SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value >= 80 THEN 1 WHEN value >= 55 THEN 2 ELSE 3 END, ts DESC, event_id) AS INTEGER) AS place FROM events""")
def context_order(spark, sf_dir):
    label = F.when(F.col("value") >= 80, 1).when(F.col("value") >= 55, 2).otherwise(3)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(label, F.desc("ts"), "event_id"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", place.alias("place"))


STATES = ["open", "acknowledged", "in_flight", "resolved", "waived"]
KNOWN_SQL = ", ".join(f"('{a}', '{b}')" for a, b in governance.TRANSITIONS)


@query(f"""WITH s AS (SELECT user_id, event_id, list_extract({STATES}, CAST(event_id * 7 % 11 % 5 + 1 AS INTEGER)) AS to_state FROM events),
m AS (SELECT to_state, lag(to_state) OVER (PARTITION BY user_id ORDER BY event_id) AS from_state FROM s)
SELECT from_state, to_state, count(*) AS moves FROM m WHERE from_state IS NOT NULL AND (from_state, to_state) NOT IN (VALUES {KNOWN_SQL}) GROUP BY ALL""")
def illegal_moves(spark, sf_dir):
    """States by event number: moves that the state machine knows are left out, all others are counted."""
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") * 7 % 11 % 5 + 1).cast("int"))
    before = F.lag("to_state").over(Window.partitionBy("user_id").orderBy("event_id"))
    moves = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("to_state")).withColumn("from_state", before).filter("from_state IS NOT NULL")
    return governance.illegal_transitions(moves.select("from_state", "to_state")).groupBy("from_state", "to_state").agg(F.count("*").alias("moves"))


@query("""WITH c AS (SELECT user_id, max(event_id) FILTER (event_type = 'purchase') AS known FROM events GROUP BY 1) SELECT user_id, count(DISTINCT event_id) AS newer FROM events JOIN c USING (user_id) WHERE event_id > known GROUP BY 1""")
def newer_commits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    known = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("known"))
    return e.join(known, "user_id").filter("event_id > known").groupBy("user_id").agg(F.count_distinct("event_id").alias("newer"))


@query("""SELECT p_partkey, list_extract(['What breaks if {} changes?', 'Who owns {}?', 'What calls {}?', 'How risky is {}?'], CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) % 4 + 1 AS INTEGER)) AS template
FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 4)""")
def suggested_questions(spark, sf_dir):
    templates = ["What breaks if {} changes?", "Who owns {}?", "What calls {}?", "How risky is {}?"]
    return versions.with_template(table(spark, sf_dir, "part"), [F.desc("p_retailprice"), F.asc("p_partkey")], templates, 4).select("p_partkey", "template")
