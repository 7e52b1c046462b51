"""Queries for filters, rankings, batches and roll-ups."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.functions import scores
from veinway.operators import retrieval, selection, text, upserts
from veinway.plans.graph_tables import GRAPH_SQL, edges, nodes, table
from veinway.plans.registry import query


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'ste') OR contains(lower(p_name), 'an')")
def handler_candidates(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(selection.any_segment(F.col("p_name"), ["red", "STE", "an"])).select("p_partkey", "p_name")


@query("SELECT doc_id, source, n_chars FROM documents WHERE starts_with(source, 'src1')")
def files_below(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(F.col("source").startswith("src1")).select("doc_id", "source", "n_chars")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 5000")
def large_functions(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("n_chars >= 5000").select("doc_id", "n_chars")


@query("SELECT doc_id, substr(text, 1, 1500) AS text FROM documents")
def compressed_fields(spark, sf_dir):
    return selection.capped_fields(table(spark, sf_dir, "documents").select("doc_id", "text"), "review", "text")


@query(f"WITH {GRAPH_SQL} SELECT etype, src, dst FROM edges WHERE etype NOT IN ('CALLS', 'OWNS')")
def taxonomy_violations(spark, sf_dir):
    return selection.unknown_types(edges(spark, sf_dir), ["CALLS", "OWNS"]).select("etype", "src", "dst")


@query(f"WITH {GRAPH_SQL} SELECT node_type, count(*) AS n, count(risk_score) AS scored, round(avg(risk_score), 4) AS mean_risk FROM nodes GROUP BY 1")
def node_counts(spark, sf_dir):
    return nodes(spark, sf_dir).groupBy("node_type").agg(F.count("*").alias("n"), F.count("risk_score").alias("scored"), F.round(F.avg("risk_score"), 4).alias("mean_risk"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, o_orderpriority AS owner, CAST(o_totalprice / 400 AS INTEGER) AS size FROM orders),
g AS (SELECT *, CASE WHEN lag(owner) OVER w IS NULL OR lag(owner) OVER w <> owner OR size >= 800 OR coalesce(lag(size) OVER w >= 800, FALSE) THEN 1 ELSE 0 END AS new FROM c WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT o_custkey, o_orderkey, CAST(island AS BIGINT) || '.' || CAST((row_number() OVER (PARTITION BY o_custkey, island ORDER BY o_orderkey) - 1) // 8 AS BIGINT) AS batch FROM i""")
def chunk_batches(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderpriority").alias("owner"), F.round(F.col("o_totalprice") / 400).cast("int").alias("size"))
    return selection.class_batches(c, ["o_custkey", "o_orderkey"], "owner", "size").select("o_custkey", "o_orderkey", "batch")


@query("""SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice * exp(-date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) / 30.0) DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 200""")
def few_shot_bank(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    last = F.lit(o.agg(F.max("o_orderdate")).first()[0])
    return selection.keep_best(o, "o_custkey", F.col("o_totalprice"), F.datediff(last, "o_orderdate"), "o_orderkey").select("o_custkey", "o_orderkey", "place")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 WHEN 'P' THEN 3 ELSE 9 END AS role FROM orders),
f AS (SELECT *, role < 9 AND row_number() OVER (PARTITION BY o_custkey, role ORDER BY o_orderdate, o_orderkey) = 1 AS first FROM r)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY first DESC, CASE WHEN first THEN role ELSE 0 END, o_orderdate, o_orderkey) AS INTEGER) AS position FROM f QUALIFY position <= 5""")
def onboarding_path(spark, sf_dir):
    role = F.when(F.col("o_orderstatus") == "F", "controller").when(F.col("o_orderstatus") == "O", "service").when(F.col("o_orderstatus") == "P", "repository").otherwise("")
    return selection.one_per_role(table(spark, sf_dir, "orders"), "o_custkey", role, "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "position")


@query("""WITH e AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS expected, list(DISTINCT CASE WHEN l_discount <= 0.05 THEN l_partkey END) AS found FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(len(list_intersect(expected, list_filter(found, lambda x: x IS NOT NULL))) / len(expected), 4) AS recall FROM e""")
def golden_recall(spark, sf_dir):
    cases = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("expected"), F.collect_set(F.when(F.col("l_discount") <= 0.05, F.col("l_partkey"))).alias("found"))
    return selection.recall(cases, "expected", "found").select("l_orderkey", F.round("recall", 4).alias("recall"))


@query("SELECT user_id, round(count(DISTINCT event_type) / count(event_type), 4) AS diversity FROM events GROUP BY 1")
def source_diversity(spark, sf_dir):
    return selection.source_diversity(table(spark, sf_dir, "events"), "user_id", "event_type")


@query("""WITH r AS (SELECT '/users/' || user_id || '/' || event_type AS path, CASE WHEN value > 50 THEN 'POST' ELSE 'GET' END AS method FROM events),
n AS (SELECT path, method, regexp_replace(path, '/[0-9]+/', '/{}/') AS norm FROM r), c AS (SELECT DISTINCT norm FROM n WHERE norm LIKE '%/c%' OR norm LIKE '%/v%')
SELECT path, method, CASE WHEN c.norm IS NULL THEN 'path_mismatch' ELSE 'method_mismatch' END AS kind, CASE WHEN c.norm IS NULL THEN 'warning' ELSE 'breaking' END AS severity, CAST(CASE WHEN c.norm IS NULL THEN 0.75 ELSE 0.8 END AS DOUBLE) AS confidence
FROM n LEFT JOIN c ON n.norm = c.norm WHERE c.norm IS NULL OR method <> 'GET'""")
def route_drift(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("/users/"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_type"))
    routes = e.select(path.alias("path"), F.when(F.col("value") > 50, "POST").otherwise("GET").alias("method"))
    contracts = e.filter(F.col("event_type").rlike("^[cv]")).select(F.concat(F.lit("/users/{id}/"), "event_type").alias("path"), F.lit("GET").alias("method")).distinct()
    return selection.route_drift(routes, contracts)


@query("""WITH p AS (SELECT * FROM (VALUES ('click', 2.0, 4.0), ('view', 0.5, 1.0)) t(model, i, o)),
c AS (SELECT event_type AS model, value * 1000 AS tin, value * 10 AS tout FROM events)
SELECT model, round(sum((tin * coalesce(i, 1.0) + tout * coalesce(o, 3.0)) / 1000000), 6) AS cost, count(*) AS calls FROM c LEFT JOIN p USING (model) GROUP BY model""")
def cost_by_model(spark, sf_dir):
    prices = spark.createDataFrame([("click", 2.0, 4.0), ("view", 0.5, 1.0)], "model string, input_rate double, output_rate double")
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("value") * 1000).alias("tokens_in"), (F.col("value") * 10).alias("tokens_out"))
    return selection.with_price(calls, prices).groupBy("model").agg(F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls"))


@query("SELECT * FROM (SELECT split_part(url, '/', 3) AS host, count(*) AS pages, round(avg(length(html)), 2) AS mean_size FROM pages GROUP BY 1 ORDER BY pages DESC, host LIMIT 20)")
def package_rollup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").groupBy(F.split_part("url", F.lit("/"), F.lit(3)).alias("host")).agg(F.count("*").alias("pages"), F.round(F.avg(F.length("html")), 2).alias("mean_size"))
    return p.orderBy(F.desc("pages"), "host").limit(20)


@query("""WITH h AS (SELECT p_partkey, substr(sha256(p_name || p_brand), 1, 16) AS now, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'x' ELSE substr(sha256(p_name || p_brand), 1, 16) END AS was FROM part)
SELECT p_partkey FROM h WHERE was IS NULL OR was <> now""")
def symbol_changes(spark, sf_dir):
    now = table(spark, sf_dir, "part").select("p_partkey", "p_size", scores.symbol_hash(F.concat("p_name", "p_brand")).alias("h"))
    was = now.filter("p_size % 4 <> 0").withColumn("h", F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("h")))
    return upserts.changed_hashes(was, now, "p_partkey", "h")


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1), o AS (SELECT l_orderkey, round(len(list_intersect(flags, ['A', 'N'])) / greatest(len(flags), 2), 4) AS alike FROM s)
SELECT l_orderkey, alike FROM o WHERE alike >= 0.5""")
def shape_match(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
    return s.select("l_orderkey", F.round(text.shape_overlap(F.col("flags"), F.array(F.lit("A"), F.lit("N"))), 4).alias("alike")).filter("alike >= 0.5")


# The kinds of tasks in the order in which they are tried.
TASKS = [
    (r"(?i)\b(explain the whole|overview|how does the (system|codebase)|onboard|tour)\b", "onboard"),
    (r"(?i)\b(review|check|is .* safe|what uses|who calls|impact|blast radius)\b", "audit"),
    (r"(?i)\b(error|bug|failing|why is|broken|crash|exception|stack trace)\b", "debug"),
    (r"(?i)\b(change|modify|add|refactor|implement|fix|update|extend)\b", "write"),
    (r"(?i)\b(what does|explain|how does|describe|summari[sz]e|what is)\b", "read"),
]
#: Tasks made from part names, one form for each key modulo 7.
ASKED = ["explain the whole {}", "Who calls {}?", "{} is failing", "refactor {}", "what is {}", "is {} safe to change", "{}"]
ASKED_SQL = "asked AS (SELECT p_partkey, CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN replace('{f}', '{{}}', p_name)" for i, f in enumerate(ASKED)) + " END AS task FROM part)"


@query(f"WITH {ASKED_SQL} SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(task, '{p}') THEN '{k}'" for p, k in TASKS) + " ELSE 'read' END AS kind FROM asked")
def task_classifier(spark, sf_dir):
    task = F.lit(None).cast("string")
    for i, form in enumerate(ASKED):
        task = F.when(F.col("p_partkey") % 7 == i, F.replace(F.lit(form), F.lit("{}"), F.col("p_name"))).otherwise(task)
    return table(spark, sf_dir, "part").select("p_partkey", retrieval.classify(task, TASKS, "read").alias("kind"))


#: Lines of programs made from part names, one form for each key modulo 8.
PROGRAMS = ["@app.get('/{}')", "@KafkaListener {}", "func ServeHTTP (w) {}", "def handle_it(x): {}", "public void processOrder ({})", "job = {}", "# handler {}", "router.post ('{}')"]


@query("SELECT p_partkey FROM part WHERE p_partkey % 8 NOT IN (5, 6)")
def entry_points(spark, sf_dir):
    """Names that only look like ways in ("job", "# handler") are none."""
    line = F.lit(None).cast("string")
    for i, form in enumerate(PROGRAMS):
        line = F.when(F.col("p_partkey") % 8 == i, F.replace(F.lit(form), F.lit("{}"), F.col("p_name"))).otherwise(line)
    return table(spark, sf_dir, "part").filter(selection.is_entry_point(line)).select("p_partkey")


@query("""WITH w AS (SELECT source, p.weight, CAST(greatest(floor(weight / sum(weight) OVER () * 6000), 20) AS BIGINT) AS share, CAST(sum(greatest(floor(weight / total * 6000), 20)) OVER () AS BIGINT) AS every FROM (SELECT source, sum(n_chars) AS weight, sum(sum(n_chars)) OVER () AS total FROM documents GROUP BY 1) p)
SELECT source, CASE WHEN every > 6000 THEN CAST(floor(share * 6000 / every) AS BIGINT) ELSE share END AS share FROM w""")
def budget_allocation(spark, sf_dir):
    w = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("weight")).withColumn("all", F.lit(1))
    return retrieval.allocate(w, ["all"], "weight", 6000).select("source", F.col("share").cast("long").alias("share"))


@query("SELECT conv_id, max(turn) AS last_turn, count(*) AS turns, count(*) FILTER (role = 'user') AS asked FROM conversations GROUP BY conv_id")
def conversation_list(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"))


@query("""SELECT user_id, date_diff('second', max(ts), (SELECT max(ts) FROM events)) > 86400 AS stale FROM events GROUP BY 1""")
def freshness(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0])
    return e.groupBy("user_id").agg((F.timestamp_diff("SECOND", F.max("ts"), last) > 86400).alias("stale"))


@query("""SELECT doc_id, entities FROM (SELECT doc_id, source, n_chars, CAST(row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS INTEGER) AS entities FROM documents) WHERE entities <= 60""")
def relevant_entities(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").withColumn("entities", F.row_number().over(w)).filter("entities <= 60").select("doc_id", "entities")
