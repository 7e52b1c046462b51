"""Queries of pages, typed paths, file dependents and attached lists."""

from pyspark.sql import functions as F

from veinway.operators import frontier, lookups, text
from veinway.plans.graph_queries import LIVE_SQL, live, seeds, walk_sql
from veinway.plans.graph_tables import GRAPH_SQL, edges, nodes, raw_edges, table
from veinway.plans.registry import query
from veinway.plans.table_queries import ITEMS_SQL, items


@query(f"WITH {ITEMS_SQL}, f AS (SELECT * FROM items WHERE state = 'open' AND severity = 'high' AND domain = 'BUILDING') SELECT o_orderkey, age_days, (SELECT count(*) FROM f) AS total FROM f ORDER BY age_days DESC, o_orderkey LIMIT 25 OFFSET 5")
def drift_filter(spark, sf_dir):
    found = lookups.items_where(items(spark, sf_dir), "open", "high", "BUILDING").select("o_orderkey", "age_days")
    return lookups.page(found, [F.desc("age_days"), F.asc("o_orderkey")], 25, 5)


@query("""WITH f AS (SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 20 DAY AND ts <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY AND event_type = 'purchase')
SELECT event_id, user_id, (SELECT count(*) FROM f) AS total FROM f ORDER BY event_id LIMIT 100 OFFSET 10""")
def audit_query(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0])
    found = lookups.entries_where(e, "ts", last - F.expr("INTERVAL 20 DAYS"), last - F.expr("INTERVAL 2 DAYS"), event_type="purchase", user_id=None)
    return lookups.page(found.select("event_id", "user_id"), [F.asc("event_id")], 100, 10)


SCOPE_SQL = "scope AS (SELECT id FROM nodes WHERE node_type <> 'Customer'), scoped AS (SELECT * FROM live WHERE src IN (SELECT id FROM scope) AND dst IN (SELECT id FROM scope))"
RANKED_SQL = """SELECT seed, node, CAST(depth AS INTEGER) AS depth, via, risk_score, via IN ('IMPLEMENTS_CONTRACT', 'HANDLES_ROUTE', 'CALLS') AS is_breaking FROM walk LEFT JOIN nodes ON id = node
ORDER BY is_breaking DESC, risk_score DESC NULLS LAST, depth, seed, node"""


@query(f"WITH RECURSIVE {GRAPH_SQL}, {LIVE_SQL}, {SCOPE_SQL}, {walk_sql("'Order'", 5, source='scoped')} {RANKED_SQL} LIMIT 200")
def typed_impact(spark, sf_dir):
    """Paths that never leave the scope: all nodes but customers; the 200 worst."""
    n = nodes(spark, sf_dir)
    found = lookups.scoped_walk(live(spark, sf_dir), n.filter("node_type <> 'Customer'"), seeds(spark, sf_dir, "Order"), 5)
    out = found.join(n.select(F.col("id").alias("node"), "risk_score"), "node", "left")
    return lookups.ranked_impact(out, 200).select("seed", "node", F.col("depth").cast("int").alias("depth"), "via", "risk_score", "is_breaking")


@query(f"WITH RECURSIVE {GRAPH_SQL}, {LIVE_SQL}, {walk_sql("'Region'", 5, ('dst', 'src')).replace("node_type IN ('Region')", "id = 'r:0'", 1)} SELECT seed, node, CAST(depth AS INTEGER) AS depth, via FROM walk")
def blast_radius_one(spark, sf_dir):
    """What depends on one node, five levels deep."""
    one = seeds(spark, sf_dir, "Region").filter("seed = 'r:0'")
    return frontier.walk(frontier.swapped(live(spark, sf_dir)), one, 5).select("seed", "node", F.col("depth").cast("int").alias("depth"), "via")


FILES_SQL = """file_of AS (SELECT id, CASE node_type WHEN 'Order' THEN 'order-' || CAST(CAST(substr(id, 3) AS BIGINT) % 500 AS VARCHAR) WHEN 'Part' THEN 'part-' || CAST(CAST(substr(id, 3) AS BIGINT) % 97 AS VARCHAR) ELSE id END AS file FROM nodes),
between_files AS (SELECT a.file AS src, b.file AS dst, min(etype) AS etype, max(confidence) AS confidence FROM edges JOIN file_of a ON a.id = src JOIN file_of b ON b.id = dst WHERE a.file <> b.file GROUP BY 1, 2),
hops AS (SELECT file AS seed, file, 0 AS hops FROM file_of WHERE file IN ('part-7', 'r:1') UNION SELECT h.seed, e.src, h.hops + 1 FROM hops h JOIN between_files e ON e.dst = h.file WHERE h.hops < 3)"""


@query(f"WITH RECURSIVE {GRAPH_SQL}, {FILES_SQL} SELECT seed, file, CAST(min(hops) AS INTEGER) AS hops FROM hops WHERE file NOT IN ('part-7', 'r:1') GROUP BY 1, 2")
def dependent_files(spark, sf_dir):
    number = F.substring("id", 3, 20).cast("long")
    file = F.when(F.col("node_type") == "Order", F.concat(F.lit("order-"), (number % 500).cast("string"))).when(F.col("node_type") == "Part", F.concat(F.lit("part-"), (number % 97).cast("string"))).otherwise(F.col("id"))
    file_of = nodes(spark, sf_dir).select("id", file.alias("file"))
    dirty = file_of.filter(F.col("file").isin("part-7", "r:1")).select("file").distinct()
    return lookups.dependent_files(edges(spark, sf_dir), file_of, dirty).withColumn("hops", F.col("hops").cast("int"))


@query(f"WITH {GRAPH_SQL} SELECT a.node_type AS src_type, b.node_type AS dst_type, etype, count(*) AS n FROM edges JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst GROUP BY ALL")
def edge_ends(spark, sf_dir):
    return lookups.edge_ends(raw_edges(spark, sf_dir), nodes(spark, sf_dir))


@query("""SELECT s_suppkey, s_name, coalesce(parts, '') AS parts FROM supplier LEFT JOIN (SELECT l_suppkey AS s_suppkey, string_agg(part, ',' ORDER BY part) AS parts FROM (SELECT DISTINCT l_suppkey, CAST(l_partkey AS VARCHAR) AS part FROM lineitem WHERE l_quantity >= 49) GROUP BY 1) USING (s_suppkey)""")
def entity_tables(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct()
    return lookups.with_lists(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), big, "s_suppkey", F.col("l_partkey").cast("string"), "parts")


@query("""SELECT p_partkey, coalesce(notes, '') AS notes FROM part LEFT JOIN (SELECT l_partkey AS p_partkey, string_agg(l_shipmode, ',' ORDER BY l_shipmode) AS notes FROM (SELECT DISTINCT l_partkey, l_returnflag || l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1) USING (p_partkey)""")
def attached_notes(spark, sf_dir):
    notes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat("l_returnflag", "l_linestatus").alias("note")).distinct()
    return lookups.with_lists(table(spark, sf_dir, "part").select("p_partkey"), notes, "p_partkey", F.col("note"), "notes")


@query(f"WITH {GRAPH_SQL} SELECT DISTINCT src AS caller, n.name AS target FROM edges JOIN nodes n ON n.id = dst WHERE etype = 'CALLS' AND n.name ILIKE '%e_%r%'")
def caller_files(spark, sf_dir):
    named = nodes(spark, sf_dir).filter(F.ilike("name", F.lit("%e_%r%"))).select(F.col("id").alias("dst"), F.col("name").alias("target"))
    return edges(spark, sf_dir).filter("etype = 'CALLS'").join(named, "dst").select(F.col("src").alias("caller"), "target").distinct()


@query("""WITH touched AS (SELECT DISTINCT l_partkey AS p_partkey FROM lineitem WHERE l_shipdate > (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY) SELECT p_partkey, p_name FROM part JOIN touched USING (p_partkey)""")
def touched_entities(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    last = F.lit(lines.agg(F.max("l_shipdate")).first()[0])
    touched = lines.filter(F.col("l_shipdate") > last - F.expr("INTERVAL 30 DAYS")).select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").join(touched, "p_partkey", "left_semi")


@query(f"WITH {GRAPH_SQL} SELECT id, count(src) AS test_count FROM nodes LEFT JOIN edges ON dst = id AND etype = 'OWNS' GROUP BY id")
def owned_counts(spark, sf_dir):
    """Edges of one type into every node, 0 where there is none."""
    n = edges(spark, sf_dir).filter("etype = 'OWNS'").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("test_count"))
    return nodes(spark, sf_dir).select("id").join(n, "id", "left").na.fill(0, ["test_count"])


@query(f"WITH {GRAPH_SQL}, d AS (SELECT dst AS id, count(*) AS n FROM edges GROUP BY 1) SELECT node_type AS file, CAST(sum(coalesce(n, 0)) AS BIGINT) AS in_degree, count(*) AS symbols FROM nodes LEFT JOIN d USING (id) GROUP BY 1")
def file_in_degree(spark, sf_dir):
    d = edges(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    joined = nodes(spark, sf_dir).join(d, "id", "left")
    return joined.groupBy(F.col("node_type").alias("file")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("in_degree"), F.count("*").alias("symbols"))


@query(f"WITH {GRAPH_SQL}, o AS (SELECT src AS id, count(DISTINCT dst) AS callees FROM edges GROUP BY 1), i AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM edges GROUP BY 1) SELECT id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM nodes LEFT JOIN i USING (id) LEFT JOIN o USING (id)")
def caller_counts(spark, sf_dir):
    e = edges(spark, sf_dir)
    o = e.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("callees"))
    i = e.groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers"))
    return nodes(spark, sf_dir).select("id").join(i, "id", "left").join(o, "id", "left").na.fill(0, ["callers", "callees"])


@query(f"""WITH {ITEMS_SQL} SELECT count(*) AS items, """ + ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in ("open", "acknowledged", "in_flight", "resolved", "waived")) + ", "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}_items" for s in ("critical", "high", "medium", "low")) + ", count(*) - count(*) FILTER (o_orderdate <= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY) AS delta FROM items")
def drift_snapshot(spark, sf_dir):
    rows = items(spark, sf_dir)
    last = F.lit(rows.agg(F.max("o_orderdate")).first()[0])
    return lookups.drift_snapshot(rows, rows.filter(F.col("o_orderdate") <= last - F.expr("INTERVAL 365 DAYS")))


@query(f"WITH {GRAPH_SQL} SELECT id, risk_score FROM nodes ORDER BY risk_score DESC NULLS LAST, id LIMIT 500")
def riskiest(spark, sf_dir):
    return nodes(spark, sf_dir).select("id", "risk_score").orderBy(F.desc_nulls_last("risk_score"), "id").limit(500)


LINKS = [("explicit", "c_custkey % 7 = 0", "0"), ("name", "c_custkey % 3 = 0", "0"), ("embedding", "c_custkey % 2 = 0", "CAST(70 + c_custkey % 20 AS DOUBLE) / 100"), ("human", "c_custkey % 11 = 0", "0")]
LINKS_SQL = " UNION ALL ".join(f"SELECT c_custkey AS left_id, c_custkey % 50 AS right_id, '{r}' AS rung, CAST({c} AS DOUBLE) AS cosine FROM customer WHERE {w}" for r, w, c in LINKS)


@query(f"""WITH links AS ({LINKS_SQL}), sure AS (SELECT *, CASE WHEN rung = 'human' THEN 1.0 WHEN rung = 'explicit' THEN 0.95 WHEN rung = 'name' THEN 0.82 WHEN rung = 'embedding' AND cosine >= 0.8 THEN least(cosine, 0.72) END::DOUBLE AS confidence FROM links)
SELECT left_id, right_id, max_by(rung, (confidence, rung)) AS rung, max(confidence) AS confidence, CASE WHEN max(confidence) >= 0.8 THEN 'auto' WHEN max(confidence) >= 0.6 THEN 'suggest' ELSE 'apart' END AS decision FROM sure WHERE confidence IS NOT NULL GROUP BY 1, 2""")
def entity_resolution(spark, sf_dir):
    c, links = table(spark, sf_dir, "customer"), None
    for rung, where, cosine in LINKS:
        rows = c.filter(where).select(F.col("c_custkey").alias("left_id"), (F.col("c_custkey") % 50).alias("right_id"), F.lit(rung).alias("rung"), F.expr(f"CAST({cosine} AS DOUBLE)").alias("cosine"))
        links = rows if links is None else links.unionByName(rows)
    return text.decided("left_id", "right_id", links)


CANDIDATES_SQL = """cand AS (
    SELECT 'c:' || c_custkey AS urn, 'Party ' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS title, CASE WHEN c_nationkey % 5 = 0 THEN 'd:' || (c_custkey // 3) END AS domain_urn FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'PARTY-' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '!', CASE WHEN s_nationkey % 5 = 0 THEN 'c:' || s_suppkey END FROM supplier)"""


@query(f"""WITH {CANDIDATES_SQL}, named AS (SELECT urn, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS norm FROM cand),
pairs AS (SELECT urn AS a, min(urn) OVER (PARTITION BY domain_urn) AS b, 'explicit' AS rung FROM cand WHERE domain_urn IS NOT NULL
    UNION ALL SELECT x.urn, y.urn, 'explicit' FROM cand x JOIN cand y ON x.domain_urn = y.urn
    UNION ALL SELECT urn, min(urn) OVER (PARTITION BY norm), 'name' FROM named WHERE norm <> '')
SELECT least(a, b) AS left_id, greatest(a, b) AS right_id, min(rung) AS rung, CASE min(rung) WHEN 'explicit' THEN 0.95 ELSE 0.82 END::DOUBLE AS confidence, 'auto' AS decision FROM pairs WHERE a <> b GROUP BY 1, 2""")
def resolution_candidates(spark, sf_dir):
    """Customers and suppliers with titles and some with the domain that they name."""
    title = lambda k, form: F.format_string(form, k)
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = c.select(
        F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("urn"), title("c_custkey", "Party %06d").alias("title"),
        F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("d:"), F.floor(F.col("c_custkey") / 3).cast("string"))).alias("domain_urn"),
    ).unionAll(s.select(
        F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")), title("s_suppkey", "PARTY-%06d!"), F.when(F.col("s_nationkey") % 5 == 0, F.concat(F.lit("c:"), F.col("s_suppkey").cast("string"))),
    ))
    return text.decided("left_id", "right_id", text.candidate_links(rows))
