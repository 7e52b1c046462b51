"""Queries over the sales, event, document, vector and conversation tables."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.functions import scores
from veinway.operators import events, governance, ownership, privacy, retrieval, selection, text, upserts
from veinway.plans.graph_tables import table
from veinway.plans.registry import query
from veinway.streaming import trailing

SEVERITIES = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}
ITEMS_SQL = """items AS (
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
        CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_flight' ELSE 'resolved' END AS state,
        CAST(date_diff('day', o_orderdate, (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS age_days, c_mktsegment AS domain, o_totalprice / 100000 AS remediation_days, o_orderdate
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey)"""


def items(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    last = F.lit(orders.agg(F.max("o_orderdate")).first()[0])
    severity = F.lit("low")
    for k, v in SEVERITIES.items():
        severity = F.when(F.col("o_orderpriority") == k, v).otherwise(severity)
    state = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_flight").otherwise("resolved")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        "o_orderkey", severity.alias("severity"), state.alias("state"), F.datediff(last, "o_orderdate").cast("double").alias("age_days"),
        F.array_compact(F.array("c_mktsegment")).alias("domains"), (F.col("o_totalprice") / 100000).alias("remediation_days"), "o_orderdate",
    )


@query(f"""WITH {ITEMS_SQL} SELECT coalesce(domain, 'unattributed') AS domain, count(*) AS items,
    round(sum(CASE severity WHEN 'critical' THEN 8 WHEN 'high' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END * (1 + greatest(0, (age_days - 90) / 90.0))), 2) AS score,
    count(*) FILTER (severity = 'critical') AS critical, max(age_days) AS oldest, round(sum(CASE WHEN state = 'in_flight' THEN remediation_days ELSE 0 END), 2) AS in_flight_days
    FROM items WHERE remediation_days <= 4 GROUP BY 1""")
def drift_domain_scores(spark, sf_dir):
    """Items of more than four days of work are waived."""
    state = F.when(F.col("remediation_days") > 4, "waived").otherwise(F.col("state"))
    return governance.drift_domains(items(spark, sf_dir).withColumn("state", state))


@query(f"""WITH {ITEMS_SQL}, split AS (SELECT (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY AS t),
was AS (SELECT DISTINCT domain || severity || CAST(age_days % 97 AS INTEGER) AS id FROM items, split WHERE o_orderdate <= t),
now AS (SELECT DISTINCT domain || severity || CAST(age_days % 97 AS INTEGER) AS id FROM items, split WHERE o_orderdate > t)
SELECT coalesce(was.id, now.id) AS id, CASE WHEN was.id IS NULL THEN 'opened' WHEN now.id IS NULL THEN 'resolved' ELSE 'bumped' END AS change FROM was FULL JOIN now ON was.id = now.id""")
def drift_changes(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("id", F.concat(F.col("domains")[0], "severity", (F.col("age_days") % 97).cast("int").cast("string")))
    t = rows.agg(F.max("o_orderdate")).first()[0]
    cut = F.lit(t) - F.expr("INTERVAL 365 DAYS")
    return governance.drift_changes(rows.filter(F.col("o_orderdate") <= cut), rows.filter(F.col("o_orderdate") > cut), "id")


LINES_SQL = "counted AS (SELECT l_partkey, l_suppkey, count(*) AS lines FROM lineitem GROUP BY ALL), shares AS (SELECT *, round(lines / sum(lines) OVER (PARTITION BY l_partkey), 4) AS share, CAST(row_number() OVER (PARTITION BY l_partkey ORDER BY lines DESC, l_suppkey) AS INTEGER) AS place FROM counted)"


@query(f"WITH {LINES_SQL} SELECT l_partkey, count(*) AS authors, count(*) FILTER (share >= 0.1) AS bus_factor, max(CASE WHEN place = 1 THEN l_suppkey END) AS primary_author FROM shares GROUP BY l_partkey")
def ownership_bus_factor(spark, sf_dir):
    return ownership.bus_factor(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query(f"WITH {LINES_SQL}, top AS (SELECT * FROM shares WHERE place <= 3) SELECT *, greatest(1, count(*) FILTER (share >= 0.2) OVER (PARTITION BY l_partkey)) AS bus_factor FROM top")
def owners_top3(spark, sf_dir):
    return ownership.owners(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query(f"""WITH {LINES_SQL}, t AS (SELECT max(l_shipdate) AS d FROM lineitem),
lead AS (SELECT l_partkey, max(CASE WHEN place = 1 THEN share END) AS f, max(CASE WHEN place = 2 THEN share END) AS s, max(CASE WHEN place = 1 THEN l_suppkey END) AS owner FROM shares GROUP BY 1),
churn AS (SELECT l_partkey, count(*) FILTER (date_diff('day', CAST(l_shipdate AS DATE), CAST(d AS DATE)) <= 30) AS c30 FROM lineitem, t GROUP BY 1),
quiet AS (SELECT l_partkey, l_suppkey AS owner, date_diff('day', CAST(max(l_shipdate) AS DATE), CAST(max(d) AS DATE)) AS q FROM lineitem, t GROUP BY 1, 2),
j AS (SELECT * FROM lead JOIN churn USING (l_partkey) JOIN quiet USING (l_partkey, owner))
SELECT l_partkey, 'bus_factor_one' AS alert, 'HIGH' AS severity FROM j WHERE f > 0.70 AND coalesce(s, 0) < 0.10
UNION ALL SELECT l_partkey, 'high_churn', CASE WHEN c30 >= 10 THEN 'HIGH' ELSE 'MEDIUM' END FROM j WHERE c30 > 5
UNION ALL SELECT l_partkey, 'stale_owner_left', 'MEDIUM' FROM j WHERE q >= 90""")
def risk_alerts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return ownership.risk_alerts(lines, "l_partkey", "l_suppkey", "l_shipdate", F.lit(lines.agg(F.max("l_shipdate")).first()[0]))


@query("""WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT event_id, user_id, CAST(sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g""")
def gap_clusters(spark, sf_dir):
    return ownership.gap_clusters(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6).select("event_id", "user_id", "cluster")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS callers, CAST(round(least(0.95, 0.6 + 0.05 * (count(DISTINCT l_suppkey) - 5)), 2) AS DOUBLE) AS confidence FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 5")
def idiom_shared_callee(spark, sf_dir):
    return ownership.idioms(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


@query("""WITH f AS (SELECT *, l_quantity > 8 AS flag FROM lineitem), a AS (SELECT *, avg(CASE WHEN flag THEN 1.0 ELSE 0.0 END) OVER w AS adoption, count(*) OVER w AS population FROM f WINDOW w AS (PARTITION BY l_partkey))
SELECT l_orderkey, l_linenumber, l_partkey, round(adoption, 4) AS adoption, population FROM a WHERE adoption >= 0.8 AND population >= 5 AND NOT flag""")
def antipattern_minority(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("flag", F.col("l_quantity") > 8)
    return ownership.minority(rows, "l_partkey", "flag").select("l_orderkey", "l_linenumber", "l_partkey", "adoption", "population")


@query("SELECT user_id, count(*) AS event_count, max(ts) AS ts, max_by(event_type, (ts, event_id)) AS event_type, round(max_by(value, (ts, event_id)), 4) AS value FROM events GROUP BY 1")
def entity_state_latest(spark, sf_dir):
    out = events.latest_state(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", ["event_type", "value"])
    return out.withColumn("value", F.round("value", 4))


@query("SELECT event_id, user_id, ts, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def event_replay(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0])
    return events.replay(e, "user_id", "ts", last - F.expr("INTERVAL 7 DAYS"), last).select("event_id", "user_id", "ts", "event_type")


@query("""SELECT event_id, round(greatest(0, least(1, 0.5 * exp(-ln(2) * (epoch((SELECT max(ts) FROM events)) - epoch(ts)) / 86400 / 90)
    + 0.3 * least(value / 100, 1) + CASE WHEN (epoch((SELECT max(ts) FROM events)) - epoch(ts)) / 86400 <= 7 THEN 0.2 ELSE 0 END)), 4) AS salience FROM events""")
def salience(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    last = F.lit(e.agg(F.max("ts")).first()[0])
    age = F.timestamp_diff("MICROSECOND", F.col("ts"), last) / 86_400_000_000.0
    no = F.lit(False)
    return e.select("event_id", scores.salience(F.lit(0.5), age, F.least(F.col("value") / 100, F.lit(1.0)), no, no).alias("salience"))


CHAIN_SQL = """e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, concat_ws('|', CAST(event_id AS VARCHAR), event_type, props) AS body FROM events),
chain AS (SELECT user_id, event_id, n, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || body) AS self_hash FROM e WHERE n = 1
    UNION ALL SELECT e.user_id, e.event_id, e.n, c.self_hash, sha256(c.self_hash || '|' || e.body) FROM chain c JOIN e ON e.user_id = c.user_id AND e.n = c.n + 1)"""


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT user_id, event_id, self_hash, prev_hash FROM chain")
def audit_chain(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    return governance.audit_chain(e, ["user_id"], "event_id", F.concat_ws("|", "event_type", "props")).select("user_id", "event_id", "self_hash", "prev_hash")


@query("SELECT user_id, count(*) AS entries, min(CASE WHEN event_type = 'purchase' THEN event_id END) AS first_bad FROM events GROUP BY user_id")
def audit_chain_verify(spark, sf_dir):
    """Purchases were tampered with after their hashes were made: the first one of each chain is found."""
    payload = F.concat_ws("|", "event_type", "props")
    chain = governance.audit_chain(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props"), ["user_id"], "event_id", payload)
    changed = chain.withColumn("props", F.when(F.col("event_type") == "purchase", F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return governance.verify_chain(changed, ["user_id"], "event_id", payload)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def tumbling_counts(spark, sf_dir):
    return events.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@query("""SELECT start, event_type, count(*) AS events FROM (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1, 2""")
def sliding_counts(spark, sf_dir):
    return events.sliding(table(spark, sf_dir, "events"), "ts", "2 hours", "1 hour", ["event_type"])


@query("""WITH g AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT min(ts) AS start, max(ts) AS last, user_id, count(*) AS events FROM s GROUP BY user_id, n""")
def session_events(spark, sf_dir):
    return events.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"])


@query("""SELECT event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, round(sum(value), 2) AS spend, count(*) AS calls, CAST(grouping(event_type) AS INTEGER) AS g FROM events GROUP BY ROLLUP (event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP))""")
def spend_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return e.rollup("event_type", "day").agg(F.round(F.sum("value"), 2).alias("spend"), F.count("*").alias("calls"), F.grouping("event_type").cast("int").alias("g"))


@query("""SELECT event_type, max(CASE WHEN rn = 1 + CAST(floor(n * 0.5) AS BIGINT) THEN value END) AS p50, max(CASE WHEN rn = 1 + CAST(floor(n * 0.9) AS BIGINT) THEN value END) AS p90
FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    w = Window.partitionBy("event_type")
    r = table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w.orderBy("value", "event_id"))).withColumn("n", F.count("*").over(w))
    at = lambda q: F.max(F.when(F.col("rn") == F.floor(F.col("n") * q) + 1, F.col("value")))
    return r.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.9).alias("p90"))


BM25_SQL = """docs AS (SELECT doc_id AS id, source, list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: length(t) >= 2) AS tokens FROM documents),
queries AS (SELECT item_id AS query_id, list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 2)) AS tokens FROM benchmark),
stats AS (SELECT source, count(*) AS n, avg(len(tokens)) AS avgdl FROM docs GROUP BY 1),
tf AS (SELECT source, id, term, dl, count(*) AS tf FROM (SELECT source, id, len(tokens) AS dl, unnest(tokens) AS term FROM docs) GROUP BY ALL),
df AS (SELECT source, term, count(*) AS df FROM tf GROUP BY ALL),
scored AS (SELECT query_id, source, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM (SELECT query_id, unnest(tokens) AS term FROM queries) q JOIN tf USING (term) JOIN df USING (source, term) JOIN stats USING (source) GROUP BY ALL)"""


def bm25_best(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "source", retrieval.code_tokens(F.col("text")).alias("tokens"))
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), retrieval.code_tokens(F.col("text")).alias("tokens"))
    return retrieval.bm25_top_k(docs, queries, ["source"], k)


@query(f"WITH {BM25_SQL} SELECT query_id, source, id, score, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 3")
def bm25_topk(spark, sf_dir):
    return bm25_best(spark, sf_dir, 3)


DENSE_SQL = """pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS la, b.label AS lb, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 20 = 0)"""


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("part"))


@query(f"WITH {DENSE_SQL} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 5")
def dense_topk(spark, sf_dir):
    """The stated query set, ids divisible by 20, against all vectors."""
    v = vectors(spark, sf_dir)
    return retrieval.dense_top_k(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 5)


@query(f"WITH {DENSE_SQL} SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM pairs WHERE la <> lb QUALIFY rank <= 3")
def cross_label_similarity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return retrieval.dense_top_k(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 3, apart=True)


@query()
def mmr_rerank(spark, sf_dir):
    v = vectors(spark, sf_dir)
    near = retrieval.dense_top_k(v, v.filter("id % 20 = 0").withColumnRenamed("id", "query_id"), 20)
    return retrieval.mmr(near.join(v, "id").select("query_id", "id", F.col("score").alias("relevance"), "embedding"), 5)


@query(f"""WITH {BM25_SQL}, a AS (SELECT query_id, id, max(score) AS score FROM scored GROUP BY 1, 2), l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM a QUALIFY r <= 20),
v AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
d AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM v QUALIFY r <= 20)
SELECT coalesce(l.query_id, d.query_id) AS query_id, coalesce(l.id, d.id) AS id, round(coalesce(1.0 / (60 + l.r), 0) + coalesce(1.0 / (60 + d.r), 0), 8) AS score FROM l FULL JOIN d ON l.query_id = d.query_id AND l.id = d.id""")
def hybrid_rrf(spark, sf_dir):
    """Lexical ranks of the benchmark items fused with dense ranks; a document's vector, and an item's, is that of its number."""
    best = bm25_best(spark, sf_dir, 20).groupBy("query_id", "id").agg(F.max("score").alias("score"))  # of 20 documents, none is below the 20th of its source
    lexical = retrieval.top_k(best, ["query_id"], "score", 20)
    v = vectors(spark, sf_dir).select("id", "embedding")
    asked = v.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")).distinct(), "id", "left_semi").withColumnRenamed("id", "query_id")
    return retrieval.fuse(lexical, retrieval.dense_top_k(v, asked, 20), ["query_id"]).select("query_id", "id", "score")


@query("""WITH t AS (SELECT source, doc_id, CAST(ceil(n_chars / 4) AS BIGINT) AS tokens FROM documents)
SELECT source, doc_id, used FROM (SELECT *, CAST(sum(tokens) OVER (PARTITION BY source ORDER BY n_chars_rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tokens, doc_id) AS n_chars_rank FROM t)) WHERE used <= 6000""")
def token_budget_tiers(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", scores.tokens_ceil(F.col("n_chars")).alias("tokens"))
    out = retrieval.within_budget(d, ["source"], [F.asc("tokens"), F.asc("doc_id")], "tokens", retrieval.TIER_BUDGETS["total"])
    return out.select("source", "doc_id", "used")


LUHN_SQL = "list_sum(list_transform(range(1, length(value) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * CAST(value[-i] AS INTEGER)) // 10 + (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * CAST(value[-i] AS INTEGER)) % 10)) % 10 = 0"
PII_SQL = (
    "every AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '({p})', 1)) AS value FROM documents" for k, p in governance.PII_PATTERNS.items())
    + f"), found AS (SELECT * FROM every WHERE kind <> 'card' UNION ALL SELECT * FROM every WHERE kind = 'card' AND {LUHN_SQL})"
)


@query(f"WITH {PII_SQL} SELECT doc_id, kind, value, count(*) AS occurrences FROM found GROUP BY ALL")
def pii_findings(spark, sf_dir):
    return governance.pii_findings(table(spark, sf_dir, "documents"), "doc_id", "text").drop("confidence")


@query(f"""WITH {PII_SQL}, k AS (SELECT doc_id, bool_or(kind = 'api_key') AS secret FROM found GROUP BY 1), c AS (
    SELECT d.doc_id, CASE WHEN secret THEN 'secret' WHEN k.doc_id IS NOT NULL THEN 'pii' WHEN lang = 'de' THEN 'transient' WHEN lang = 'fr' THEN 'operational' WHEN lang = 'es' THEN 'business_indefinite' ELSE 'permanent' END AS ttl_class FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id)
SELECT ttl_class, CASE WHEN ttl_class = 'permanent' THEN 'skip' WHEN ttl_class IN ('secret', 'pii') THEN 'redact' WHEN ttl_class = 'transient' THEN 'delete' WHEN ttl_class = 'operational' THEN 'tombstone' ELSE 'skip' END AS action, count(*) AS entities FROM c GROUP BY ALL""")
def ttl_sweep(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds = governance.pii_findings(docs, "doc_id", "text").groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))
    source = F.when(F.col("lang") == "de", "transient").when(F.col("lang") == "fr", "operational").when(F.col("lang") == "es", "business_indefinite")
    e = docs.join(kinds, "doc_id", "left").select("doc_id", governance.ttl_class(F.coalesce("kinds", F.array().cast("array<string>")), source).alias("ttl_class"), F.lit("2023-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    return governance.ttl_sweep(e, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")).groupBy("ttl_class", "action").agg(F.count("*").alias("entities"))


@query()
def pii_spans(spark, sf_dir):
    """All kinds with their places; the dictionary holds the capitalised words of the benchmark."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(privacy.NAME), 0)).alias("name"))
    return privacy.pii_spans(table(spark, sf_dir, "documents"), "doc_id", "text", words)


@query()
def redact_spans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(privacy.redacted(F.col("text")), 256).alias("redacted_sha256"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{governance.PII_PATTERNS['email']}', '[REDACTED:email]', 'g')) AS redacted_sha256 FROM documents")
def redact_email(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(governance.redact_kind(F.col("text"), "email"), 256).alias("redacted_sha256"))


GLOSSARY_SQL = """t AS (SELECT source, unnest(list_distinct(list_concat(regexp_extract_all(text, '([A-Z][a-z]+( [A-Z][a-z]+)+)', 1), regexp_extract_all(text, '([A-Z]{2,})', 1)))) AS term FROM documents),
g AS (SELECT term, count(*) AS occurrences, count(DISTINCT source) AS sources FROM t GROUP BY 1)"""


@query(f"WITH {GLOSSARY_SQL} SELECT *, occurrences >= 20 AND sources >= 2 AS promoted FROM g")
def glossary_terms(spark, sf_dir):
    g = text.glossary(table(spark, sf_dir, "documents"), "text", "source")
    return g.withColumn("promoted", (F.col("occurrences") >= 20) & (F.col("sources") >= 2))


@query(f"""WITH {GLOSSARY_SQL} SELECT trim(regexp_replace(lower(term), '[^a-z0-9]+', ' ', 'g')) AS norm, max_by(term, (occurrences, length(term), term)) AS canonical, count(*) AS forms, CAST(sum(occurrences) AS BIGINT) AS total FROM g GROUP BY 1""")
def alias_clusters(spark, sf_dir):
    return text.aliases(text.glossary(table(spark, sf_dir, "documents"), "text", "source"))


@query("""SELECT 'c:' || a.c_custkey AS left_id, 's:' || b.s_suppkey AS right_id, na AS norm, 0.82::DOUBLE AS confidence FROM
(SELECT c_custkey, trim(regexp_replace(lower(replace(c_name, 'Customer', 'Party')), '[^a-z0-9]+', ' ', 'g')) AS na FROM customer) a JOIN (SELECT s_suppkey, trim(regexp_replace(lower(replace(s_name, 'Supplier', 'Party')), '[^a-z0-9]+', ' ', 'g')) AS nb FROM supplier) b ON na = nb WHERE na <> ''""")
def entity_resolution_name(spark, sf_dir):
    party = lambda t, p, k, n, w: table(spark, sf_dir, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.replace(F.col(n), F.lit(w), F.lit("Party")).alias("name"))
    return text.resolve_by_name(party("customer", "c:", "c_custkey", "c_name", "Customer"), party("supplier", "s:", "s_suppkey", "s_name", "Supplier")).drop("resolution_id")


@query("SELECT * FROM (SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'e') ORDER BY p_name, p_partkey LIMIT 50)")
def symbol_search(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.lower("p_name").contains("e")).orderBy("p_name", "p_partkey").limit(50).select("p_partkey", "p_name")


@query("SELECT p_brand, count(*) AS parts FROM part WHERE lower(p_brand) GLOB 'brand*?1' GROUP BY 1")
def glob_columns(spark, sf_dir):
    return table(spark, sf_dir, "part").filter(F.col("p_brand").rlike(selection.glob("Brand*?1"))).groupBy("p_brand").agg(F.count("*").alias("parts"))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def paged_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy("c_name", "c_custkey").offset(40).limit(20).select("c_custkey", "c_name")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 50")
def conversation_history(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(w)).filter("rn <= 50").select("conv_id", "turn", "role")


@query("""WITH r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS up, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS down FROM conversations WINDOW w AS (PARTITION BY conv_id)),
m AS (SELECT *, n >= 4 AND n > 2 AND up > 1 AND down > 1 AS middle FROM r)
SELECT conv_id, turn, FALSE AS is_marker, CAST(1 AS BIGINT) AS turns FROM m WHERE NOT middle UNION ALL SELECT conv_id, min(turn), TRUE, count(*) FROM m WHERE middle GROUP BY conv_id""")
def conversation_compaction(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("tokens", F.lit(1))
    return governance.compacted(t, "conv_id", "turn", "tokens", least_turns=4, first=1, last=1)


@query("SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_sales(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"), F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_custkey AS k, o_orderdate AS at, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL), l AS (SELECT event_id, user_id AS k, ts - INTERVAL 8 YEAR + INTERVAL 2000 DAY AS ts FROM events)
SELECT l.event_id, l.k, l.ts, o.at AS matched_at, o.o_orderkey FROM l ASOF LEFT JOIN o ON l.k = o.k AND l.ts >= o.at""")
def asof_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    moved = F.expr("ts - INTERVAL '8' YEAR + INTERVAL '2000' DAY")
    left = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("k"), moved.alias("ts"))
    return events.as_of(left, o, "k", "ts", "at", ["o_orderkey"])


@query()
def approx_distinct_users(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("""WITH e AS (SELECT p_partkey AS k, 'size' AS field, CASE WHEN p_size % 3 = 0 THEN 'string' ELSE 'int' END AS t, p_size % 2 = 0 AS r FROM part UNION ALL SELECT p_partkey, 'brand', 'string', TRUE FROM part WHERE p_size > 10),
a AS (SELECT p_partkey AS k, 'size' AS field, 'int' AS t FROM part WHERE p_size <> 7 UNION ALL SELECT p_partkey, 'brand', 'string' FROM part WHERE p_size < 40),
j AS (SELECT coalesce(e.k, a.k) AS k, coalesce(e.field, a.field) AS field, e.t AS expected_type, a.t AS actual_type, r, CASE WHEN e.t IS NULL THEN 'extra' WHEN a.t IS NULL THEN 'missing' WHEN e.t <> a.t THEN 'type_mismatch' END AS kind FROM e FULL JOIN a ON e.k = a.k AND e.field = a.field)
SELECT k, field, expected_type, actual_type, kind, CASE WHEN kind = 'extra' THEN 'info' WHEN kind = 'missing' AND NOT r THEN 'warning' ELSE 'breaking' END AS severity FROM j WHERE kind IS NOT NULL""")
def contract_field_diff(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    f = lambda d, name, kind, need=None: d.select("k", F.lit(name).alias("field"), kind.alias("type"), *([need.alias("required")] if need is not None else []))
    size_type = F.when(F.col("p_size") % 3 == 0, "string").otherwise("int")
    expected = f(p, "size", size_type, F.col("p_size") % 2 == 0).unionByName(f(p.filter("p_size > 10"), "brand", F.lit("string"), F.lit(True)))
    actual = f(p.filter("p_size <> 7"), "size", F.lit("int")).unionByName(f(p.filter("p_size < 40"), "brand", F.lit("string")))
    return upserts.field_diff(expected, actual, ["k"])


#: Lines of code made from part names, one form for each key modulo 9.
CODE_FORMS = ["@assumption {}", "# ASSUMPTION: {}", "// ASSUME: {}", "x!.y; {}", "if (!{}) throw", "assert ({})", "invariant ({})", "schema.parse ({})", "{}"]
CODE_SQL = "code AS (SELECT p_partkey, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN replace('{f}', '{{}}', p_name)" for i, f in enumerate(CODE_FORMS)) + " END AS line FROM part)"


def code_lines(spark, sf_dir):
    line = F.lit(None).cast("string")
    for i, form in enumerate(CODE_FORMS):
        line = F.when(F.col("p_partkey") % 9 == i, F.replace(F.lit(form), F.lit("{}"), F.col("p_name"))).otherwise(line)
    return table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))


@query("WITH " + CODE_SQL + ", r AS (" + " UNION ALL ".join(f"SELECT p_partkey, '{n}' AS rule, '{sev}' AS severity, CAST({c} AS DOUBLE) AS confidence, len(regexp_extract_all(line, '{p}')) AS hits FROM code" for n, p, sev, c in text.ASSUMPTION_RULES)
    + ") SELECT p_partkey, rule, severity, confidence, CAST(hits AS INTEGER) AS hits FROM r WHERE hits > 0")
def assumption_mining(spark, sf_dir):
    return text.assumptions(code_lines(spark, sf_dir), "p_partkey", "line")


@query("SELECT o_custkey, CASE WHEN a.n IS NULL THEN 'created' WHEN b.n IS NULL THEN 'kept' ELSE 'updated' END AS state, coalesce(b.n, a.n) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)")
def node_upsert(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    count = lambda s: o.filter(F.col("o_orderstatus") == s).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return upserts.upsert_nodes(count("F"), count("O"), ["o_custkey"], ["n"])


@query("""WITH d AS (SELECT user_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS day FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
l AS (SELECT user_id, max(day) AS last FROM d GROUP BY 1)
SELECT user_id, last AS day, count_if(day > last - 7) AS last_7, count_if(day > last - 30) AS last_30, count_if(day > last - 90) AS last_90 FROM d JOIN l USING (user_id) GROUP BY ALL""")
def trailing_windows(spark, sf_dir):
    return trailing.trailing_batch(table(spark, sf_dir, "events"))
