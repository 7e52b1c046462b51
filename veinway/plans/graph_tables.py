"""The property graph that the queries run on, derived from the sales tables, for Spark and for SQL.

Nodes: regions, nations, customers, suppliers, parts, orders. Edges: an order depends on its
customer and calls the parts and suppliers of its lines; customers and suppliers belong to nations,
nations to regions. An edge is kept once for its type and ends, with the largest confidence and the
latest time it was seen.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.operators.upserts import upsert_edges


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, column: str) -> DataFrame:
    """The rows dealt over four tasks a core by a column: a table of short rows is one task's, however much is made of each."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, column)


def key(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, node_type, name, risk_score); risk_score is null where the balance is negative or there is none."""
    t = lambda name: table(spark, sf_dir, name)
    risk = lambda c: F.when(F.col(c) >= 0, F.round(F.least(F.lit(1.0), F.col(c) / 10000), 2))
    none = F.lit(None).cast("double")
    parts = [
        ("region", "r", "r_regionkey", "Region", F.col("r_name"), none),
        ("nation", "n", "n_nationkey", "Nation", F.col("n_name"), none),
        ("customer", "c", "c_custkey", "Customer", F.col("c_name"), risk("c_acctbal")),
        ("supplier", "s", "s_suppkey", "Supplier", F.col("s_name"), risk("s_acctbal")),
        ("part", "p", "p_partkey", "Part", F.col("p_name"), none),
        ("orders", "o", "o_orderkey", "Order", F.col("o_orderpriority"), none),
    ]
    out = None
    for name, prefix, column, kind, label, score in parts:
        rows = t(name).select(key(prefix, column).alias("id"), F.lit(kind).alias("node_type"), label.alias("name"), score.alias("risk_score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    lines = t("lineitem").withColumn("confidence", F.round(1 - 5 * F.col("l_discount"), 4))
    seen = F.lit("2001-12-31 00:00:00").cast("timestamp_ntz")
    one = F.lit(1.0)

    def edge(df, kind, src, dst, confidence, last):
        return df.select(F.lit(kind).alias("etype"), src.alias("src"), dst.alias("dst"), confidence.alias("confidence"), last.cast("timestamp_ntz").alias("last_seen"))

    sets = [
        edge(t("orders"), "DEPENDS_ON", key("o", "o_orderkey"), key("c", "o_custkey"), one, F.col("o_orderdate")),
        edge(lines, "CALLS", key("o", "l_orderkey"), key("p", "l_partkey"), F.col("confidence"), F.col("l_shipdate")),
        edge(lines, "CALLS", key("o", "l_orderkey"), key("s", "l_suppkey"), F.col("confidence"), F.col("l_shipdate")),
        edge(t("customer"), "OWNS", key("c", "c_custkey"), key("n", "c_nationkey"), one, seen),
        edge(t("supplier"), "OWNS", key("s", "s_suppkey"), key("n", "s_nationkey"), one, seen),
        edge(t("nation"), "OWNS", key("n", "n_nationkey"), key("r", "n_regionkey"), one, seen),
    ]
    out = sets[0]
    for rows in sets[1:]:
        out = out.unionByName(rows)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert_edges(raw_edges(spark, sf_dir))


#: The same graph as SQL: nodes, raw_edges and edges.
GRAPH_SQL = """
nodes AS (
    SELECT 'r:' || r_regionkey AS id, 'Region' AS node_type, r_name AS name, CAST(NULL AS DOUBLE) AS risk_score FROM region
    UNION ALL SELECT 'n:' || n_nationkey, 'Nation', n_name, NULL FROM nation
    UNION ALL SELECT 'c:' || c_custkey, 'Customer', c_name, CASE WHEN c_acctbal >= 0 THEN round(least(1.0, c_acctbal / 10000), 2) END FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'Supplier', s_name, CASE WHEN s_acctbal >= 0 THEN round(least(1.0, s_acctbal / 10000), 2) END FROM supplier
    UNION ALL SELECT 'p:' || p_partkey, 'Part', p_name, NULL FROM part
    UNION ALL SELECT 'o:' || o_orderkey, 'Order', o_orderpriority, NULL FROM orders
), raw_edges AS (
    SELECT 'DEPENDS_ON' AS etype, 'o:' || o_orderkey AS src, 'c:' || o_custkey AS dst, CAST(1.0 AS DOUBLE) AS confidence, o_orderdate AS last_seen FROM orders
    UNION ALL SELECT 'CALLS', 'o:' || l_orderkey, 'p:' || l_partkey, round(1 - 5 * l_discount, 4), l_shipdate FROM lineitem
    UNION ALL SELECT 'CALLS', 'o:' || l_orderkey, 's:' || l_suppkey, round(1 - 5 * l_discount, 4), l_shipdate FROM lineitem
    UNION ALL SELECT 'OWNS', 'c:' || c_custkey, 'n:' || c_nationkey, 1.0, TIMESTAMP '2001-12-31 00:00:00' FROM customer
    UNION ALL SELECT 'OWNS', 's:' || s_suppkey, 'n:' || s_nationkey, 1.0, TIMESTAMP '2001-12-31 00:00:00' FROM supplier
    UNION ALL SELECT 'OWNS', 'n:' || n_nationkey, 'r:' || n_regionkey, 1.0, TIMESTAMP '2001-12-31 00:00:00' FROM nation
), edges AS (
    SELECT etype, src, dst, max(confidence) AS confidence, max(last_seen) AS last_seen FROM raw_edges GROUP BY etype, src, dst
)"""
