"""Queries over the structure of source text written for the rows of the sales tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.operators import code_structure
from veinway.plans.graph_tables import key, table
from veinway.plans.registry import query

CLASS = """package shop;
import java.util.List;
import shop.model.Nation%2$d;
public final class Customer%1$d extends Base<Key<Long>> implements Owner, shop.Seg_%3$s {
  private List<Order> orders = new ArrayList<>();
  @Override public List<Map<String, Order>> orders() {
    if (ready(1)) { return make(new Order%1$d(this)); }
    return other(1);
  }
  public Customer%1$d(int id) { }
  static class Inner%1$d {
    void close() throws java.io.IOException { }
  }
  int last();
}
enum Kind%1$d { A, B }
class Later%1$d extends Customer%1$d { private int size() { return 0; } }
"""


@query("""WITH c AS (SELECT c_custkey::VARCHAR AS k, c_nationkey::VARCHAR AS n, c_mktsegment AS s, c_acctbal > 0 AS known FROM customer),
e AS (SELECT k, known, 'Customer' || k AS src, 'EXTENDS' AS etype, 'Base' AS dst, 'Class' AS dst_type, 1.0::DOUBLE AS confidence, 'class Customer' || k || ' extends Base' AS evidence FROM c
UNION ALL SELECT k, known, 'Customer' || k, 'IMPLEMENTS', x, 'Interface', 1.0, 'class Customer' || k || ' implements ' || x FROM c, LATERAL (SELECT unnest(['Owner', 'Seg_' || s]) AS x)
UNION ALL SELECT k, known, 'Customer' || k, 'CONTAINS', x, CASE WHEN known AND x = 'Customer' || k THEN 'Model' ELSE 'Function' END, 1.0, 'Customer' || k || '::' || x FROM c, LATERAL (SELECT unnest(['orders', 'Customer' || k, 'close', 'last']) AS x)
UNION ALL SELECT k, known, 'Customer' || k, 'INSTANTIATES', 'Order' || k, 'Class', 0.9, 'new Order' || k || '(...)' FROM c
UNION ALL SELECT k, known, 'Customer' || k, 'IMPORTS', 'Nation' || n, 'Class', 0.85, 'import shop.model.Nation' || n FROM c)
SELECT src, etype, dst, CASE WHEN known THEN 'Model' ELSE 'Class' END AS src_type, dst_type, confidence, evidence FROM e
UNION ALL SELECT 'Inner' || k, 'CONTAINS', 'close', 'Class', 'Function', 1.0, 'Inner' || k || '::close' FROM c
UNION ALL SELECT 'Later' || k, 'CONTAINS', 'size', 'Class', 'Function', 1.0, 'Later' || k || '::size' FROM c
UNION ALL SELECT 'Later' || k, 'EXTENDS', 'Customer' || k, 'Class', CASE WHEN known THEN 'Model' ELSE 'Class' END, 1.0, 'class Later' || k || ' extends Customer' || k FROM c""")
def structural_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, with an inner and a later class; customers with a balance are entities."""
    c = table(spark, sf_dir, "customer")
    units = c.select(F.concat(F.lit("src/Customer"), F.col("c_custkey").cast("string"), F.lit(".java")).alias("file_path"), F.format_string(CLASS, "c_custkey", "c_nationkey", "c_mktsegment").alias("content"))
    known = c.filter("c_acctbal > 0").select(F.concat(F.lit("Customer"), F.col("c_custkey").cast("string")).alias("name"), F.lit("Model").alias("entity_type"))
    return code_structure.structural_edges(units, known)


@query("""WITH l AS (SELECT l_orderkey AS k, min(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS k, o_custkey AS c, p, s, o_orderstatus = 'F' AS starts FROM orders JOIN l ON o_orderkey = l.k),
c AS (SELECT c_custkey AS c, c_nationkey AS n, coalesce(bool_or(starts), false) AS near FROM customer LEFT JOIN o ON o.c = c_custkey WHERE c_acctbal >= 0 GROUP BY 1, 2),
p AS (SELECT 'Part' || p AS type_hint, arg_min(starts, k) AS near FROM o GROUP BY p), v AS (SELECT s, arg_min(starts, k) AS near FROM o GROUP BY s), n AS (SELECT n, arg_min(near, c) AS near FROM c GROUP BY n)
SELECT type_hint, type_hint AS receiver, 'price' AS method, type_hint || '.price(1).format (2);' AS evidence, CASE WHEN near THEN 1 ELSE 3 END AS hops FROM p
UNION ALL SELECT 'shop.Vendor' || v.s, 'vendor' || v.s, 'ship', 'vendor' || v.s || '.ship(', CASE WHEN near THEN 1 ELSE 3 END FROM v JOIN supplier ON s_suppkey = v.s WHERE s_acctbal <= 0
UNION ALL SELECT 'Nation' || n, 'nation' || n, 'tax', 'return nation' || n || '.tax ( );', CASE WHEN near THEN 2 ELSE 3 END FROM n
UNION ALL SELECT DISTINCT 'Customer' || c, '', '', 'CALLS edge target: Customer' || c, 1 FROM o WHERE c NOT IN (SELECT c FROM c)""")
def unresolved_references(spark, sf_dir):
    """Orders, of which finished ones are endpoints, call a part, a vendor and a logger and lead to a customer; customers with no debt are entities that call their nation."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    orders = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    customer = lambda column: F.concat(F.lit("shop::model.Customer"), F.col(column).cast("string"))
    calls = F.format_string('  log.info("x");\n  Part%1$d.price(1).format (2);\n  vendor%2$d.ship\n    ( Math.max(1, 2));\n String.valueOf(1); Part%1$d.later(1)', "p", "s")
    kind = F.when(F.col("o_orderstatus") == "F", "ApiEndpoint").otherwise("Function")
    entities = orders.select(F.col("o_orderkey").cast("long").alias("n"), key("o", "o_orderkey").alias("external_id"), F.lit("api.run").alias("name"), kind.alias("entity_type"), calls.alias("snippet"))
    people = t("customer").filter("c_acctbal >= 0").select(
        (F.col("c_custkey") + F.lit(1 << 40)).alias("n"), customer("c_custkey").alias("external_id"), F.concat(F.lit("model.Customer"), F.col("c_custkey").cast("string")).alias("name"),
        F.lit("Class").alias("entity_type"), F.format_string("{\n return nation%d.tax ( );\n}", "c_nationkey").alias("snippet"),
    )
    vendors = t("supplier").filter("s_acctbal > 0").select(F.lit(0).cast("long").alias("n"), key("s", "s_suppkey").alias("external_id"), F.concat(F.lit("Vendor"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("Class").alias("entity_type"), F.lit(None).cast("string").alias("snippet"))
    edges = orders.select(key("o", "o_orderkey").alias("src"), customer("o_custkey").alias("dst"))
    fields = t("supplier").select(F.concat(F.lit("vendor"), F.col("s_suppkey").cast("string")).alias("field"), F.concat(F.lit("shop.Vendor"), F.col("s_suppkey").cast("string")).alias("type"))
    return code_structure.unresolved(entities.unionByName(people).unionByName(vendors), edges, fields)


STORES = {
    "java": 'public interface Part%1$d extends Shelf, JpaRepository<Part, Long> {\n  @Query(value = "select p from P%1$d {x} ")\n  @Cached\n  List<Part> findBySize(int size);\n  long countByBrand%1$d(\n    String brand) throws Lost ;\n  void save(Part p);\n  default int old() { return getAll(); }\n}',
    "py": "class Part%1$d:\n    @abstractmethod\n    def find_all(self, n):\n        pass\n    def get_%1$d(self) -> int: ...\n    def put(self): ...\n    def load(self):\n        return 1\n",
}


@query("""WITH p AS (SELECT p_partkey::VARCHAR AS k, p_partkey % 3 AS kind FROM part), j AS (SELECT k, 'src/Part' || k || '.java' AS file_path, 'Part' || k AS stem FROM p WHERE kind = 0),
y AS (SELECT k, 'src/Part' || k || 'Dao.py' AS file_path, 'Part' || k || 'Dao' AS stem FROM p WHERE kind = 1)
SELECT file_path, stem || '.findBySize' AS name, 'List<Part> findBySize(int size)' AS signature, 'select p from P' || k || ' {x}' AS query_text, 0.9::DOUBLE AS confidence FROM j
UNION ALL SELECT file_path, stem || '.countByBrand' || k, 'long countByBrand' || k || '(' || chr(10) || '    String brand) throws Lost', NULL, 0.9 FROM j
UNION ALL SELECT file_path, stem || '.find_all', 'def find_all(self, n)', NULL, 0.9 FROM y UNION ALL SELECT file_path, stem || '.get_' || k, 'def get_' || k || '(self)', NULL, 0.9 FROM y""")
def derived_queries(spark, sf_dir):
    """A repository for each part in Java or Python, and a third that is called like none."""
    k = F.col("p_partkey")
    java, py = (F.format_string(STORES[lang], "p_partkey") for lang in ("java", "py"))
    name = F.when(k % 3 == 0, F.format_string("src/Part%d.java", k)).when(k % 3 == 1, F.format_string("src/Part%dDao.py", k)).otherwise(F.format_string("src/Part%d.py", k))
    return code_structure.derived_queries(table(spark, sf_dir, "part").select(name.alias("file_path"), F.when(k % 3 == 0, java).otherwise(py).alias("content")))
