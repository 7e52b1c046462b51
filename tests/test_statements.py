"""Column lineage of SQL statements, held against what can be read off them."""

import pyarrow as pa

from veinway.operators import statements
from veinway.plans import statement_queries


def lineage(spark, *sql, catalog=None):
    rows = spark.createDataFrame(list(enumerate(sql)), "stmt_id long, sql string")
    known = spark.createDataFrame([(t, c) for t, own in (catalog or {}).items() for c in own], "`table` string, `column` string") if catalog else None
    out = {}
    for r in statements.column_lineage(rows, known).collect():
        out.setdefault((r.stmt_id, r.output), set()).add(f"{r.table}.{r.column}")
    return out


def test_scopes_and_shadowed_names(spark):
    got = lineage(
        spark,
        "WITH c AS (SELECT id, sum(v) s FROM raw GROUP BY id), d AS (WITH c AS (SELECT k FROM other) SELECT k FROM c) SELECT c.s, d.k, c.id + d.k both_ids FROM c, d",
        "SELECT a.x FROM (SELECT y AS x FROM t1 a) a JOIN t2 b ON a.x = b.x",
        "SELECT x FROM (SELECT a AS x FROM t UNION ALL SELECT b FROM u EXCEPT SELECT c FROM w) q",
        "SELECT o.id, (SELECT max(i.v) FROM items i WHERE i.order_id = o.id) AS best, count(*) AS n FROM orders o",
        'SELECT "Odd Name"."Sum" AS total FROM "Odd Name" -- FROM wrong\n /* SELECT z FROM no */',
    )
    assert got == {
        (0, "s"): {"raw.v"}, (0, "k"): {"other.k"}, (0, "both_ids"): {"raw.id", "other.k"}, (1, "x"): {"t1.y"}, (2, "x"): {"t.a", "u.b", "w.c"},
        (3, "id"): {"orders.id"}, (3, "best"): {"items.v"}, (4, "total"): {"odd name.sum"},
    }


def test_stars_and_unqualified_columns_need_a_catalog(spark):
    sql = ["SELECT * FROM t JOIN u ON t.id = u.id", "SELECT p, q FROM t, u", "SELECT s.*, 1 AS one FROM (SELECT * FROM t) s"]
    assert lineage(spark, *sql, catalog={"t": ["id", "p"], "u": ["id", "q"]}) == {
        (0, "id"): {"t.id", "u.id"}, (0, "p"): {"t.p"}, (0, "q"): {"u.q"}, (1, "p"): {"t.p"}, (1, "q"): {"u.q"}, (2, "id"): {"t.id"}, (2, "p"): {"t.p"},
    }
    assert lineage(spark, *sql) == {(0, "*"): {"t.*", "u.*"}, (1, "p"): {"t.p", "u.p"}, (1, "q"): {"t.q", "u.q"}, (2, "*"): {"t.*"}}


def test_views_inserts_and_cycles(spark):
    got = lineage(
        spark,
        "CREATE VIEW v (a, b) AS SELECT x, y FROM base", "CREATE TABLE w AS SELECT * FROM v", "INSERT INTO log (n) SELECT w.b FROM w",
        "INSERT INTO loop SELECT l.k, m.k AS j FROM loop l, src m", "SELECT log.n, loop.k FROM log, loop",
        "INSERT INTO two (c) SELECT p FROM e1", "INSERT INTO two (c) SELECT q FROM e2", "SELECT c FROM two",
    )
    assert got == {
        (0, "a"): {"base.x"}, (0, "b"): {"base.y"}, (1, "a"): {"base.x"}, (1, "b"): {"base.y"}, (2, "n"): {"base.y"}, (3, "j"): {"src.k"}, (4, "n"): {"base.y"},
        (5, "c"): {"e1.p"}, (6, "c"): {"e2.q"}, (7, "c"): {"e1.p", "e2.q"},
    }


def test_statement_kinds(spark):
    rows = [
        (1, "UPDATE t SET a = 1 WHERE b = ?"), (2, "delete from t where c > 2"), (3, None), (4, ""), (5, "EXPLAIN x"), (6, "MERGE INTO t USING (SELECT k FROM u) s ON t.k = s.k WHEN MATCHED THEN DELETE"),
        (7, "with a as (select 1) select * from a"), (8, "DROP TABLE IF EXISTS z"), (9, "select ((("), (10, "VALUES (1, 2)"),
    ]
    got = {r.stmt_id: r for r in statements.parsed(spark.createDataFrame(rows, "stmt_id long, sql string")).collect()}
    assert [got[i].kind for i in range(1, 11)] == ["UPDATE", "DELETE", "OTHER", "OTHER", "OTHER", "MERGE", "SELECT", "DROP", "SELECT", "OTHER"]
    assert got[1].tables == ["t"] and sorted(got[1].columns) == ["a", "b"] and got[1].tier == "prepared_statement" and got[2].columns == ["c"]
    assert got[6].tables == ["t", "u"] and got[8].tables == ["z"] and got[7].tables == []
    assert statements.parsed(spark.createDataFrame([], "stmt_id long, sql string")).count() == 0


def test_equal_texts_are_read_once(monkeypatch):
    seen, read = [], statements.read
    monkeypatch.setattr(statements, "read", lambda sql: (seen.append(sql), read(sql))[1])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4, 5]), pa.array(["SELECT a FROM t", None, "SELECT a FROM t", "INSERT INTO u SELECT b FROM t", "SELECT a FROM t"])], ["stmt_id", "sql"])
    (out,) = statements.first_of_texts(iter([batch]))
    assert seen == ["SELECT a FROM t", "", "INSERT INTO u SELECT b FROM t"]
    assert out["text_id"].to_pylist() == ["0.0", "0.1", "0.0", "0.2", "0.0"] and out["target"].to_pylist() == [None, None, None, "u", None]
    assert [bool(f) for f in out["facts"].to_pylist()] == [True, False, False, True, False] and out["facts"][2].as_py() is None


def test_lineage_of_repeated_texts_and_keys(spark):
    """Each statement has the lineage of its text, those that repeat a text or a key too."""
    sql = ["SELECT v.a FROM v", "CREATE VIEW v AS SELECT x AS a FROM t", "SELECT v.a FROM v", "CREATE VIEW v AS SELECT x AS a FROM t"]
    assert lineage(spark, *sql) == {(i, "a"): {"t.x"} for i in range(4)}
    rows = spark.createDataFrame([(7, "SELECT s.a AS p FROM (SELECT x AS a FROM t) s"), (7, "SELECT s.a AS q FROM (SELECT y AS a FROM u) s"), (8, "SELECT s.a AS p FROM (SELECT x AS a FROM t) s")], "stmt_id long, sql string")
    assert sorted(map(tuple, statements.column_lineage(rows).collect())) == [(7, "p", "t", "x"), (7, "q", "u", "y"), (8, "p", "t", "x")]


def test_statements_are_written_by_many_tasks(spark):
    assert statement_queries.written(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 16
