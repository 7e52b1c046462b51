"""Substring joins, call sites and betweenness against brute force."""

import random
import re

import duckdb
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from tests.oracle import same
from veinway.operators import frontier, graph, matching
from veinway.plans import registry


def ilike(text, name):
    pattern = "".join("(?s:.)*" if c == "%" else "(?s:.)" if c == "_" else re.escape(c) for c in name.lower())
    return re.search(pattern, text.lower()) is not None


def test_substring_join_is_ilike(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abAB_c%\\.") for _ in range(n))
    texts = [(i, word(rng.randrange(12)), 1) for i in range(250)] + [(250, None, 1), (251, "aabb", 1), (251, "aabb", 1), (252, "x\ny Äbc", 1)]
    names = [(i, word(rng.randrange(1, 6)), 2) for i in range(60)] + [(60, None, 2), (61, "", 2), (62, "%_%", 2), (63, "AAB", 2), (63, "AAB", 2), (64, "\ny ä", 2)]
    a = spark.createDataFrame(texts, "t long, text string, _gram int").repartition(3)
    b = spark.createDataFrame(names, "n long, name string, size int").repartition(2)
    want = sorted((t, n) for t, x, _ in texts for n, y, _ in names if x and y and y.strip("%_") and ilike(x, y))
    for rows in (50_000, 7):  # with short tasks the lists of common grams are dealt out
        got = matching.substring_join(a, b, "text", "name", rows)
        assert got.columns == ["t", "text", "_gram", "n", "name", "size"]
        assert sorted((r.t, r.n) for r in got.collect()) == want
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert matching.substring_join(a.limit(0), b, "text", "name").count() == 0 == matching.substring_join(a, b.limit(0), "text", "name").count()


def test_backfill_prefers_equal_then_longest(spark):
    nodes = spark.createDataFrame([("1", "a.Run"), ("2", "x.runner"), ("3", "zzz"), ("4", None)], "id string, external string")
    batch = spark.createDataFrame([("a.Run", "zz"), ("q.run", "run"), ("p.Runn", "RUNN"), ("o.runn", "runn")], "q string, s string")
    got = matching.backfilled(nodes, batch, "id", "external", "q", "s")
    assert sorted(map(tuple, got.collect())) == [("1", "a.Run", "exact"), ("2", "o.runn", "substring"), ("3", "a.Run", "substring")]


def test_call_sites(spark):
    symbols = [("u1", "A.run", "run"), ("u2", "B.run", "run"), ("u3", "C.go", "go"), *((f"m{i}", f"M{i}.many", "many") for i in range(4)), ("u9", "A.run", "run")]
    calls = [("f", "this.A.run(x.y(1))"), ("f", "A.run()"), ("f", "run"), ("g", "q.go()"), ("u3", "C.go"), ("g", "many()"), ("g", "M2.many"), ("g", "()"), ("g", None), ("f", "self.go\n(1,\n2)")]
    got = matching.resolved_calls(spark.createDataFrame(calls, "caller string, callee_text string"), spark.createDataFrame(symbols, "urn string, qualified_name string, name string"))
    assert sorted(map(tuple, got.collect())) == [
        ("f", "u1", 0.95, 3), ("f", "u2", 0.7, 1), ("f", "u3", 0.7, 1), ("f", "u9", 0.95, 3), ("g", "m2", 0.95, 1), ("g", "u3", 0.7, 1),
    ]


def shares(edges, pivots):
    """Betweenness by listing all shortest paths."""
    out, total = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    nodes = {x for e in edges for x in e}
    for p in pivots & nodes:
        paths, level = {p: [[p]]}, [p]
        while level:
            new = {}
            for v in level:
                for w in out.get(v, ()):
                    if w not in paths:
                        new.setdefault(w, []).extend(x + [w] for x in paths[v])
            paths |= new
            level = list(new)
        for w, every in paths.items():
            for x in every:
                for v in x[1:-1]:
                    total[v] = total.get(v, 0) + 1 / len(every)
    n = len(nodes)
    return {v: round(t * n / ((n - 1) * (n - 2) * len(pivots & nodes)), 6) for v, t in total.items()}


def test_betweenness_on_random_graphs(spark):
    rng = random.Random(4)
    for size, n in ((8, 14), (14, 40)):
        edges = {(rng.randrange(size), rng.randrange(size)) for _ in range(n)}
        edges = [(str(a), str(b)) for a, b in edges]
        pivots = {str(i) for i in range(0, size + 3, 2)}
        got = graph.betweenness(spark.createDataFrame([*edges, edges[0], (None, "1")], "src string, dst string"), spark.createDataFrame([(p,) for p in pivots], "id string"))
        assert {r.id: round(r.score, 6) for r in got.collect() if r.score} == shares(edges, pivots)
    assert graph.betweenness(spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([("a",)], "id string")).count() == 0


def test_betweenness_from_every_node(spark, monkeypatch):
    """Cycles, self-loops, targets within one step and several levels, with ids sent and by the sieve."""
    rng = random.Random(5)
    for size, n, few in ((7, 16, 100), (16, 30, 100), (16, 30, 0)):
        monkeypatch.setattr(frontier.among, "__defaults__", (few,))
        edges = [(str(a), str(b)) for a, b in {(rng.randrange(size), rng.randrange(size)) for _ in range(n)}]
        got = graph.betweenness(spark.createDataFrame([*edges, edges[0], ("1", None)], "src string, dst string"), None)
        assert {r.id: round(r.score, 6) for r in got.collect()} == shares(edges, {x for e in edges for x in e})


def test_bridges_of_more_than_5000_nodes_count_every_source(spark, tmp_path):
    """Each of 5,200 orders is a source: a customer and a supplier of one order are bridges too."""
    n = 5200
    customer, supplier = [min(o % 50, 2) if o else 3 for o in range(n)], [o % 2 if o != 7 else 2 for o in range(n)]
    day = "TIMESTAMP_NTZ '2001-01-01 00:00:00'"
    spark.createDataFrame(list(enumerate(customer)), "o_orderkey long, o_custkey long").selectExpr("*", f"{day} AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    lines = spark.createDataFrame(list(enumerate(supplier)), "l_orderkey long, l_suppkey long")
    lines.selectExpr("*", "l_suppkey AS l_partkey", "0.0D AS l_discount", f"{day} AS l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(4)], "c_custkey long, c_nationkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i, i % 2) for i in range(3)], "s_suppkey long, s_nationkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(0, 0), (1, 0)], "n_nationkey long, n_regionkey long").write.parquet(str(tmp_path / "nation.parquet"))
    edges = [(f"o:{o}", f"c:{c}") for o, c in enumerate(customer)] + [(f"o:{o}", f"{x}:{s}") for o, s in enumerate(supplier) for x in "sp"]
    edges += [(f"c:{i}", f"n:{i % 2}") for i in range(4)] + [(f"s:{i}", f"n:{i % 2}") for i in range(3)] + [("n:0", "r:0"), ("n:1", "r:0")]
    want = shares(edges, {x for e in edges for x in e})
    assert len(want) == 9
    got = registry.QUERIES["bridge_betweenness"](spark, str(tmp_path))
    assert {r.id: round(r.score, 6) for r in got.collect()} == want


def test_parts_meet_every_document_row(spark, tmp_path):
    """Rows that repeat a doc_id count each, a part that two names match counts once, and a part without a brand has no sized name."""
    docs = [(1, "brand#1x5 and redo"), (1, "REDO"), (2, "brand#1_5"), (3, None), (None, "redo 7")]
    parts = [("red bolt", "Brand#1", 5), ("red bolt", "Brand#1", 5), ("red bolt", "Brand#2", 5), ("Redo it", "Brand#1", 5), ("Redo it", None, 7), ("gone", None, 7), ("hot nut", "Brand#1", 5)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.execute("CREATE TABLE part (p_partkey BIGINT, p_name VARCHAR, p_brand VARCHAR, p_size INTEGER)")
    con.executemany("INSERT INTO part VALUES (?, ?, ?, ?)", [(i, *p) for i, p in enumerate(parts)])
    for name in ("documents", "part"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    same(registry.QUERIES["part_mentions"](spark, str(tmp_path)), con, registry.ORACLE_SQL["part_mentions"])


def test_lists_of_short_names_hold_nothing_else(spark):
    """Names of digits share their grams of three; the lists that are looked at are still those of the whole names."""
    ids = spark.range(3000).select(F.col("id").alias("_row"), F.concat(F.lit("src/é/"), (F.col("id") * 2654435761 % 9000000 + 1000000).cast("string")).alias("_text"))
    names = spark.range(100, 20000, 7).select(F.col("id").cast("string").alias("_name"))
    wanted = names.mapInArrow(matching.literal_grams, "_name string, _gram long, _slot long, _whole boolean").cache()
    assert wanted.filter("_whole").count() == names.count() == wanted.count()
    looked = matching.gram_lists(ids, matching.sieve(wanted), 100).join(wanted, "_gram").select("_row", "_name")
    texts, wanted_names = ids.collect(), [r[0] for r in names.collect()]
    want = sorted((t[0], n) for t in texts for n in wanted_names if n in t[1])
    assert sorted(map(tuple, looked.collect())) == want
    assert sorted(map(tuple, matching.held_names(ids.localCheckpoint(), names, 5).collect())) == want


def test_backfill_looks_for_longer_names_first(spark, monkeypatch):
    """What a longer name has met is not looked at again."""
    seen, held = [], matching.held_names
    monkeypatch.setattr(matching, "held_names", lambda body, names, rows: (seen.append(body.count()), held(body, names, rows))[1])
    nodes = spark.createDataFrame([("a", "x/123456789"), ("b", "x/12345"), ("c", "x/12"), ("d", "x/9"), ("d", "x/12345"), (None, "q"), ("e", "q")], "id string, external string")
    batch = spark.createDataFrame([("q", "1"), ("r", "12345678"), ("s", "123456789"), ("t", "12345"), ("u", "9"), ("v", "x_123"), ("w", "12"), ("p", "12")], "q string, s string")
    got = matching.backfilled(nodes, batch, "id", "external", "q", "s")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", "s", "substring"), ("b", "t", "substring"), ("c", "p", "substring"), ("d", "t", "substring"), ("e", "q", "exact"), (None, "q", "exact")]
    assert seen == [5, 4, 2, 1]


def test_lists_of_long_names_hold_nothing_else(spark):
    """Names that share all grams of seven with other texts meet those texts only that hold them whole; names of all sizes are found."""
    ids = spark.range(2000).select(F.col("id").alias("_row"), F.concat(F.lit("src/"), (F.col("id") % 40 + 10).cast("string"), F.lpad((F.col("id") / 40).cast("int").cast("string"), 9, "0")).alias("_text")).localCheckpoint()
    names = spark.range(400).select(F.concat((F.col("id") % 40 + 10).cast("string"), F.lpad((F.col("id") / 40).cast("int").cast("string"), 8, "0")).alias("_name"))
    near, sure = matching.near_names(ids, names, 50_000)
    texts, wanted = ids.collect(), [r[0] for r in names.collect()]
    want = sorted((t[0], n) for t in texts for n in wanted if n in t[1])
    assert not sure and want and sorted((r[0], r[1]) for r in near.collect()) == want
    rng = random.Random(6)
    text = "".join(rng.choice("abcdé_0") for _ in range(400))
    parts = [text[i : i + n] for n in range(1, 90) for i in (0, 400 - n, rng.randrange(400 - n))]
    rows = spark.createDataFrame([(1, text), (2, text[:70]), (3, text[200:]), (4, "ab")], "t long, text string")
    got = matching.substring_join(rows, spark.createDataFrame([(p,) for p in dict.fromkeys(parts)], "name string"), "text", "name")
    assert sorted((r.t, r.name) for r in got.collect()) == sorted((t, n) for t, x in rows.collect() for n in dict.fromkeys(parts) if n.strip("_") and ilike(x, n))
