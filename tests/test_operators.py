"""Literal cases of single operators."""

import datetime as dt
import math
from collections import Counter

from pyspark.sql import functions as F

from veinway.functions import scores
from veinway.operators import frontier, governance, graph, ownership, retrieval, text, upserts, versions
from veinway.sources import ddl, files


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_walk_keeps_least_depth_and_stops(spark):
    edges = spark.createDataFrame([("CALLS", "a", "b", 0.9), ("CALLS", "b", "c", 0.8), ("CALLS", "a", "c", 0.7), ("USES", "a", "c", 0.6), ("CALLS", "c", "a", 0.9)], "etype string, src string, dst string, confidence double")
    found = frontier.walk(edges, spark.createDataFrame([("a",)], "seed string"), 5)
    assert rows(found) == [("a", "b", 1, "CALLS", 0.9), ("a", "c", 1, "CALLS", 0.7)]
    assert frontier.walk(edges.limit(0), spark.createDataFrame([("a",)], "seed string"), 5).count() == 0


def test_mmr_prefers_what_differs(spark):
    c = spark.createDataFrame([(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.85, [1.0, 0.01]), (1, "c", 0.5, [0.0, 1.0])], "query_id int, id string, relevance double, embedding array<double>")
    assert [r.id for r in retrieval.mmr(c, 2).orderBy("position").collect()] == ["a", "c"]


def test_age_factor(spark):
    got = spark.createDataFrame([(0.0,), (90.0,), (180.0,), (270.0,)], "age double").select(scores.age_factor(F.col("age")).alias("f")).collect()
    assert [r.f for r in got] == [1, 1, 2, 3]


def test_confidence_renormalises(spark):
    row = spark.createDataFrame([(1.0, None)], "a double, b double").select(scores.confidence({"agreement": F.col("a"), "verifier": F.col("b")}).alias("c")).first()
    assert row.c == 1.0


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")], "src string, dst string")
    pivots = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert rows(graph.betweenness(e, pivots)) == [("b", 1.0)]


def test_merge_fills_blanks(spark):
    e = spark.createDataFrame([("k", 0.9, "", "x"), ("k", 0.5, "query", "yy")], "key string, confidence double, query string, code string")
    assert rows(upserts.merge_entities(e, ["key"], ["query", "code"])) == [("k", 0.9, "query", "x")]


def test_artifact_changes(spark):
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, content string")
    new = spark.createDataFrame([("a", " x "), ("b", "z"), ("c", "n")], "id string, content string")
    assert [(r.id, r.event_kind) for r in upserts.artifact_changes(old, new, ["id"], "content").orderBy("id").collect()] == [("b", "changed"), ("c", "created")]


def test_pii_and_redaction(spark):
    d = spark.createDataFrame([(1, "mail a.b@c.org or 10.0.0.1, card 4111111111111111, not 4111111111111112"), (2, None)], "doc_id int, text string")
    found = {(r.kind, r.value, r.confidence) for r in governance.pii_findings(d, "doc_id", "text").collect()}
    assert found == {("email", "a.b@c.org", 0.9), ("ipv4", "10.0.0.1", 0.5), ("card", "4111111111111111", 0.9)}
    assert d.select(governance.redact_all(F.col("text")).alias("t")).first().t.startswith("mail [REDACTED:email] or [REDACTED:ipv4]")


def test_illegal_transitions(spark):
    m = spark.createDataFrame([("open", "resolved"), ("resolved", "acknowledged")], "from_state string, to_state string")
    assert rows(governance.illegal_transitions(m)) == [("resolved", "acknowledged")]


def test_tokens_and_names(spark):
    row = spark.createDataFrame([("getUserName2 snake_case-X",)], "t string").select(retrieval.code_tokens(F.col("t")).alias("k"), text.normal_name(F.lit(" Foo--Bar ")).alias("n")).first()
    assert row.k == ["get", "user", "name", "snake", "case"] and row.n == "foo bar"


def test_sql_references(spark):
    d = spark.createDataFrame([(1, "INSERT INTO t SELECT * FROM a JOIN b.c ON 1=1")], "id int, sql string")
    assert rows(text.sql_references(d, "id", "sql")) == [(1, "READS_TABLE", "a"), (1, "READS_TABLE", "b.c"), (1, "WRITES_TABLE", "t")]


def test_ddl(spark):
    d = spark.createDataFrame([(1, "CREATE TABLE x (id bigint PRIMARY KEY, -- c\n name varchar(10) NOT NULL, tags text[], o int REFERENCES y(id), PRIMARY KEY (id));")], "id int, sql string")
    got = [(r.column, r.type, r.nullable, r.is_primary_key, r.references) for r in ddl.ddl_columns(d, "id", "sql").orderBy("position").collect()]
    assert got == [("id", "bigint", False, True, None), ("name", "varchar(10)", False, False, None), ("tags", "text[]", True, False, None), ("o", "int", True, False, "y(id)")]


def test_scan_files_and_lookup(spark, tmp_path):
    (tmp_path / "a.py").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/b.js").write_text("y")
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.tier, r.skip_reason) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.py": ("python", "tier1", None), "b.js": ("javascript", "skip", "vendored")}
    store = spark.createDataFrame([("pkg.Foo", "1"), ("Bar", "2")], "name string, value string")
    asked = spark.createDataFrame([("x.y.foo",), ("bar",), ("none",)], "name string")
    assert rows(files.lookup(asked, store)) == [("bar", "2"), ("none", None), ("x.y.foo", "1")]


def test_churn_and_shares(spark):
    d = spark.createDataFrame([("f", "a", dt.datetime(2024, 1, 1)), ("f", "a", dt.datetime(2024, 3, 1)), ("f", "b", dt.datetime(2024, 3, 2))], "f string, author string, at timestamp")
    assert rows(ownership.churn(d, "f", "at", F.lit("2024-03-05").cast("timestamp"))) == [("f", 2, 3, 3)]
    assert rows(ownership.shares(d, "f", "author").select("author", "share", "place")) == [("a", 0.6667, 1), ("b", 0.3333, 2)]


def test_edges_keep_nulls_apart(spark):
    e = spark.createDataFrame([("T", "a", "b", None, None), ("T", "a", "b", 0.5, None)], "etype string, src string, dst string, confidence double, last_seen timestamp")
    assert rows(upserts.upsert_edges(e)) == [("T", "a", "b", 0.5, None)]


def test_persona_and_kind_order(spark):
    d = spark.createDataFrame([("the budget and the bug",), ("@pm fix the code",), (None,)], "t string")
    assert [r.p for r in d.select(versions.persona(F.col("t")).alias("p")).collect()] == ["vp", "pm", "dev"]
    row = spark.createDataFrame([("method",)], "k string").select(versions.kind_order(F.col("k")).alias("a"), versions.kind_order(F.lit("x")).alias("b")).first()
    assert (row.a, row.b) == (4, 7)


def test_dense_top_k_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<double>")
    q = v.filter("id % 3 = 0").withColumnRenamed("id", "query_id")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: np.lexsort((np.arange(60), -np.round(unit @ unit[i], 6)))[:4].tolist() for i in range(0, 60, 3)}
    for most in (64_000_000, 500):
        got = {}
        for r in retrieval.dense_top_k(v, q, 4, most_bytes=most).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want


def test_chain_finds_a_rewritten_entry(spark):
    """A middle entry with a new hash of its own still breaks the link of the next one."""
    rows = [("a", i, f"p{i}") for i in range(1, 6)] + [(None, 1, "x"), ("b", 1, None)]
    e = spark.createDataFrame(rows, "chain string, seq int, payload string").repartition(3)
    made = governance.audit_chain(e, ["chain"], "seq", F.col("payload"))
    assert {(r.chain, r.entries, r.first_bad) for r in governance.verify_chain(made, ["chain"], "seq", F.col("payload")).collect()} == {("a", 5, None), (None, 1, None), ("b", 1, None)}
    import hashlib

    kept = {(r.chain, r.seq): r for r in made.collect()}
    before = "0" * 64
    for i in range(1, 6):
        assert kept["a", i].prev_hash == before and kept["a", i].self_hash == hashlib.sha256(f"{before}|{i}|p{i}".encode()).hexdigest()
        before = kept["a", i].self_hash
    forged = made.filter("chain = 'a'").withColumn("payload", F.when(F.col("seq") == 3, "forged").otherwise(F.col("payload")))
    forged = forged.withColumn("self_hash", F.when(F.col("seq") == 3, F.sha2(F.concat_ws("|", "prev_hash", F.lit("3"), "payload"), 256)).otherwise(F.col("self_hash")))
    assert governance.verify_chain(forged, ["chain"], "seq", F.col("payload")).first().first_bad == 4


def test_closure_goes_to_the_end(spark):
    e = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "src string, dst string")
    assert graph.closure(e, spark.createDataFrame([("n000",)], "id string")).count() == 61


def test_edge_ends_deal_edges_once(spark):
    from veinway.operators import lookups

    edges = spark.createDataFrame([("C", "a", "b"), ("C", "a", "b"), ("C", "a", "c"), ("D", "a", "b"), ("C", "b", "x"), (None, "b", "c"), ("C", None, "b")], "etype string, src string, dst string")
    nodes = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "B")], "id string, node_type string")
    got = lookups.edge_ends(edges, nodes)
    assert sorted(map(tuple, got.collect()), key=str) == [("A", "B", "C", 2), ("A", "B", "D", 1), ("B", "B", None, 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") > plan.rindex("Aggregate")


def test_bm25_keeps_the_best_of_each_corpus_in_blocks_of_queries(spark):
    rows = [("a", 1, ["x", "x", "y"]), ("a", 2, ["x"]), ("a", 2, ["x"]), ("a", 2, ["x", "z"]), ("a", 3, []), ("a", 4, None), ("b", 1, ["y", "z"]), ("b", 5, ["w"]), (None, 6, ["x"]), ("b", None, ["z"])]
    docs = spark.createDataFrame(rows, "corpus string, id long, tokens array<string>").repartition(3)
    queries = [(10, ["x", "z", "x"]), (20, ["y"]), (30, ["none"])]
    want = set()
    for c in ("a", "b"):
        own = [(i, t) for k, i, t in rows if k == c]
        sizes = [len(t) for _, t in own if t is not None]
        tf = Counter((i, len(t), x) for i, t in own if t for x in t)
        df = Counter(x for _, _, x in tf)
        for q, terms in queries:
            score = Counter()
            for (i, dl, x), f in tf.items():
                if x in terms:
                    score[i] += math.log(1 + (len(own) - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * dl * len(sizes) / sum(sizes)))
            best = sorted(score, key=lambda i: (-round(score[i], 6), i is not None, i or 0))[:2]
            want |= {(q, c, i, round(score[i], 6), n) for n, i in enumerate(best, 1)}
    asked = spark.createDataFrame(queries, "query_id long, tokens array<string>")
    for most in (8_000_000, 1):
        got = retrieval.bm25_top_k(docs, asked, ["corpus"], 2, most_numbers=most)
        assert {(r.query_id, r.corpus, r.id, r.score, r["rank"]) for r in got.collect()} == want
    one = retrieval.bm25_top_k(docs, asked.withColumn("corpus", F.lit("b")), ["corpus"], 2)
    assert {tuple(r) for r in one.select("query_id", "corpus", "id").collect()} == {x[:3] for x in want if x[1] == "b"}


def test_walk_is_the_same_whether_nodes_are_few_or_many(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a"), ("b", "d"), ("d", "e"), ("e", "b"), ("f", "a"), ("c", None), (None, "a")]
    edges = spark.createDataFrame([(s, d, k, i / 16) for i, (s, d) in enumerate(pairs) for k in ("X", "Y")], "src string, dst string, etype string, confidence double")
    seeds = ["a", "f", "z"]
    want = set()
    for seed in seeds:
        seen, level = {seed}, {seed}
        for depth in (1, 2, 3):
            found = {}
            for i, (s, d) in enumerate(pairs):
                if s in level and d not in seen:
                    found[d] = max(found.get(d, 0), i / 16)
            want |= {(seed, d, depth, "X", c) for d, c in found.items()}
            seen, level = seen | set(found), set(found)
    asked = spark.createDataFrame([(s,) for s in [*seeds, "a"]], "seed string")
    for few in (0, 2, 100):
        assert {tuple(r) for r in frontier.walk(edges, asked, 3, few=few).collect()} == want
    assert frontier.few_values(edges, "dst", 5) is None and frontier.few_values(edges, "dst", 100).count() == 6


def test_dense_queries_are_compared_a_slice_at_a_time(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 3), float(i % 5) + 1, float(i % 7)], i % 2) for i in range(30)], "id long, embedding array<double>, part int")
    asked = v.filter("id % 4 = 0").withColumnRenamed("id", "query_id")
    whole = {apart: rows(retrieval.dense_top_k(v, asked, 3, apart=apart)) for apart in (False, True)}
    monkeypatch.setattr(retrieval, "MOST_ASKED", 3)
    for apart, want in whole.items():
        assert len(want) == 24 and rows(retrieval.dense_top_k(v, asked, 3, apart=apart)) == want


def test_a_sieve_keeps_all_asked_and_shuffles_nothing(spark):
    asked = spark.range(0, 3000, 3).select(F.concat(F.lit("o:"), F.col("id").cast("string")).alias("id"))
    told = spark.range(20000).select(F.lit(1).alias("a"), F.concat(F.lit("o:"), F.col("id").cast("string")).alias("src"))
    few, exact = frontier.among(asked, 5000)
    assert exact and few(told, "src").count() == 1000
    keep, exact = frontier.among(asked, 10)
    got = keep(told, "src")
    assert not exact and got.columns == ["a", "src"] and 1000 <= got.count() <= 1040
    assert got.join(asked, F.col("src") == F.col("id"), "left_semi").count() == 1000
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert frontier.among(asked.limit(0), -1)[0](told, "src").count() == 0


def test_traversals_by_sieve_and_with_repeated_edges(spark, monkeypatch):
    """Edges that repeat and lack ends, read again at each level, with ids sent and by the sieve."""
    pairs = [("n1", "r"), ("c1", "n1"), ("c2", "n1"), ("c2", "n2"), ("o1", "c1"), ("o2", "c2"), ("o2", "p"), ("x", "y"), ("n2", "n2"), (None, "n1"), ("n1", None)]
    edges = spark.createDataFrame([(a, b, "CALLS", 0.5) for a, b in pairs + pairs[:5]], "src string, dst string, etype string, confidence double")
    seeds = ["n1", "n2"]
    near = {(s, s) for s in seeds} | {(a, b) for a, b in pairs if a in seeds} | {(b, a) for a, b in pairs if b in seeds}
    want = sorted({(s, a, b) for s, x in near for a, b in pairs if x is not None and x in (a, b)}, key=str)
    asked = spark.createDataFrame([(s,) for s in seeds], "seed string")
    ids = spark.createDataFrame([("o1",), ("o2",)], "id string")
    scores = []
    for few in (100, 0):
        monkeypatch.setattr(frontier.among, "__defaults__", (few,))
        assert sorted(map(tuple, graph.two_hop(edges, asked).collect()), key=str) == want
        got = graph.closure(edges, ids, store=False).collect()
        assert len(got) == 9 and {r.id for r in got} == {"o1", "o2", "c1", "c2", "p", "n1", "n2", "r", None}
        assert {(r.seed, r.node, r.depth) for r in frontier.walk(edges, ids.withColumnRenamed("id", "seed"), 2, few=few, store=False).collect()} == {
            ("o1", "c1", 1), ("o1", "n1", 2), ("o2", "c2", 1), ("o2", "p", 1), ("o2", "n1", 2), ("o2", "n2", 2)}
        scores.append(sorted(map(tuple, graph.betweenness(edges.select("src", "dst"), ids, graph.ends(edges)).filter("score > 0").collect())))
    assert scores[0] == scores[1] and [i for i, _ in scores[0]] == ["c1", "c2", "n1"]
