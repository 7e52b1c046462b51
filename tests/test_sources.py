"""Blame output and interface documents."""

import json
import random

from veinway.operators import source_edges
from veinway.plans import source_queries
from veinway.sources import blame, openapi


def lines_of(rng, commits, n):
    """Porcelain lines and the rows that they stand for; a commit says its author once, or with `full` each time."""
    lines, rows, said = [], [], set()
    for i in range(1, n + 1):
        sha, (author, mail, time) = rng.choice(sorted(commits.items()))
        lines.append(f"{sha} {rng.randrange(99)} {i} 1")
        if sha not in said or rng.random() < 0.3:
            lines += [f"author {author}", f"author-mail <{mail}>", f"author-time {time}", "author-tz +0100", "summary author x", "previous " + "9" * 40 + " f", "filename f"]
            said.add(sha)
        lines.append(f"\tauthor {i}")
        rows.append((i, author or mail, mail, sha, time))
    return lines, rows


def test_blame(spark):
    rng = random.Random(5)
    commits = {f"{i:x}" * 40: (rng.choice(["Ann", "Bo B", ""]), f"m{i}@x", 1000 * i) for i in range(6)}
    raw, want = [], []
    for f in ("a", "b", "c d"):
        lines, rows = lines_of(rng, commits, 60)
        raw += [(f, 7 * n, x, "own") for n, x in enumerate(lines)]
        want += [(f, *r) for r in rows]
    rng.shuffle(raw)
    out = blame.blame_lines(spark.createDataFrame([*raw, ("z", 1, "\talone", ""), ("z", 2, None, ""), (None, 1, "\tx", "")], "file string, n long, raw string, author string").repartition(5))
    got = out.selectExpr("file", "line_no", "author", "author_mail", "commit_sha", "unix_timestamp(commit_time) AS t").collect()
    assert sorted(map(tuple, got), key=str) == sorted([*want, ("z", 1, "", "", "", 0), (None, 1, "", "", "", 0)], key=str)
    assert blame.blame_lines(spark.createDataFrame([], "file string, n long, raw string")).count() == 0


def spec(**parts):
    return json.dumps({"openapi": "3.0.0", **parts})


def test_openapi_documents(spark):
    ref = lambda n: {"$ref": f"#/components/schemas/{n}"}
    two = {"swagger": "2.0", "definitions": {"Old": {"properties": {"a": {"type": "integer"}, "b": "text"}}}, "paths": {"/x": {"POST": {"parameters": [{"in": "body", "schema": {"$ref": "#/definitions/Old"}}], "responses": {"201": {"schema": {"type": "array", "items": {"$ref": "#/definitions/Old"}}}, "2XX": {"schema": ref("Old")}}}, "get": None}, "/bad": 3}}
    chain = {f"S{i}": {"properties": {"next": ref(f"S{i + 1}")}} for i in range(6)} | {"S6": {"items": ref("S3")}, "Own": {"oneOf": [ref("Own"), ref("Gone")]}}
    rows = [("two", json.dumps(two)), ("chain", spec(components={"schemas": chain})), ("list", "[1]"), ("none", None), ("bad", "{"), ("odd", spec(paths=[1], components={"schemas": "x"}))]
    docs = openapi.parsed(spark.createDataFrame(rows, "file string, content string"))
    assert sorted(r.file for r in docs.collect()) == ["chain", "odd", "two"]
    ops = openapi.operations(docs)
    assert [(r.path, r.method, r.operation_id) for r in ops.collect()] == [("/x", "POST", "")]
    assert sorted(map(tuple, openapi.payloads(ops).select("role", "code", "ref").collect()), key=str) == [("request", None, "#/definitions/Old"), ("response", 201, "#/definitions/Old")]
    named = openapi.schemas(docs)
    assert sorted(map(tuple, openapi.properties(named).filter("file = 'two'").select("property", "type").collect())) == [("a", "integer"), ("b", "text")]
    got = {(r.name, r.target): (r.depth, r.missing, r.cyclic) for r in openapi.resolved(named).filter("file = 'chain'").collect()}
    want = {}
    step = {f"S{i}": {f"S{i + 1}"} for i in range(6)} | {"S6": {"S3"}, "Own": {"Own", "Gone"}}
    for name in step:  # breadth first
        level, depth, seen = {name}, 0, set()
        while level:
            level, depth = {t for s in level for t in step.get(s, ())} - seen, depth + 1
            seen |= level
            want |= {(name, t): (depth, t not in step, t == name) for t in level}
    assert got == want


def test_parameters_are_looked_up(spark):
    op = {"parameters": [{"name": "q", "in": "query", "required": True}, {"$ref": "#/components/parameters/P"}, {"$ref": "#/parameters/Gone"}]}
    doc = spec(paths={"/a": {"get": op}, "/b": {"get": {}}}, components={"parameters": {"P": {"name": "page", "in": "header"}}})
    docs = openapi.parsed(spark.createDataFrame([("f", doc)], "file string, content string"))
    got = openapi.parameters(docs, openapi.operations(docs)).select("path", "name", "place", "required").collect()
    assert sorted(map(tuple, got), key=str) == sorted([("/a", "q", "query", True), ("/a", "page", "header", False), ("/a", "Gone", None, False)], key=str)


def test_injection_is_seen_in_three_languages(spark):
    units = [
        ("a/A.java", "public class A {\n @Inject  private Bee b;\n private final Bee again;\n private final x.Cee c;\n private final Dee d;\n public A(Bee b, final Eee e, Gone g) {}\n public A(Fee f) {} }"),
        ("a/NoName.java", "private final Bee b;"), ("x.ts", "import { Bee, Cee } from \"m\"\nclass A { private b: Bee; readonly d: Dee; public readonly c: Cee }"),
        ("x.py", "from m import Cee as C, Dee\nclass A:\n  self.c = Cee(1)\n  self.b = Bee()\n  self.d = Dee ()"), ("x.go", "class A { private final Bee b; }"), ("b.java", None), ("c.java", ""), ("z.py", "class Unknown:\n  self.b = Bee()"),
    ]
    entities = [("p.A", "a"), ("Bee", "b"), ("q.Bee", "b2"), ("Cee", "c"), ("r.Dee", "d2"), ("q.Dee", "d1"), ("Eee", "e"), ("Fee", "f"), ("NoName", "n"), (None, "x")]
    df = lambda rows, shape: spark.createDataFrame(rows, shape)
    got = {(r.src, r.dst): (r.confidence, r.evidence) for r in source_edges.injected(df(units, "file_path string, content string"), df(entities, "name string, external_id string")).collect()}
    assert got == {
        ("a", "b"): (0.95, "@Autowired Bee b"), ("a", "d1"): (0.88, "private final Dee d"), ("a", "e"): (0.85, "constructor Eee e"),
        ("a", "c"): (0.85, "field Cee c"), ("n", "b"): (0.88, "private final Bee b"),
    }


def test_endpoints_are_met_by_method_and_path(spark):
    ops = spark.createDataFrame([("f", "one", "/a/{id}/", "GET"), ("f", "two", "/b", "POST"), ("f", "root", "/", "GET")], "file string, operation_id string, path string, method string")
    code = spark.createDataFrame([(1, "GET //a//{id}"), (2, "@PostMapping('/b/')"), (3, "post /b"), (4, "GET /b"), (5, None), (6, "get"), (7, "@RequestMapping('/b')"), (8, "GET /"), (9, "@GetMapping(value = \"/a/{id}\")")], "id int, signature string")
    got = source_edges.documented(ops, code)
    assert sorted((r.operation_id, r.endpoint) for r in got.collect()) == [("one", 1), ("one", 9), ("root", 8), ("two", 2), ("two", 3)]


def test_interface_documents_are_written_by_many_tasks_and_read_once(spark, monkeypatch):
    """References are followed on stored schemas."""
    docs = source_queries.documents(spark, "/root/testdata/sf0.001")
    assert docs.rdd.getNumPartitions() >= 16
    named, stored, pinned = openapi.schemas(openapi.parsed(docs)), [], openapi.pinned
    monkeypatch.setattr(openapi, "pinned", lambda df: (stored.append(df.columns), pinned(df))[1])
    assert openapi.resolved(named).count() == 8 * docs.count() and named.columns in stored


def test_blame_reads_without_python(spark):
    """Odd headers, times and nulls; no Python worker sees the lines."""
    a, b = "A" * 40, "b" * 40
    said = ["\tnone", "author ", "author-mail <<x>", "\tmail only", f"{a} 1 1", "author Ann", "author-time 1_0 ", "\tann", None, f"{b}", "author-time 999999999999", "author B b", "\t", f"{a[:39]} 1", "\tstill b", f"{a} 2 2", "author", "\tno name", "author-time x", "\t\tx"]
    rows = [(f, i, raw) for f in ("f", None) for i, raw in enumerate(said)]
    got = blame.blame_lines(spark.createDataFrame(rows, "file string, n long, raw string"))
    want = [
        (1, "", "", "", 0, "none"), (2, "x", "x", "", 0, "mail only"), (3, "Ann", "", a, 10, "ann"), (4, "B b", "", b, 0, ""), (5, "B b", "", b, 0, "still b"),
        (6, "", "", a, 10, "no name"), (7, "", "", a, 0, "\tx"),
    ]
    found = sorted(((r.file or "", r.line_no, r.author, r.author_mail, r.commit_sha, int(r.commit_time.timestamp()), r.content) for r in got.collect()))
    assert found == sorted((f, *w) for f in ("", "f") for w in want)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
