"""What source text says of classes, against loops and by hand."""

import random

from veinway.operators import code_structure

UNIT = "file_path string, content string"
ENTITY = "n long, external_id string, name string, entity_type string, snippet string"


def test_classes_hold_what_their_braces_hold(spark):
    """Random nests of classes and methods, against a loop with a stack."""
    rng, rows, want = random.Random(3), [], set()
    for f in range(12):
        said, stack, n = [], [], 0
        for _ in range(40):
            step = rng.random()
            if step < 0.25 or not any(stack):
                said.append(f"class C{f}_{n} {{")
                stack.append(f"C{f}_{n}")
            elif step < 0.5:
                said.append(f"  public int m{n}(int x) {{")
                want |= {(c, f"m{n}") for c in stack if c}
                stack.append(None)
            elif step < 0.65:
                said.append(f"  String a{n}();")
                want |= {(c, f"a{n}") for c in stack if c}
            else:
                said.append("}")
                stack.pop()
            n += 1
        rows.append((f"f{f}.java", "\n".join(said)))
    none = spark.createDataFrame([], "name string, entity_type string")
    got = code_structure.structural_edges(spark.createDataFrame(rows, UNIT), none).filter("etype = 'CONTAINS'").collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want)


def test_odd_units(spark):
    rows = [("a.java", None), (None, "class A {}"), ("b.java", " "), ("c.ts", "class A extends B { }"), ("d.java", "new Lost(); import x.Y;"), ("e.kt", "class A extends x.B<C, D>, E {\n import y.F;\nimport java.util.Map;\n new Map<>(new Gg()) \n return foo(1);"), ("e.kt", "}")]
    entities = spark.createDataFrame([("A", "Z"), ("A", "Model"), (None, None), ("Gg", "Thing")], "name string, entity_type string")
    got = {(r.src, r.etype, r.dst): (r.src_type, r.dst_type, r.confidence) for r in code_structure.structural_edges(spark.createDataFrame(rows[:-1], UNIT), entities).collect()}
    assert got == {
        ("A", "EXTENDS", "B"): ("Model", "Class", 1.0), ("A", "EXTENDS", "E"): ("Model", "Class", 1.0), ("A", "INSTANTIATES", "Map"): ("Model", "Class", 0.9),
        ("A", "INSTANTIATES", "Gg"): ("Model", "Thing", 0.9), ("A", "IMPORTS", "F"): ("Model", "Class", 0.85),
    }
    assert code_structure.structural_edges(spark.createDataFrame([], UNIT), entities).count() == 0


def test_unresolved_by_hops(spark):
    """The first call of a type counts; what is three edges away isn't read, what no endpoint reaches is two away."""
    rows = [(1, "e", "E", "ApiEndpoint", "a.go();this.x();"), (2, "f", "F", "Function", "b.go()"), (3, "g", "G", "Function", "b.go(); c.go()"), (4, "h", "H", "Function", "d.go()"), (5, "i", "I", "Function", "d.go();\n Long.x()"), (6, "j", None, None, None)]
    edges = [("e", "f"), ("f", "g"), ("g", "h"), ("h", "e"), ("x", "p::q.R"), ("x", "p::q.F"), (None, None)]
    fields = spark.createDataFrame([("a", "m.Z"), ("a", "m.Y"), ("b", ""), ("c", "F")], "field string, type string")
    got = code_structure.unresolved(spark.createDataFrame(rows, ENTITY), spark.createDataFrame(edges, "src string, dst string"), fields).collect()
    assert {(r.type_hint, r.receiver, r.method, r.hops) for r in got if r.receiver} == {("m.Y", "a", "go", 1), ("B", "b", "go", 2), ("D", "d", "go", 3)}
    assert {r.type_hint for r in got if not r.receiver} == {"e", "f", "g", "h", "R"}
    empty = spark.createDataFrame([], ENTITY)
    assert code_structure.unresolved(empty, spark.createDataFrame([], "src string, dst string"), fields).count() == 0


def test_only_the_bracket_is_drawn_up(spark):
    rows = [(1, "e", "E", "ApiEndpoint", "  one.ship \n\n  ( two.max(1),\n 2); three.go()\nfour.go (5)")]
    got = code_structure.unresolved(spark.createDataFrame(rows, ENTITY), spark.createDataFrame([], "src string, dst string"), spark.createDataFrame([], "field string, type string")).collect()
    assert {(r.receiver, r.method, r.evidence) for r in got} == {("one", "ship", "one.ship("), ("two", "max", "two.max(1),"), ("three", "go", "2); three.go()"), ("four", "go", "four.go (5)")}


def test_distances_of_a_cycle_and_a_chain(spark):
    edges = [(i, i + 1) for i in range(9)] + [(9, 0), (4, 8), (20, 21)]
    got = code_structure.distances(spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in edges], "src string, dst string"), spark.createDataFrame([("v0",), ("v6",), (None,)], "id string")).collect()
    assert {r.node: r.hops for r in got} == {"v0": 0, "v1": 1, "v2": 2, "v3": 3, "v4": 4, "v5": 5, "v6": 0, "v7": 1, "v8": 2, "v9": 3} and len(got) == 10


def test_queries_belong_to_the_next_method(spark):
    java = '@Query("one") int a;\ninterface X {\n @Query("two")\n Y findTwo(int a);\n Y findNone();\n @Query(\'three\')\n @Query("four")\n\n\n Y getFour();\n @Query("lost") void set(); }\n'
    rows = [("p/XRepo.java", java), ("p/X.java", java), ("p/Y.kt", "interface Y extends CrudRepository<A, B> {\n Y readIt();\n}"), ("p/XStore.js", java), ("XFinder.py", "def find(a):\n  ...\ndef findB(a): ...\n"), ("ZRepo.java", None), (None, java)]
    got = sorted((r.name, r.query_text) for r in code_structure.derived_queries(spark.createDataFrame(rows, UNIT)).collect())
    assert got == [("XFinder.find", None), ("XFinder.findB", None), ("XRepo.findNone", None), ("XRepo.findTwo", "two"), ("XRepo.getFour", "four"), ("Y.readIt", None)]
