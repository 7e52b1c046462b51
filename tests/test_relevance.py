"""Relevance of entities to an endpoint, and the ladder of entry points."""

from veinway.operators import relevance


def test_rules_and_order(spark):
    rows = [
        ("a.OrderService", "Class", "src/Service/x.java", 0.9, None), ("OrderTest", "Function", "service/x", 0.9, None), ("Added Constant:ROLES", "Function", "", 0.9, None), ("X", "Constant", "", 0.9, None),
        ("Q", "DatabaseQuery", "repo/q", 0.9, ""), ("Q2", "DatabaseQuery", "repo/q", 0.9, "select"), ("Low", "Function", "f", 0.49, None), ("JsonKeys", "Class", "f", 0.9, None), ("JsonKeys", "Function", "f", 0.9, None),
        ("getOrders", "ApiEndpoint", "a/controller/b", 0.6, None), ("plain", "Unknown", None, 0.5, None), (None, None, None, None, None),
    ]
    e = spark.createDataFrame(rows, "name string, entity_type string, file string, confidence double, query_text string")
    got = [(r.name, r.relevance) for r in relevance.relevant(e, "/api/v1/order-12/{id}").collect()]
    assert got == [("getOrders", 10.0), ("a.OrderService", 8.8), ("Q2", 6.6), ("JsonKeys", 3.2), ("plain", 0.8)]
    assert {r.reason: r.entities for r in relevance.dropped(e).collect()} == {"test_class": 1, "diff_artifact": 1, "constant_type": 1, "empty_query_text": 1, "low_confidence": 2, "noise_suffix": 1}
    assert relevance.endpoint_terms("/api/v1/a_bc/Foo-bar/123/v2") == ["bar", "foo"] and [r.name for r in relevance.relevant(e, "", 1).collect()] == ["getOrders"]


def test_first_rung_that_gives_anything(spark):
    e = spark.createDataFrame([("one", "ApiEndpoint", "GET /v1/payers/{id}"), ("two", "ApiEndpoint", "@PostMapping /v1/payers/{id}"), ("three", "Function", "GET /v1/payers/{id}"), ("listCompetitors", "Function", None), ("competitors", "Class", None)], "name string, entity_type string, signature string")
    rows = [("a", "GET", "/v1/payers/{id}"), ("b", None, " /v1/payers/{id} "), ("c", "delete", "/v1/payers/{id}"), ("d", "GET", "/v2/x/{id}/Competitors/{k}"), ("e", "GET", ""), ("f", "GET", None), ("g", "GET", "/{only}"), ("h", "GET", "/none_%")]
    got = relevance.entry_points(e, spark.createDataFrame(rows, "request string, method string, path string"))
    assert sorted(map(tuple, got.collect())) == [("a", "one", 1), ("b", "one", 1), ("b", "two", 1), ("c", "one", 2), ("c", "two", 2), ("d", "listCompetitors", 3)]
    assert relevance.entry_points(e, spark.createDataFrame([], "request string, method string, path string")).count() == 0


def test_names_are_looked_through_for_unmet_requests_only(spark, monkeypatch):
    asked, join = [], relevance.substring_join
    monkeypatch.setattr(relevance, "substring_join", lambda texts, names, *c: (asked.append(sorted(r.request for r in names.collect())), join(texts, names, *c))[1])
    e = spark.createDataFrame([("pay", "ApiEndpoint", "GET /pay"), ("listPay", "Function", None)], "name string, entity_type string, signature string")
    rows = [("a", "GET", "/pay"), ("b", "PUT", "/pay"), ("d", "GET", "/z/list"), ("c", None, "/x/pay"), ("c", "GET", "/y/list"), ("c", None, "/x/pay/{id}")]
    got = relevance.entry_points(e, spark.createDataFrame(rows, "request string, method string, path string"))
    assert sorted(map(tuple, got.collect())) == [("a", "pay", 1), ("b", "pay", 2), ("c", "listPay", 3), ("c", "pay", 3), ("d", "listPay", 3)]
    assert asked == [["a", "b", "c", "c", "c", "d"], ["d"], ["c", "c"]]
