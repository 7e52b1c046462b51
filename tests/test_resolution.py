"""Resolution decisions in batches against recomputation, and walks with a budget of expansions against a queue."""

import random

from veinway.operators import graph, resolution, text
from veinway.streaming import events as stream


def classes_of(decisions):
    """{id: class} by merging sets over the last decisions."""
    last = {}
    for m, a, b, status, at in sorted(decisions, key=lambda d: (d[4], d[3], d[1], d[2])):
        last[m] = (a, b, status)
    group = {x: {x} for a, b, _ in last.values() for x in (a, b)}
    for a, b, status in last.values():
        if status == "confirmed" and group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    return {x: min(g) for x, g in group.items()}


def decisions(rng, n, ids=30):
    return [(f"m{k}", f"x{k // 3:02d}", f"x{(k * 7 + 1) % ids:02d}", rng.choice(["confirmed", "confirmed", "rejected", "pending"]), rng.randrange(50)) for k in (rng.randrange(60) for _ in range(n))]


def test_components_of_a_long_chain(spark):
    n = 70
    edges = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + [("900", "900")], "a string, b string").repartition(5)
    vertices = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)] + [("900",), ("901",), ("900",)], "id string")
    got = resolution.components(vertices, edges).collect()
    assert len(got) == n + 3 and {r["class"] for r in got if r.id < "900"} == {"000"} and {r["class"] for r in got if r.id >= "900"} == {"900", "901"}


def test_batches_are_like_recomputation(spark):
    rng = random.Random(9)
    links = classes = None
    seen = []
    for batch in ([("m", "a", "b", "confirmed", 1), ("n", "b", "c", "confirmed", 1)], decisions(rng, 40), [], [("n", "b", "c", "rejected", 2), ("m", "a", "b", "rejected", 0)], decisions(rng, 60)):
        links, classes = resolution.advanced(links, classes, spark.createDataFrame([*batch, *batch[:2], (None, "q", "r", "confirmed", 1), ("w", "q", None, "confirmed", 1)], resolution.EVENTS))
        seen += batch
        got = classes.collect()
        assert {r.id: r["class"] for r in got} == classes_of(seen) and len(got) == len(classes_of(seen))
    assert {r.id: r["class"] for r in classes.collect()}["c"] == "c"  # the rejected link split its class


def test_store_as_a_sink(spark, tmp_path):
    rng = random.Random(10)
    batches = [decisions(rng, 25) for _ in range(3)]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, resolution.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        store = resolution.Store(spark, str(tmp_path / "store"))
        rows = spark.readStream.schema(resolution.EVENTS).parquet(str(tmp_path / "in"))
        stream.run_available(rows, str(tmp_path / "cursor"), store.advance)
        assert {r.id: r["class"] for r in store.read()[1].collect()} == classes_of(sum(batches[: i + 1], []))
    store.advance(spark.createDataFrame(batches[2], resolution.EVENTS), store.versions()[-1])  # a batch that is run again
    want = classes_of(sum(batches, []))
    assert {r.id: r["class"] for r in store.read()[1].collect()} == want
    some = spark.createDataFrame([(i,) for i in list(want)[:3]], "id string")
    assert store.of(some).count() == 3 and store.pending().filter("status <> 'pending'").count() == 0
    assert resolution.Store(spark, str(tmp_path / "none")).read() == (None, None)


def by_queue(parents, start, most):
    queue, seen, popped = [start], [start], {}
    while queue and len(popped) < most:
        x = queue.pop(0)
        popped[x] = len(popped) + 1
        for p in parents.get(x, []):
            if p in parents and p not in seen:
                seen.append(p)
                queue.append(p)
    return [(start, x, popped.get(x)) for x in seen]


def test_expansions_are_counted_as_by_a_queue(spark):
    rng = random.Random(11)
    parents = {i: [rng.randrange(70) for _ in range(rng.randrange(6))] for i in range(60)}
    parents[7], parents[8] = [8, 7, 8, 999], []
    rows = [(i, [*p, None] if i % 5 == 0 else p) for i, p in parents.items()] + [(61, None)]
    events = spark.createDataFrame(rows, "event_id long, parents array<long>")
    starts = list(range(0, 60, 4)) + [7, 61, 500]
    for most in (1, 5, 20):
        got = graph.causal_walk(events, spark.createDataFrame([(s,) for s in [*starts, 0]], "event_id long"), most).collect()
        want = [r for s in starts if s != 500 for r in by_queue({**parents, 61: []}, s, most)]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_candidates_are_found_by_their_keys(spark):
    rows = [("a", "The Shop", "d1"), ("b", "the-shop!", None), ("c", "Other", "d1"), ("d", "", "a"), ("e", None, ""), ("f", "Shop", "gone"), ("g", "the shop", "d1"), (None, "the shop", "d1"), ("a", "The Shop", "d1")]
    got = text.candidate_links(spark.createDataFrame(rows, "urn string, title string, domain_urn string")).select("left_id", "right_id", "rung").collect()
    assert sorted(map(tuple, got)) == [("a", "b", "name"), ("a", "c", "explicit"), ("a", "d", "explicit"), ("a", "g", "explicit"), ("a", "g", "name")]
    hot = spark.createDataFrame([(f"u{i:04d}", "same", "d") for i in range(1000)], "urn string, title string, domain_urn string")
    assert text.candidate_links(hot).count() == 2 * 999


def test_vector_links_are_near_enough(spark):
    rows = [(i, [float(i == j) + 0.1 * (i + j) for j in range(4)]) for i in range(4)] + [(9, [1.0, 0.1, 0.2, 0.3])]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = {(r.left_id, r.right_id): r.cosine for r in text.vector_links(v, v.withColumnRenamed("id", "query_id"), least=0.9).collect()}
    norm = lambda x: sum(a * a for a in x) ** 0.5
    want = {(i, j): sum(a * b for a, b in zip(x, y)) / norm(x) / norm(y) for i, x in rows for j, y in rows if i < j}
    assert {k: round(c, 4) for k, c in got.items()} == {k: round(c, 4) for k, c in want.items() if c >= 0.9} and got
