"""Greedy chunks against a loop, claims against alignment of every part."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veinway.operators import chunking, verification


def by_loop(sizes, budget):
    chunk, fill, out = 0, None, []
    for s in sizes:
        if fill is not None and fill + s > budget:
            chunk, fill = chunk + 1, s
        else:
            fill = s if fill is None else fill + s
        out.append(chunk)
    return out


def test_tables_tell_what_a_loop_does():
    rng = random.Random(1)
    for _ in range(300):
        budget = rng.randrange(1, 40)
        sizes = [rng.choice([0, 1, 3, rng.randrange(60)]) for _ in range(rng.randrange(1, 30))]
        above, fills, begun, total, fresh, fresh_begun = chunking.transition(np.array(sizes), budget)
        for fill in [None, 0, 1, budget // 2, budget, budget + 5]:
            all_sizes = sizes if fill is None else [fill, *sizes]
            chunks = by_loop(all_sizes, budget)
            last = sum(s for s, c in zip(all_sizes, chunks, strict=True) if c == chunks[-1])
            if fill is None:
                assert (fresh, fresh_begun) == (last, chunks[-1])
            else:
                met = next((i for i, low in enumerate(above) if fill > low), None)
                assert ((fill + total, 0) if met is None else (fills[met], begun[met])) == (last, chunks[-1])


@pytest.mark.parametrize("block", [3, 50, 10_000])
def test_chunks_of_a_long_key_over_many_tasks(spark, block):
    rng = random.Random(block)
    rows = [("hot", i, rng.choice([0, 5, rng.randrange(300)])) for i in range(900)] + [(None, i, 40) for i in range(20)] + [(f"k{i % 7}", i, rng.randrange(150)) for i in range(100)]
    rows[5] = ("hot", 5, None)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, pos long, size int").withColumns({"n": F.lit("own"), "chunk2": F.lit(1), "block": F.lit(2)}).repartition(6)
    got = chunking.chunked(df, "key", ["pos"], F.col("size"), 200, block)
    assert got.columns == [*df.columns, "chunk"]
    found = {(r.key, r.pos): r.chunk for r in got.collect()}
    for key in {r[0] for r in rows}:
        own = sorted((p, s or 0) for k, p, s in rows if k == key)
        assert [found[key, p] for p, _ in own] == by_loop([s for _, s in own], 200)
    assert len(found) == len(rows) and chunking.chunked(df.limit(0), "key", ["pos"], F.col("size"), 9).count() == 0


def edits(needle, text):
    """Least edits to any part of the text, by the whole table."""
    row = list(range(len(needle) + 1))
    best = row[-1]
    for c in text:
        diagonal, row[0] = row[0], 0
        for i, x in enumerate(needle, 1):
            diagonal, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, diagonal + (x != c))
        best = min(best, row[-1])
    return best


def test_nearest_part_is_that_of_the_whole_table():
    rng = random.Random(6)
    for n in range(250):
        text = "".join(rng.choice("abcdef gé") for _ in range(rng.randrange(400)))
        a = rng.randrange(len(text) + 1)
        needle = list(text[a : a + rng.choice([8, 30, 60, 140])] or "none")
        for _ in range(rng.randrange(9)):
            i = rng.randrange(len(needle))
            needle[i] = rng.choice(["", "x", needle[i] * 2, needle[i]])
        needle = "".join(needle) or "y"
        least = edits(needle, text)
        assert verification.least_distance(needle, text, 10**6) == least
        within = least <= int(round(0.05 * len(needle), 9))
        assert verification.best_ratio(needle, text) == (1 - least / len(needle) if within else None), n


def test_claims(spark):
    body = "SELECT  name,\n total FROM orders WHERE status = 'open' AND total > 100 ORDER BY name"
    rows = [(1, "select name, TOTAL\tfrom orders", "a"), (2, body.replace("status", "state").replace("100", "1000"), "a"), (3, body.replace("orders", "order"), "a"), (4, "nothing like it at all", "a"), (5, None, "a"), (6, " \n", "a"), (7, "select", "gone"), (8, "select", None), (1, "select name, TOTAL\tfrom orders", "a")]
    claims = spark.createDataFrame(rows, "id long, claim string, file string").withColumn("ratio0", F.lit(1))
    sources = spark.createDataFrame([("a", "x " * 4000 + body + " y" * 4000), ("a", "other"), ("b", None)], "file string, text string")
    got = sorted(((r.id, r.status, round(r.ratio, 3) if r.ratio else None) for r in verification.verified(claims, sources).collect()), key=str)
    length = len(" ".join(body.split()))
    fuzzy = round(1 - 1 / (length - 1), 3)
    assert got == [(1, "confirmed", 1.0), (1, "confirmed", 1.0), (2, "fuzzy", round(1 - 3 / length, 3)), (3, "fuzzy", fuzzy), (4, "hallucinated", None), (5, "skipped", None), (6, "skipped", None), (7, "skipped", None), (8, "skipped", None)]
