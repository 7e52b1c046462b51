"""Do claims stand in their sources, word for word or nearly?"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinway.lineage import pinned

FUZZY = 0.95
GRAM = 4


def least_distance(needle: str, text: str, stop: int) -> int:
    """The least number of edits from the needle to any part of the text, or stop + 1 where it is more.

    Bit-parallel: one column of the alignment table is two numbers of as many bits as the needle is long.
    """
    size = len(needle)
    if not size:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(needle):
        at[c] = at.get(c, 0) | 1 << i
    top, every = 1 << size - 1, (1 << size) - 1
    up, down, score, best = every, 0, size, size
    for c in text:
        same = at.get(c, 0)
        x = (((same & up) + up) ^ up) | same | down
        grown, shrunk = down | ~(x | up) & every, up & x
        score += bool(grown & top) - bool(shrunk & top)
        grown, shrunk = grown << 1 & every, shrunk << 1 & every  # a part may begin anywhere: no edit at the upper edge
        up, down = shrunk | ~((same | down) | grown) & every, grown & (same | down)
        best = min(best, score)
    return min(best, stop + 1)


def regions(needle: str, text: str, edits: int) -> list[tuple[int, int]]:
    """Where a part of the text within so many edits can lie: windows that share enough grams with the needle.

    An edit spoils as many grams as a gram is long, so len(needle) - GRAM + 1 - GRAM * edits of them must be there.
    """
    need, width = len(needle) - GRAM + 1 - GRAM * edits, len(needle) + edits
    if need <= 0 or len(text) <= width:
        return [(0, len(text))]

    def grams(t: str) -> np.ndarray:
        codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        out = codes[: len(codes) - GRAM + 1].copy()
        for i in range(1, GRAM):
            out = out * np.uint64(0x110003) + codes[i : len(codes) - GRAM + 1 + i]
        return out

    hits = np.concatenate([[0], np.cumsum(np.isin(grams(text), grams(needle)))])
    span = width - GRAM + 1
    counts = hits[span:] - hits[:-span] if len(hits) > span else hits[-1:]
    starts = np.flatnonzero(counts >= need)
    out: list[tuple[int, int]] = []
    for start in starts.tolist():
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], start + width
        else:
            out.append((start, start + width))
    return [(a, min(b, len(text))) for a, b in out]


def best_ratio(needle: str, text: str) -> float | None:
    """1 - edits / length for the part of the text that is nearest to the needle; None where that is below FUZZY."""
    edits = int(round((1 - FUZZY) * len(needle), 9))
    best = edits + 1
    for a, b in regions(needle, text, edits):
        best = min(best, least_distance(needle, text[a:b], edits))
    return None if best > edits else 1 - best / len(needle)


def normal(text: Column) -> Column:
    """Lower case, with one space for each run of white space."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def verified(claims: DataFrame, sources: DataFrame, claim: str = "claim", file: str = "file", text: str = "text") -> DataFrame:
    """The claims with status and ratio: confirmed (1.0), fuzzy (at least .95), hallucinated (null) or skipped (null).

    A claim is held against the source of its file, both with white space and case made alike. It is
    confirmed where it stands there, and fuzzy where some part of the source differs by at most one edit in twenty
    characters. Without text, or a source of that file, it is skipped. Every part of a source counts, however
    long it is; of several sources of one file the best result does. What is contained is settled by the JVM; only other pairs are aligned.
    """

    @F.arrow_udf("double")
    def nearest(needles: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([best_ratio(n.as_py(), t.as_py()) for n, t in zip(needles, texts, strict=True)], pa.float64())

    rows = pinned(claims.withColumn("_id", F.monotonically_increasing_id()).withColumn("_needle", normal(F.col(claim))))
    there = sources.select(F.col(file), normal(F.col(text)).alias("_hay")).filter("_hay IS NOT NULL")
    pairs = rows.filter("_needle <> ''").select("_id", "_needle", file).join(there, file)
    inside = pairs.withColumn("_inside", F.contains("_hay", "_needle"))
    told = inside.filter("_inside").select("_id", F.lit(1.0).alias("ratio")).unionByName(inside.filter("NOT _inside").select("_id", nearest("_needle", "_hay").alias("ratio")))
    best = told.groupBy("_id").agg(F.max("ratio").alias("ratio"), F.lit(True).alias("_read"))
    status = F.when(F.col("_read").isNull(), "skipped").when(F.col("ratio") == 1.0, "confirmed").when(F.col("ratio").isNotNull(), "fuzzy").otherwise("hallucinated")
    return rows.join(best, "_id", "left").withColumn("status", status).select(*claims.columns, "status", "ratio")
