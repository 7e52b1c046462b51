"""Vector best-fit packing of token pieces into sequences.

A piece is a vector (tokens, 1 document, tokens squared as attention cost) that depends on its
length alone, so the plan is made over counts by length: at most `max_tokens` numbers reach the
driver, however large the corpus. The plan says which ranks of a length go to which sequences;
Spark numbers the pieces of each length and looks their place up.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import numbered, pinned
from veinway.llm.tokens import encoder

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "norm") -> np.ndarray:
    """Rows (length, first rank, how many, first sequence, offset), for pieces by falling length.

    Sequences with the same residual capacities are one class. Pieces of one length go to the
    class that fits under all three capacities with the least weighted residual norm afterwards
    (rule "norm") or the largest weighted dot product of residual and piece ("dot"); where none
    fits, new sequences are opened and filled with as many pieces of that length as they hold.
    """
    cap, scale = np.array(capacity, float), np.array(weights, float)
    # sequences by their residual capacities: their runs [first sequence, how many]; only classes that have any
    residual, keys, classes, place = np.zeros((64, 3)), [], [], {}
    runs, sequences = [], 0

    def add(res: np.ndarray, run: list[int]) -> None:
        nonlocal residual
        at = place.setdefault(tuple(res), len(keys))
        if at == len(keys):
            if at == len(residual):
                residual = np.vstack([residual, np.zeros_like(residual)])
            residual[at] = res
            keys.append(tuple(res))
            classes.append([])
        classes[at].append(run)

    def drop(at: int) -> None:
        del place[keys[at]]
        key, rest = keys.pop(), classes.pop()
        if at < len(keys):
            keys[at], classes[at], residual[at] = key, rest, residual[len(keys)]
            place[key] = at

    for length in sorted(counts, reverse=True):
        left, rank, size = counts[length], 0, np.array([length, 1.0, float(length) ** 2])
        while left:
            after = residual[: len(keys)] - size
            fits = (after >= 0).all(1)
            if fits.any():
                if rule == "norm":
                    cost = ((scale * np.maximum(after, 0) / cap) ** 2).sum(1)
                else:
                    cost = -((residual[: len(keys)] / cap) * (size / cap) * scale).sum(1)
                cost = np.where(fits, cost, np.inf)
                best = min(np.flatnonzero(cost == cost.min()), key=lambda i: keys[i])
                first, many = classes[best].pop()
                take = min(left, many)
                runs.append((length, rank, take, first, int(cap[0] - residual[best, 0])))
                if take < many:
                    classes[best].append([first + take, many - take])
                res = after[best].copy()
                if not classes[best]:
                    drop(best)
                add(res, [first, take])
                rank, left = rank + take, left - take
                continue
            each = int(min(cap // size))
            if not each:
                raise ValueError(f"a piece of {length} tokens fits no sequence")
            many = left // each or 1
            hold = min(each, left)
            for j in range(hold):
                runs.append((length, rank, many, sequences, j * length))
                rank, left = rank + many, left - many
            add(cap - hold * size, [sequences, many])
            sequences += many
    return np.array(runs, np.int64).reshape(-1, 5)


def cut(docs: DataFrame, path: str, max_tokens: int, end_id: int, remember_mb: int) -> DataFrame:
    """The pieces of each document: only documents of more than max_tokens ids are cut, the first piece may be shorter."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path, remember_mb), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, rows = batch.iloc[at : at + 500], []
                for doc_id, ids in zip(part["doc_id"], enc.encode([t or "" for t in part["text"]]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n % max_tokens or max_tokens) if not start else max_tokens
                        rows.append((doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                        start, piece = start + length, piece + 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(pieces, PIECE_SCHEMA)


def pack(
    docs: DataFrame, path: str, max_tokens: int = 2048, max_docs: int | None = None, max_cost: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", end_id: int = 0, remember_mb: int = 240,
) -> DataFrame:
    """Packs every document into sequences under token, document-count and attention-cost capacities.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Null and
    empty texts are one end id. No sequence holds more than max_docs pieces, nor pieces whose squared
    lengths add up to more than max_cost; where one is None, no packing can reach it. (A piece of
    max_tokens must fit, so a max_cost below max_tokens squared raises ValueError where there is one.)
    Every worker remembers at most about remember_mb of encoded words.
    Repeated rows and null doc_ids are packed like others; an empty table gives an empty result.
    """
    pieces = pinned(cut(docs, path, max_tokens, end_id, remember_mb))
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, (max_tokens, max_docs or max_tokens, max_cost or max_tokens**2), weights, rule)
    base, total = {}, 0
    for length in sorted(counts, reverse=True):
        base[length], total = total, total + counts[length]
    first = np.array([base[int(r[0])] + r[1] for r in runs], np.int64)
    order = np.argsort(first)
    first, sequence, offset = first[order], runs[order, 3], runs[order, 4]
    by_length = np.zeros(max_tokens + 1, np.int64)
    for length, b in base.items():
        by_length[length] = b

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = by_length[length.to_numpy()] + rank.to_numpy()
        run = np.searchsorted(first, at, "right") - 1
        return pd.DataFrame({"sequence_id": sequence[run] + at - first[run], "offset": offset[run]})

    ranked = numbered(pieces, "length", [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "rank", total)
    return ranked.withColumn("at", place("length", "rank")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"
    )
