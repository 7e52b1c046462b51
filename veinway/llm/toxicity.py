"""Toxicity by nearest labelled examples under exact cosine of weighted TF-IDF vectors.

Terms are all lower-cased words of a text and their first four and five letters, hashed to a fixed
number of rows. Document frequencies are counted over all documents and vectors are normed over
the whole text; no term is left out. Terms that are commoner in label 1 weigh more, none weighs
less than its TF-IDF. The k nearest labelled examples are exact: a block-max index of their
postings leaves out blocks of examples only where their bound shows that they hold none of them.
"""

import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import held_out, kept, pinned
from veinway.llm.labelled import training_ids, with_texts

WORD = re.compile(r"[^\W_]+")
#: Rows that terms are hashed to; a task's counts of them leave it in slices.
ROWS, SLICE, SALTS = 1 << 20, 1 << 14, 16


def terms_of(word: str) -> list[str]:
    """A word and its beginnings; a star marks a beginning that is not the whole word."""
    return [word, *(f"{word[:n]}*" for n in (4, 5) if len(word) > n)]


class TermRows(dict):
    """word -> the rows of its terms, worked out when a word is first asked for; up to about `remember_mb`."""

    def __init__(self, remember_mb: int):
        super().__init__()
        self.most, self.used = remember_mb * 1_000_000, 0  # an entry counts about 200 bytes besides its text

    def __missing__(self, word: str) -> bytes:
        rows = b"".join([(zlib.crc32(t.encode("utf-8", "surrogatepass")) % ROWS).to_bytes(4, "little") for t in terms_of(word)])
        if len(word) <= 64:  # longer ones are read whole, but not remembered
            if self.used > self.most:
                self.clear()
                self.used = 0
            self.used += 200 + len(word)
            self[word] = rows
        return rows


class TermReader:
    """Rows and counts of all terms of a text."""

    def __init__(self, remember_mb: int = 50):
        self.known = TermRows(remember_mb)

    def read(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        rows = np.frombuffer(b"".join(map(self.known.__getitem__, WORD.findall((text or "").lower()))), "<i4")
        return np.unique(rows, return_counts=True)


class BlockMaxIndex:
    """Exact k nearest examples by cosine.

    Rare terms have lists of the examples that hold them; the sums over these lists are a lower bound
    of every cosine. Common terms have rows of weights, and for each block of examples their largest
    weight. A block whose bound lies below the k-th largest lower bound holds none of the nearest
    and is not multiplied out. Examples with the same strongest common term are neighbours, so
    that the maxima of a block are close to its weights.
    """

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = 32, common: int = 1024):
        self.n, self.block = len(rows), block
        ids = np.concatenate([np.zeros(0, np.int32), *(r[0] for r in rows)]).astype(np.int32)
        weights = np.concatenate([np.zeros(0, np.float32), *(r[1] for r in rows)]).astype(np.float32)
        of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
        times = np.bincount(ids, minlength=n_terms)
        often = np.argsort(-times, kind="stable")[:common]
        often = often[times[often] > 0]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        width = -(-len(rows) // block) * block
        dense = np.zeros((len(often), width), np.float32)
        in_dense = self.column[ids] >= 0
        dense[self.column[ids[in_dense]], of[in_dense]] = weights[in_dense]
        lead = dense[:, : len(rows)].argmax(0) if len(often) else np.zeros(len(rows), np.int64)
        order = np.lexsort((np.arange(len(rows)), lead))
        #: the example at a place, and the place of an example
        self.example = np.concatenate([order, np.arange(len(rows), width)])
        self.place = np.argsort(self.example)
        self.dense = np.ascontiguousarray(dense[:, self.example])
        self.most = self.dense.reshape(len(often), -1, block).max(2) if width else np.zeros((len(often), 0), np.float32)
        ids, of, weights = ids[~in_dense], self.place[of[~in_dense]].astype(np.int32), weights[~in_dense]
        order = np.argsort(ids, kind="stable")
        self.of, self.weights = of[order], weights[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n_terms))]).astype(np.int64)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest examples with a cosine above 0, the nearest first."""
        return next(self.nearest_of([(ids, weights)], k, [without]))

    def nearest_of(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None, together: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """nearest() of each text."""
        for at in range(0, len(texts), together):
            part = texts[at : at + together]
            left_out = [-1 if x < 0 else self.place[x] for x in (without or [-1] * len(texts))[at : at + together]]
            asked, sums = np.zeros((len(part), len(self.dense)), np.float32), np.zeros((len(part), self.dense.shape[1]), np.float32)
            for i, (ids, weights) in enumerate(part):
                columns = self.column[ids]
                asked[i, columns[columns >= 0]] = weights[columns >= 0]
                self._add_rare(sums[i], ids, weights)
                if left_out[i] >= 0:
                    sums[i, left_out[i]] = 0
            self._add_common(sums, asked, k)
            for row, x in zip(sums, left_out, strict=True):
                if x >= 0:
                    row[x] = 0
                yield self._best(row, k)

    def _add_rare(self, sums: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> None:
        start, many = self.first[ids], self.first[ids + 1] - self.first[ids]
        total = int(many.sum())
        if total:
            where = np.arange(total) + np.repeat(start - np.cumsum(many) + many, many)
            sums += np.bincount(self.of[where], self.weights[where] * np.repeat(weights, many), len(sums)).astype(np.float32)

    def _add_common(self, sums: np.ndarray, asked: np.ndarray, k: int, together: int = 256) -> None:
        """Adds the weights of common terms in all blocks that may hold one of a text's k nearest."""
        if not sums.shape[1] or not len(self.dense):
            return
        least = np.partition(sums, -k, axis=1)[:, -k] if sums.shape[1] > k else np.zeros(len(sums), np.float32)
        bound = asked @ self.most + sums.reshape(len(sums), -1, self.block).max(2)
        needed = bound * 1.00001 >= least[:, None]  # more than rounding can take off
        order = np.argsort(bound.argmax(1), kind="stable")  # texts that need the same blocks are multiplied together
        for at in range(0, len(order), together):
            rows = order[at : at + together]
            blocks = np.flatnonzero(needed[rows].any(0))
            places = (blocks[:, None] * self.block + np.arange(self.block)).ravel()
            sums[np.ix_(rows, places)] += asked[rows] @ self.dense[:, places]

    def _best(self, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        least = max(1e-6, float(np.partition(sums, -k)[-k]) if len(sums) > k else 0.0)
        at = np.flatnonzero(sums >= least)
        found, at = sums[at], self.example[at]
        top = np.lexsort((at, -found))[:k]
        return at[top], found[top]


def weighted(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    w = (1 + np.log(counts)) * idf[ids]
    return (w / max(float(np.sqrt((w * w).sum())), 1e-12)).astype(np.float32)


def relevance(ids: list[np.ndarray], marks: np.ndarray, smooth: float = 5.0) -> np.ndarray:
    """A factor of 1 or more for every term: log2(1 + lift), where lift says how much commoner it is in label 1."""
    yes, no = (np.bincount(np.concatenate([np.zeros(0, np.int32), *(x for x, m in zip(ids, marks, strict=True) if m == y)]), minlength=ROWS) for y in (1, 0))
    lift = (yes + smooth) / (marks.sum() + smooth) / ((no + smooth) / ((1 - marks).sum() + smooth))
    return np.log2(1 + np.maximum(1, lift))


def votes(labels: np.ndarray, at: np.ndarray, sims: np.ndarray) -> list[float]:
    """Inputs of the calibration: the distance-weighted vote, the largest cosine, their product, whether there are neighbours."""
    if not len(at):
        return [0.0, 0.0, 0.0, 0.0]
    vote = float((sims**2 * labels[at]).sum() / (sims**2).sum())
    return [vote, float(sims[0]), vote * float(sims[0]), 1.0]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last coefficient is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * np.r_[beta[:-1], 0]
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def toxicity_scores(docs: DataFrame, labels: DataFrame, most_per_class: int = 1000, k: int = 15, evidence: bool = False) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; with evidence also the nearest examples.

    Labels come from at most `most_per_class` rows of each class outside the held-out fifth. The
    score is the calibrated chance that the label is 1; texts that share no term with an example,
    empty and null ones among them, have no neighbours and share one score. Without labelled rows of
    both classes every score is the share of label 1 (0 without any). Rows that repeat a doc_id
    are scored each; null doc_ids are not held out. An empty table gives an empty result.
    """
    scored = scored_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), docs, labels, most_per_class, k, evidence)
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *(["evidence"] if evidence else []),
    )


def scored_rows(rows: DataFrame, docs: DataFrame, labels: DataFrame, most_per_class: int = 1000, k: int = 15, evidence: bool = False) -> DataFrame:
    """The first column of rows (a key, then text) with score and evidence; frequencies and examples are those of docs."""
    ids, counts = training_ids(labels, "toxic", most_per_class)
    sample = pinned(with_texts(docs.select("doc_id", "text"), ids))
    prior = counts.get(1, 0) / max(1, sum(counts.values()))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TermReader()
        for batch in batches:
            found = [reader.read(t) for t in batch["text"]]
            yield batch[["doc_id", "label"]].assign(terms=[i.tobytes() for i, _ in found], times=[c.astype(np.int32).tobytes() for _, c in found])

    idf = _idf(docs)
    held = sorted(
        (r.doc_id, r.label, bytes(r.terms), bytes(r.times))
        for r in sample.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
        .mapInPandas(features, "doc_id long, label int, terms binary, times binary").toLocalIterator()
    )  # at most 2 * most_per_class rows, unless doc_ids repeat
    marks = np.array([r[1] for r in held], np.float64)
    examples = [r[0] for r in held]
    terms = [np.frombuffer(r[2], np.int32) for r in held]
    both = len(set(marks)) == 2
    factor = idf * relevance(terms, marks) if both else idf
    vectors = [(i, weighted(i, np.frombuffer(r[3], np.int32), factor)) for i, r in zip(terms, held, strict=True)]
    if both:
        index = BlockMaxIndex(vectors, ROWS)
        share = np.array([counts[int(m)] / max(1, (marks == m).sum()) for m in marks])
        x = np.array([votes(marks, *found) for found in index.nearest_of(vectors, k, list(range(len(vectors))))])
        del index
        beta = logistic(x, marks, share / share.mean())
    else:
        beta = np.zeros(5)
        beta[-1] = np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))
    shipped = docs.sparkSession.sparkContext.broadcast((vectors, factor))
    call = uuid.uuid4().hex
    key, kind = rows.columns[0], rows.schema[0].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = shipped.value[1]
        index, reader = kept(("toxicity", call), lambda: (BlockMaxIndex(shipped.value[0], ROWS), TermReader()))
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.iloc[start : start + 512]
                texts = [(i, weighted(i, c, factor)) for i, c in map(reader.read, part["text"])]
                scores, near = [], []
                for at, sims in index.nearest_of(texts, k):
                    z = float(np.dot(votes(marks, at, sims), beta[:-1]) + beta[-1])
                    scores.append(1 / (1 + np.exp(-z)))
                    near.append([{"doc_id": examples[a], "label": int(marks[a]), "cosine": float(s)} for a, s in zip(at, sims, strict=True)] if evidence else [])
                yield pd.DataFrame({key: (part[key].astype("Int64") if kind == "bigint" else part[key]).array, "score": scores, "evidence": near})

    return rows.mapInPandas(score, f"{key} {kind}, score double, evidence array<struct<doc_id: long, label: int, cosine: double>>")


def _idf(docs: DataFrame) -> np.ndarray:
    """The inverse document frequency of every row, from all documents; tables of fixed size are summed in two steps."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, total, n = kept(("terms",), TermReader), np.zeros(ROWS, np.int64), 0
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                total[reader.read(text)[0]] += 1
        salt = zlib.crc32(total.tobytes()) % SALTS
        used = [i for i in range(ROWS // SLICE) if total[i * SLICE : (i + 1) * SLICE].any()]
        yield frame([(i, salt, total[i * SLICE : (i + 1) * SLICE].tobytes()) for i in used] + [(-1, salt, np.array([n], np.int64).tobytes())])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, salt, x in zip(batch["slice"], batch["salt"], batch["sums"], strict=True):
                key, part = (int(i), int(salt)), np.frombuffer(x, np.int64)
                sums[key] = sums[key] + part if key in sums else part
        yield frame([(i, salt, x.tobytes()) for (i, salt), x in sums.items()])

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["slice", "salt", "sums"]).astype({"slice": "int32", "salt": "int32"})

    kinds = "slice int, salt int, sums binary"
    parts = docs.select("text").mapInPandas(count, kinds).repartition("slice", "salt").mapInPandas(add, kinds)
    parts = parts.withColumn("salt", F.lit(0)).repartition("slice").mapInPandas(add, kinds)
    frequency, n = np.zeros(ROWS), 0
    for r in parts.toLocalIterator():
        if r.slice < 0:
            n = int(np.frombuffer(r.sums, np.int64)[0])
        else:
            frequency[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.sums, np.int64)
    return np.log((1 + n) / (1 + frequency)) + 1
