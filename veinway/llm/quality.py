"""Document quality from random-indexing word vectors and a small network.

Every word has a fixed sparse random vector. A word's context vector is the sum of its neighbours'
random vectors over all documents. Documents are pooled from both, and a two-layer network, trained
on a bounded sample of labelled documents and calibrated by a temperature, gives the score. Words
are hashed to a fixed number of rows, so all tables have the same size for any corpus.
"""

import re
import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import held_out, pinned
from veinway.llm.labelled import training_ids

ROWS, DIMS, SLICE, SALTS = 8192, 64, 256, 16
PARTS = re.compile(r"[^\W_]+|[^\w\s]{1,4}|_+")


def random_entries(seed: int = 8, ones: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, signs) of the few entries of every row's index vector, ROWS x ones each."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMS, (ROWS, ones)), rng.choice([-1, 1], (ROWS, ones))


def random_vectors() -> np.ndarray:
    """The index vectors: a few entries of +1 and -1 each, which add up where they fall together."""
    at, sign = random_entries()
    out = np.zeros((ROWS, DIMS), np.float32)
    np.add.at(out, (np.arange(ROWS)[:, None], at), sign)
    return out


class WordReader:
    """Rows of a text's words in reading order, and a few measures of its form."""

    def __init__(self, remember_mb: int = 80):
        self.most, self.used = remember_mb * 1_000_000, 0  # an entry counts about 200 bytes besides its text
        self.known: dict[str, bytes] = {}

    def rows_of(self, word: str) -> bytes:
        """A row for each run of letters or digits, for each mark, and for the way the word is written."""
        parts = [word.lower()] if word.isalpha() else PARTS.findall(word.lower())
        if word.isupper() and len(word) > 1:
            parts.append("<upper>")
        if not word.isalpha() and any(map(str.isdigit, word)):
            parts.append("<digit>")
        if len(word) > 20:
            parts.append("<long>")
        return b"".join([(zlib.crc32(p.encode("utf-8", "surrogatepass")) % ROWS).to_bytes(2, "little") for p in parts])

    def read(self, text: str | None) -> tuple[np.ndarray, list[float]]:
        text = text or ""
        words, known = text.split(), self.known
        distinct = set(words)
        new = [w for w in distinct if w not in known]
        if self.used > self.most:
            known.clear()
            self.used, new = 0, list(distinct)
        for w in new:
            known[w] = self.rows_of(w)
            self.used += 200 + 2 * len(w)
        rows = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u2")
        for w in new:
            if len(w) > 64:  # read whole, but not remembered
                del known[w]
                self.used -= 200 + 2 * len(w)
        n, lines = max(1, len(words)), text.split("\n")
        letters = sum(map(len, words))
        form = [
            np.log1p(len(words)) / 10, len(distinct) / n, sum(map(eq, words, words[1:])) / n, letters / n / 10,
            len(lines) / n, 1 - len(set(lines)) / len(lines), len(rows) / n / 4,
            len(zlib.compress(text.encode("utf-8", "surrogatepass"), 1)) / max(1, len(text)) if text else 0.0,
        ]
        return rows, form


class ContextSums:
    """The sum of the index vectors of every row's left and right neighbours, over many texts, as whole numbers."""

    def __init__(self, together: int = 1_000_000):
        at, sign = random_entries()
        self.codes = [np.ascontiguousarray(c) for c in (2 * at + (sign > 0)).T]
        self.total = np.zeros((ROWS, DIMS), np.int64)
        self.waiting: list[np.ndarray] = []
        self.held, self.together = 0, together

    def add(self, rows: np.ndarray) -> None:
        if len(rows) > 1:
            self.waiting.append(rows)
            self.held += len(rows)
        if self.held >= self.together:
            self.settle()

    def settle(self) -> np.ndarray:
        """The sums so far; neighbours are counted by row and entry, so that no vector is gathered."""
        if self.waiting:
            here, there = (np.concatenate([x[cut] for x in self.waiting]) for cut in (slice(None, -1), slice(1, None)))
            for a, b in ((here, there), (there, here)):
                base = a.astype(np.int64) * (2 * DIMS)
                counts = sum(np.bincount(base + code.take(b), minlength=ROWS * 2 * DIMS) for code in self.codes)
                counts = counts.reshape(ROWS, DIMS, 2)
                self.total += counts[:, :, 1] - counts[:, :, 0]
            self.waiting, self.held = [], 0
        return self.total


FEATURES = "found binary, times binary, form binary"


def read_all(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id with the distinct rows of its words, their counts and its form; index vectors beside unit context vectors).

    The texts are read once. Each task sums its documents' contexts into one table of fixed size and
    emits it in slices; slices are summed in two steps, so that no task reads those of all others.
    Sums are whole numbers: they do not depend on the order of documents.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, sums = WordReader(), ContextSums()
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, out = batch.iloc[at : at + 500], []
                for text in part["text"]:
                    rows, form = reader.read(text)
                    sums.add(rows)
                    found, times = np.unique(rows, return_counts=True)
                    times = times.astype("<u2" if times.max(initial=0) < 1 << 16 else "<u4")
                    out.append((found.astype("<u2").tobytes(), times.tobytes(), np.array(form, "<f4").tobytes()))
                frame = pd.DataFrame(out, columns=["found", "times", "form"], dtype=object)
                yield frame.assign(doc_id=part["doc_id"].astype("Int64").array, slice=-1, salt=0, sums=None)
        total = sums.settle()
        yield sliced(total, zlib.crc32(total.tobytes()) % SALTS).assign(doc_id=None, found=None, times=None, form=None)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for i, salt, x in zip(batch["slice"], batch["salt"], batch["sums"], strict=True):
                key = (int(i), int(salt))
                sums[key] = sums[key] + whole(x) if key in sums else whole(x)
        yield pd.DataFrame([(i, salt, x.tobytes()) for (i, salt), x in sums.items()], columns=["slice", "salt", "sums"])

    def sliced(total: np.ndarray, salt: int) -> pd.DataFrame:
        small = total.astype("<i4") if np.abs(total).max() < 1 << 31 else total
        used = [i for i in range(ROWS // SLICE) if total[i * SLICE : (i + 1) * SLICE].any()]
        return pd.DataFrame([(i, salt, small[i * SLICE : (i + 1) * SLICE].tobytes()) for i in used], columns=["slice", "salt", "sums"])

    def whole(x: bytes) -> np.ndarray:
        return np.frombuffer(x, "<i8" if len(x) == 8 * SLICE * DIMS else "<i4").astype(np.int64)

    kinds = "slice int, salt int, sums binary"
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = pinned(read.mapInPandas(gather, f"doc_id long, {FEATURES}, {kinds}"))
    parts = both.filter("slice >= 0").select("slice", "salt", "sums").repartition(F.col("slice"), F.col("salt")).mapInPandas(add, kinds)
    summed = parts.withColumn("salt", F.lit(0)).repartition(F.col("slice")).mapInPandas(add, kinds)
    context = np.zeros((ROWS, DIMS))
    for r in summed.toLocalIterator():  # ROWS x DIMS numbers
        context[r.slice * SLICE : (r.slice + 1) * SLICE] += whole(r.sums).reshape(SLICE, DIMS)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    return both.filter("slice < 0").select("doc_id", "found", "times", "form"), np.hstack([random_vectors(), context]).astype(np.float32)


def pooled(found: bytes, times: bytes, form: bytes, vectors: np.ndarray) -> np.ndarray:
    """Mean of the word vectors, their share of repeated words, and the measures of form."""
    rows, form = np.frombuffer(found, "<u2"), np.frombuffer(form, "<f4")
    if not len(rows):
        return np.concatenate([np.zeros(vectors.shape[1] + 2), form]).astype(np.float32)
    count = np.frombuffer(times, "<u2" if len(times) == 2 * len(rows) else "<u4")
    share = count / count.sum()
    return np.concatenate([share @ vectors[rows], [len(rows) / count.sum(), share.max()], form]).astype(np.float32)


class Network:
    """Two layers: tanh, then a logit that a temperature divides."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 48, rounds: int = 60, rate: float = 3e-3, decay: float = 1e-3, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.mean) / self.scale
        check = rng.random(len(x)) < 0.15
        if not check.any() or check.all():
            check[:] = False
        fit, y_fit = x[~check], y[~check]
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(rounds):
            order = rng.permutation(len(fit))
            for at in range(0, len(order), 128):
                b = order[at : at + 128]
                h = np.tanh(fit[b] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30))) - y_fit[b]) / len(b)
                dh = np.outer(d, self.w[2]) * (1 - h * h)
                slopes = [fit[b].T @ dh + decay * self.w[0], dh.sum(0), h.T @ d + decay * self.w[2], np.array([d.sum()])]
                t += 1
                for i, g in enumerate(slopes):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        if check.any():
            z, target = self._logit(x[check]), y[check]
            grid = np.geomspace(0.25, 8, 60)
            loss = [np.mean(np.logaddexp(0, z / g) - target * z / g) for g in grid]
            self.temperature = float(grid[int(np.argmin(loss))])

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self._logit((x - self.mean) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, most_per_class: int = 8000, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if score >= threshold).

    Labels come from at most `most_per_class` rows of each class outside the held-out fifth; the
    class shares of all labelled rows are put back into the score. Null and empty texts get the
    score of a text without words. Without labels of both classes every score is the share of
    label 1 (0 without any labels). Rows that repeat a doc_id are scored each, null doc_ids are
    not held out, an empty table gives an empty result.
    """
    ids, counts = training_ids(labels, "quality", most_per_class)
    features, vectors = read_all(docs)
    columns = ["found", "times", "form"]
    sample = features.join(F.broadcast(ids), "doc_id").dropDuplicates([*columns, "label"])  # equal texts once for a label
    order = sorted((r.doc_id, r.label, bytes(r.found), bytes(r.times), bytes(r.form)) for r in sample.select("doc_id", "label", *columns).toLocalIterator())
    y = np.array([r[1] for r in order], np.float64)
    network, shift, prior = None, 0.0, counts.get(1, 0) / max(1, sum(counts.values()))
    if 0 < y.sum() < len(y):
        network = Network(np.array([pooled(*r[2:], vectors) for r in order], np.float64), y)
        shift = float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                if network is None:
                    p = np.full(len(part), prior)
                else:
                    p = network.score(np.array([pooled(*x, vectors) for x in zip(*(part[c] for c in columns), strict=True)], np.float64))
                    p = p * np.exp(shift) / (1 - p + p * np.exp(shift))
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "score": p})

    return features.mapInPandas(score, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
