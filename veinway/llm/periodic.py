"""Runs of repeated words, found with string synchronising sets.

A run is a stretch of words that repeats with a smallest period and is as long as it can be. For
each dyadic scale t, positions are selected by the least hash among the t-word windows around them,
so that equal contexts of 2t words select equal positions. A run whose period p has 3t <= p < 6t holds a
selected position and its copy p words on; two selected positions with equal contexts therefore
propose a period. Inside stretches of a period of at most t / 3 nothing is selected: these are
detected on their own (periods up to 5 at once, longer ones as runs of the scales below), and where two of
one period touch, they propose the periods that the selection leaves out. Each proposal is
extended both ways by comparing words, so what is returned is exact.

Many documents are searched at once: they are joined into one array with a different negative
number between them, which no run can contain.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECT = 5  # periods up to this one are detected by comparing each word with the one a period before
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * MIX[0]
    h ^= h >> MIX[2]
    h *= MIX[1]
    return h ^ (h >> MIX[2])


def _stretches(true: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.flatnonzero(np.diff(true.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def equal_ahead(w: np.ndarray, a: int, b: int) -> int:
    """How many words from b on equal those from a on (a < b)."""
    done, step = 0, 32
    while b + done < len(w):
        x = w[b + done : b + done + step]
        differ = np.flatnonzero(w[a + done : a + done + len(x)] != x)
        if len(differ):
            return done + int(differ[0])
        done, step = done + len(x), min(2 * step, 1 << 16)
    return done


def equal_behind(w: np.ndarray, a: int, b: int) -> int:
    """How many words just before b equal those just before a (a < b)."""
    done, step = 0, 32
    while done < a:
        n = min(step, a - done)
        differ = np.flatnonzero(w[a - done - n : a - done] != w[b - done - n : b - done])
        if len(differ):
            return done + n - 1 - int(differ[-1])
        done, step = done + n, min(2 * step, 1 << 16)
    return done


class Runs:
    """Found stretches (start, end) with the smallest period that was found for each."""

    def __init__(self, w: np.ndarray):
        self.w, self.period = w, {}

    def add(self, start: int, end: int, p: int) -> None:
        if end - start >= 2 * p:
            self.period[start, end] = min(p, self.period.get((start, end), p))

    def direct(self) -> None:
        """All stretches of small periods; those of two periods and 4 words at least."""
        for p in range(1, min(DIRECT, len(self.w) - 1) + 1):
            starts, ends = _stretches(self.w[p:] == self.w[:-p])
            long = ends - starts >= max(p, 4 - p)
            for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
                self.add(start, end + p, p)

    def extend(self, at: np.ndarray, p: np.ndarray) -> None:
        """Proposals: words from at on repeat p words later. Those inside a stretch that was just found are skipped."""
        order = np.lexsort((at, p))
        last_p = last_end = -1
        for x, q in zip(at[order].tolist(), p[order].tolist(), strict=True):
            if q == last_p and x < last_end:
                continue
            ahead = equal_ahead(self.w, x, x + q)
            last_p, last_end = q, x + ahead
            if ahead:
                self.add(x - equal_behind(self.w, x, x + q), x + ahead + q, q)

    def regular(self, shortest: int, longest_period: int) -> np.ndarray:
        """(start, end, period) of the stretches of at least `shortest` words and at most that period, by period and start."""
        rows = [(p, s, e) for (s, e), p in self.period.items() if p <= longest_period and e - s >= shortest]
        return np.array(sorted(rows), np.int64).reshape(-1, 3)[:, [1, 2, 0]]


def _selected(h: np.ndarray, hidden: np.ndarray, t: int) -> np.ndarray:
    """Positions i at which one of the windows i and i + t has the least hash of all windows from i to i + t, hidden ones aside."""
    seen = np.where(hidden, NONE, h)
    least, width = seen, 1
    while width < t:  # t is a power of two
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(seen) - t], seen[t:])
    return np.flatnonzero((least != NONE) & ((least == seen[: len(seen) - t]) | (least == seen[t:])))


def _proposals(places: np.ndarray, context: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) for selected positions of equal contexts, 3t to 6t - 1 words apart.

    A context that is selected is not regular, so its copies lie more than t / 3 words apart: the loop ends after fewer than 19 rounds.
    """
    order = np.lexsort((places, context))
    places, context = places[order], context[order]
    shift = 1
    while shift < len(places):
        gap = places[shift:] - places[:-shift]
        near = (context[shift:] == context[:-shift]) & (gap < 6 * t)
        if not near.any():
            return
        wanted = near & (gap >= 3 * t)
        yield places[:-shift][wanted], gap[wanted]
        shift += 1


def _touching(w: np.ndarray, regular: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, period) for two stretches of one small period of which the second starts before the first ends."""
    for (a, a_end, q), (b, b_end, q2) in zip(regular[:-1].tolist(), regular[1:].tolist(), strict=True):
        if q != q2 or b > a_end or a_end - a < 3 * t - q or b_end - b < 3 * t - q:
            continue
        root = w[b : b + q]
        for shift in range(q):  # of the q rotations of the first stretch's root at most one is the second's
            if np.array_equal(w[a_end - q - shift : a_end - shift], root):
                first = (b - (a_end - q - shift)) % q
                p = np.arange(first, min(6 * t, a_end - a + 1), q)
                p = p[p >= 3 * t]
                yield a_end - p, p
                break


def find_runs(w: np.ndarray, pieces: np.ndarray) -> dict[tuple[int, int], int]:
    """{(start, end): period} of all runs of 12 words and two periods at least, in words given by numbers.

    `pieces` are the borders of the documents inside w, from 0 to len(w); what no long period fits
    into is left aside at the larger scales.
    """
    runs = Runs(w)
    runs.direct()
    h, t = _mixed(w.astype(np.uint64) + np.uint64(1)), 1
    lengths = np.diff(pieces)
    at = None  # places of w that are left, where some documents are aside
    while 12 * t <= int(lengths.max(initial=0)):
        t *= 2
        joined = _mixed(h[: len(h) - t // 2] * MIX[1] + h[t // 2 :])  # windows of t words
        h = np.concatenate([joined, h[len(h) - t // 2 :]])  # the last ones reach over the end: no document's
        fits = lengths >= 6 * t
        if fits.sum() < len(fits) / 2:
            keep = np.repeat(fits, lengths)
            at, h, lengths = (np.flatnonzero(keep) if at is None else at[keep]), h[keep], lengths[fits]
        regular = runs.regular(t, t // 3)
        border = np.zeros(len(w) + 1, np.int32)
        np.add.at(border, regular[:, 0], 1)
        np.add.at(border, regular[:, 1] - t + 1, -1)
        hidden = np.cumsum(border[:-1]) > 0
        hidden = hidden if at is None else hidden[at]
        context = _mixed(h[: len(h) - t] * MIX[1] + h[t:])
        places = _selected(h, hidden, t)
        whole = places if at is None else at[places]
        for found in (*_proposals(whole, context[places], t), *_touching(w, runs.regular(3 * t - t // 3, t // 3), t)):
            runs.extend(*found)
    return {(s, e): p for (s, e), p in runs.period.items() if e - s >= max(12, 2 * p)}


def batch_runs(texts: list[bytes]) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """For each text its words and its runs (start, length, period) by start, then period."""
    words = [t.split() for t in texts]  # ASCII white space only, as these are bytes
    numbers: dict[bytes, int] = {}
    for x in words:
        for y in x:
            numbers.setdefault(y, len(numbers))
    lengths = np.array([len(x) + 1 for x in words], np.int64)
    pieces = np.concatenate([[0], np.cumsum(lengths)])
    w = np.empty(int(pieces[-1]), np.int64)
    for i, x in enumerate(words):
        w[pieces[i] : pieces[i + 1] - 1] = [numbers[y] for y in x]
        w[pieces[i + 1] - 1] = -2 - i
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    runs = find_runs(w, pieces)
    if runs:
        keys = np.array(list(runs), np.int64)
        for (s, e), p, i in zip(keys.tolist(), runs.values(), (np.searchsorted(pieces, keys[:, 0], "right") - 1).tolist(), strict=True):
            found[i].append((s - int(pieces[i]), e - s, p))
    return [(x, sorted(f, key=lambda r: (r[0], r[2]))) for x, f in zip(words, found, strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by one space."""
    if not runs:
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, together: int = 100_000) -> DataFrame:
    """One row per document: doc_id, n_words, runs (an array of start, length, period, by start, then period), collapsed text.

    Words are separated by ASCII white space. Null texts count as empty: no words, no runs, an
    empty collapsed text. Repeated rows come out as often as they are there; doc_id, null or not, is handed on; an
    empty table is an empty result, and other columns of `docs` are not read. Nothing is shuffled;
    a task searches documents of about `together` words at a time, a longer one alone.
    """

    @F.arrow_udf("struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>")
    def search(text: pa.Array) -> pa.Array:
        out, waiting, size = [], [], 0
        for raw in text.cast(pa.large_binary()):
            waiting.append(raw.as_py() or b"")
            size += len(waiting[-1])
            if size > 6 * together:
                out += map(answer, batch_runs(waiting))
                waiting, size = [], 0
        out += map(answer, batch_runs(waiting))
        n_words, runs, kept = zip(*out, strict=True) if out else [()] * 3
        mark = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        texts = pa.array(kept, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(mark)), texts], ["n_words", "runs", "collapsed"])

    def answer(found: tuple[list[bytes], list[tuple[int, int, int]]]) -> tuple[int, list[dict], bytes]:
        words, runs = found
        return len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], collapsed(words, runs)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), search("text").alias("found")).select("doc_id", "found.*")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document in ten repeats its own words from some word on.

    Which documents, the word and the period follow from crc32 of the decimal doc_id (null: of
    the empty string); the others keep their text as it is.
    """
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n = F.size("words").cast("long")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    g = F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    cycles = F.floor((n - a) / p) + 1
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("words", (a + 1).cast("int"), p.cast("int")), cycles.cast("int"))), F.lit(1), (n - a).cast("int"))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), repeated), " ")
    chosen: Column = (h % 10 == 0) & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.when(chosen, words).alias("words"))
        .select("doc_id", F.when(F.col("words").isNotNull(), new).otherwise(F.col("text")).alias("text"))
    )


def digests(runs: DataFrame) -> DataFrame:
    """The rows of `periodic_runs` with their runs as a digest, and the longest run (ties: smallest start, then period)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("small"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))))
    return runs.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), best.alias("best"),
    ).select(
        "doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.small")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.small")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
