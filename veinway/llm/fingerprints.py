"""Lempel-Ziv phrase fingerprints: how far two documents are made of the same dictionary phrases.

A text is parsed greedily (LZ78): the shortest string that is not yet a phrase becomes one. The
phrase set is hashed and kept as a minimum-hash signature; signatures agree about as often as the
phrase sets overlap, so likeness is near to what a common compression dictionary would show.
"""

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import pinned

COLUMNS = ["doc_id", "n_chars", "edited_sha256", "sign", "edited_sign", "near_edited", "near_next"]


def parse(text: str, phrases: set[str], pending: str = "") -> str:
    """Adds the text's phrases to the set, going on from a pending prefix; returns the new pending prefix."""
    for char in text:
        pending += char
        if pending not in phrases:
            phrases.add(pending)
            pending = ""
    return pending


class Signer:
    """Minimum-hash signatures of phrase sets: for each hash function 16 bits of the least value."""

    def __init__(self, size: int = 128, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(1, 1 << 62, size, dtype=np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
        self.b = rng.integers(0, 1 << 63, size, dtype=np.uint64)[:, None]
        self.size = size

    def sign(self, phrases: set[str]) -> bytes:
        if not phrases:
            return bytes(2 * self.size)
        h = np.array([zlib.crc32(p.encode("utf-8", "surrogatepass")) for p in phrases], np.uint64)
        h = (h ^ (h >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
        least = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(h), 2048):
            np.minimum(least, (h[at : at + 2048] * self.a + self.b).min(1), least)
        return ((least * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)).astype("<u2").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return float((np.frombuffer(a, "<u2") == np.frombuffer(b, "<u2")).mean())


def fingerprint_pair(signer: Signer, text: str, following: str) -> tuple[str, bytes, bytes]:
    """(the edited text, signature of the text, of the edited text). The half they share is parsed once."""
    half = len(text) // 2
    keep, tail, edit = text[: len(text) - half], text[len(text) - half :], following[:half]
    phrases: set[str] = set()
    pending = parse(keep, phrases)
    changed = set(phrases)
    parse(tail, phrases, pending)
    parse(edit, changed, pending)
    return keep + edit, signer.sign(phrases), signer.sign(changed)


def fingerprints(docs: DataFrame, signature: int = 128) -> DataFrame:
    """One row per document: n_chars, fingerprint, its edited text's digest and fingerprint, near_edited, near_next.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many (or all)
    of the next document by ascending doc_id; after the last comes the first. Null texts count as
    empty; an empty text has the all-zero fingerprint and is like other empty texts only. Rows
    that repeat a doc_id follow each other in order of text; null doc_ids come first. A single
    document is its own next one. An empty table gives an empty result.

    Documents are sorted by doc_id over range partitions, each task holds two at a time. Only the
    last document of each partition waits for the first of the next one.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    def row(signer: Signer, doc_id, text: str, following: str, next_sign: bytes | None) -> list:
        edited, sign, edited_sign = fingerprint_pair(signer, text, following)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return [doc_id, len(text), digest, sign, edited_sign, likeness(sign, edited_sign), next_sign and likeness(sign, next_sign)]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer, first, last, waiting = Signer(signature), None, None, None
        for batch in batches:
            for at in range(0, len(batch), 500):
                part, out = batch.iloc[at : at + 500], []
                for doc in zip(_ids(part), part["text"], part["part"], strict=True):
                    if last is None:
                        first = doc
                    else:
                        made = row(signer, last[0], last[1], doc[1], None)
                        if waiting:
                            waiting[-1] = likeness(waiting[3], made[3])
                            out.append(waiting)
                        waiting = made
                    last = doc
                yield framed(out)
        if last is not None:
            own = signer.sign(_phrases(last[1]))
            if waiting:
                waiting[-1] = likeness(waiting[3], own)
                yield framed([waiting])
            yield framed([[last[0], *[None] * 6, last[1], first[1], last[2]]])

    def framed(rows: list[list]) -> pd.DataFrame:
        full = [[*r, None, None, None] if len(r) == len(COLUMNS) else r for r in rows]
        return pd.DataFrame(full, columns=[*COLUMNS, "text", "first_text", "part"], dtype=object)

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer = Signer(signature)
        for batch in batches:
            rows = [
                row(signer, doc_id, text, following, signer.sign(_phrases(following)))
                for doc_id, text, following in zip(_ids(batch), batch["text"], batch["following"], strict=True)
            ]
            yield pd.DataFrame(rows, columns=COLUMNS, dtype=object)

    kinds = "doc_id long, n_chars long, edited_sha256 string, sign binary, edited_sign binary, near_edited double, near_next double"
    done = pinned(ordered.mapInPandas(scan, f"{kinds}, text string, first_text string, part int"))
    ends = done.filter("part IS NOT NULL").select("part", "doc_id", "text", "first_text")
    order = sorted(r.part for r in ends.select("part").collect())
    follows = spark.createDataFrame(list(zip(order, order[1:] + order[:1], strict=True)), "part int, next_part int")
    joined = ends.select("part", "doc_id", "text").join(F.broadcast(follows), "part").join(
        ends.select(F.col("part").alias("next_part"), F.col("first_text").alias("following")), "next_part"
    )
    last = joined.select("doc_id", "text", "following").mapInPandas(close, kinds)
    return done.filter("part IS NULL").select(*COLUMNS).unionAll(last).select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.hex("sign")).alias("fingerprint"), F.lower(F.hex("edited_sign")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def _phrases(text: str) -> set[str]:
    phrases: set[str] = set()
    parse(text, phrases)
    return phrases


def _ids(batch: pd.DataFrame) -> list[int | None]:
    return [None if pd.isna(i) else int(i) for i in batch["doc_id"]]
