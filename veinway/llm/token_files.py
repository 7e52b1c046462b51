"""Token-id files: documents in ascending doc_id order, range-coded in checksummed blocks.

A file set is a folder of Parquet files, written and read by Spark in any store. A row is a
segment: whole documents of one part, their ids and lengths, and their token ids in blocks that
each start from nothing (see range_coder). Blocks are coded for thousands at a time.
"""

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.llm.common import shared_dir
from veinway.llm.range_coder import pack_ids, unpack_ids
from veinway.llm.tokens import encoder

SEGMENT_IDS, WRITE_IDS = 500_000, 6_000_000
FILE_SCHEMA = "part int, segment int, first long, n_ids long, id_bits int, doc_ids binary, no_id binary, lengths binary, payload binary"


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = 0, id_bits: int = 16, parts: int | None = None) -> None:
    """Writes every document's ids and the end id. Null texts count as empty; null doc_ids come first.

    Rows that repeat a doc_id are written in order of text. An empty table writes files without
    segments. `parts` range partitions of doc_id are written by as many tasks.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
        .withColumn("part", F.spark_partition_id())
    )

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, first, number = 0, 0, 0
        segments: list[tuple[list, list[bytes]]] = [([], [])]
        size = held = 0

        def flush() -> pd.DataFrame:
            nonlocal first, number, segments, size, held
            full = [s for s in segments if s[0]]
            ids = [np.frombuffer(b"".join(s[1]), "<u4") for s in full]
            rows = []
            for (doc_ids, texts), own, payload in zip(full, ids, pack_ids(ids, id_bits), strict=True):
                none = np.array([d is None for d in doc_ids])
                rows.append((
                    part, number, first, len(own), id_bits, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.packbits(none).tobytes(),
                    np.array([len(t) // 4 for t in texts], "<u4").tobytes(), payload,
                ))
                first, number = first + len(own), number + 1
            segments, size, held = [([], [])], 0, 0
            return pd.DataFrame(rows, columns=[c.split()[0] for c in FILE_SCHEMA.split(", ")])

        for batch in batches:
            for at in range(0, len(batch), 500):
                some = batch.iloc[at : at + 500]
                part = int(some["part"].iloc[0])
                for doc_id, ids in zip(some["doc_id"], enc.encode(list(some["text"])), strict=True):
                    segments[-1][0].append(None if pd.isna(doc_id) else int(doc_id))
                    segments[-1][1].append(ids + end)
                    size += len(ids) // 4 + 1
                    held += len(ids) // 4 + 1
                    if size >= SEGMENT_IDS:
                        segments.append(([], []))
                        size = 0
                if held >= WRITE_IDS:
                    yield flush()
        yield flush()

    ordered.mapInPandas(code, FILE_SCHEMA).write.option("compression", "none").parquet(folder)


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document of a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked.

    Every block's checksum is verified. Only the number of ids of each part reaches the driver.
    """
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    counts = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = {}, 0
    for part, n in counts:
        before[part], total = total, total + n

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 12):
                some = batch.iloc[at : at + 12]
                for row, ids in zip(some.itertuples(), unpack_ids(list(some["payload"]), int(some["id_bits"].iloc[0])), strict=True):
                    lengths = np.frombuffer(row.lengths, "<u4").astype(np.int64)
                    none = np.unpackbits(np.frombuffer(row.no_id, np.uint8))[: len(lengths)].astype(bool)
                    ends = np.cumsum(lengths)
                    parts = np.split(ids.astype("<u4"), ends[:-1])
                    out = pd.DataFrame({
                        "doc_id": pd.array(np.frombuffer(row.doc_ids, "<i8"), dtype="Int64"),
                        "start": before[row.part] + row.first + ends - lengths, "n_tokens": lengths,
                        "ids_crc32": [zlib.crc32(p.tobytes()) for p in parts],
                    })
                    out.loc[none, "doc_id"] = pd.NA
                    if with_ids:
                        out["ids"] = [p.astype(np.int32) for p in parts]
                    yield out

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return files.mapInPandas(decode, kinds)


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """Writes the documents' token files into the shared folder and returns what is read back from them."""
    folder = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path)
    return read_tokens(docs.sparkSession, folder)
