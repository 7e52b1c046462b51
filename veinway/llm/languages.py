"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language has a raw-content dictionary for zstandard: sampled text of that language, nothing
else. A text is cut into blocks that are compressed alone against every dictionary, so that a long
text's later blocks cannot draw on its own beginning; the sums of compressed sizes are compared.
A prediction whose margin over the second language is narrow is rejected.
"""

import zlib
from collections.abc import Iterator
from math import exp

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import pinned

UNKNOWN = "und"
#: ASCII characters that are no letters become spaces; bytes of other characters stay.
LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def normal(text: str) -> bytes:
    """Lower case, one space for each run of ASCII characters other than letters."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learned_rows(doc_id: Column | str) -> Column:
    """True for the documents that dictionaries may be made of: crc32 of the decimal doc_id, mod 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % 3 != 1, F.lit(False))


def dictionaries(
    docs: DataFrame, size: int = 65_536, documents: int = 256, pieces: int = 2, piece_chars: int = 512, most_languages: int = 64
) -> dict[str, bytes]:
    """For each language its dictionary of up to `size` bytes, made of the (lang, text) rows of `docs`.

    It is fitted on a bounded sample: of each of the `documents` parts into which a hash deals the texts, the text of
    least hash, and of it the `pieces` pieces of `piece_chars` characters that hash least. Equal
    texts hash alike, so any number of copies counts as one. Of more than `most_languages`
    languages the commonest are learned. Rows without language or letters are not learned from;
    an empty table gives no dictionary.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    common = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).select("lang")
    dealt = known.withColumn("hash", F.xxhash64("text")).withColumn("part", F.pmod("hash", F.lit(documents)))
    least = pinned(dealt.groupBy("lang", "part").agg(F.min("hash").alias("hash")).join(F.broadcast(common), "lang", "left_semi"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                if has_letter(text):
                    parts = {normal(text[i : i + piece_chars]) for i in range(0, len(text), piece_chars)} - {b""}
                    rows |= {(lang, p) for p in sorted(parts, key=lambda p: (zlib.crc32(p), p))[:pieces]}
            yield pd.DataFrame(list(rows), columns=["lang", "piece"])

    sampled = dealt.join(F.broadcast(least), ["lang", "part", "hash"], "left_semi").select("lang", "text")
    found: dict[str, list[bytes]] = {}
    for r in sampled.mapInPandas(cut, "lang string, piece binary").distinct().collect():
        found.setdefault(r.lang, []).append(bytes(r.piece))
    made = {}
    for lang, own in sorted(found.items()):
        chosen, used = [], 0
        for p in sorted(own, key=lambda p: (zlib.crc32(p), p)):
            if used + len(p) < size:
                chosen.append(p)
                used += len(p) + 1
        made[lang] = b" ".join(chosen)
    return made


class Compressors:
    """The compressed size of texts against each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, block: int):
        self.block = block
        self.each = {
            lang: zstandard.ZstdCompressor(
                level=level, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            for lang, content in sorted(dictionaries.items())
        }

    def sizes(self, text: str) -> dict[str, int]:
        raw = normal(text)
        sizes = dict.fromkeys(self.each, 0)
        for at in range(0, len(raw), self.block):
            part = raw[at : at + self.block]
            for lang, z in self.each.items():
                sizes[lang] += len(z.compress(part))
        return sizes


def judged(sizes: dict[str, int], narrow: float) -> tuple[str, float, float, bool]:
    """(language of least size, score, margin, rejected). Equal sizes: the language that sorts first.

    The margin is the part of the second least size that the least one saves, 1 with one language alone. The
    score is the winner's share of exp(-size / (1 + least size / 100)).
    """
    best = min(sizes, key=lambda k: (sizes[k], k))
    least = sizes[best]
    second = min((s for k, s in sizes.items() if k != best), default=None)
    margin = 1.0 if second is None else (second - least) / second
    score = 1 / sum(exp((least - s) / (1 + least / 100)) for s in sizes.values())
    return best, score, margin, margin < narrow


def languages(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = 0.01, level: int = 9, block: int = 8192) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, margin, rejected.

    Whole texts are read. A text that is null or without a letter is `und`, score 0, margin 0 and rejected, and
    so is every text where there is no dictionary. A prediction with a margin under `narrow`
    keeps its language and is marked as rejected. Repeated rows come out as often as they are
    there, null doc_ids are handed on, an empty table is an empty result; other columns of `docs`
    are not read. Nothing is shuffled: each task gets the dictionaries, whose number and size are bounded.
    """

    @F.arrow_udf("struct<lang_pred:string,score:double,margin:double,rejected:boolean>")
    def judge(text: pa.Array) -> pa.Array:
        compressors = Compressors(dictionaries, level, block)
        texts = (t.as_py() for t in text)
        rows = [judged(compressors.sizes(t), narrow) if dictionaries and has_letter(t) else (UNKNOWN, 0.0, 0.0, True) for t in texts]
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * 4
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), judge("text").alias("found")).select("doc_id", "found.*")
