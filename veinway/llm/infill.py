"""Fill-in-middle by block rotation: a text's middle goes to its end, and back again, inside one buffer.

The cuts of a text are found by a scan over its bytes. Sentinels are set before the prefix, the
middle and the suffix in one bytearray, and neighbouring segments change places by three reversals,
so that nothing but the buffer and two blocks of 64 KiB is held. Restoring finds the sentinels in
the output, rotates the other way round and takes them out: no cut has to be remembered.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK = 1 << 16
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(view: np.ndarray, start: int, end: int) -> None:
    """Reverses view[start:end] in place, a block from each end at a time."""
    while end - start > 1:
        size = min(BLOCK, (end - start) // 2)
        left = view[start : start + size].copy()
        view[start : start + size] = view[end - size : end][::-1]
        view[end - size : end] = left[::-1]
        start, end = start + size, end - size


def rotate(view: np.ndarray, start: int, middle: int, end: int) -> None:
    """Exchanges the neighbouring segments view[start:middle] and view[middle:end]."""
    reverse(view, start, middle)
    reverse(view, middle, end)
    reverse(view, start, end)


def _starts(raw: np.ndarray, at: int) -> np.ndarray:
    """For each byte of the block at `at`: does a unit `[A-Za-z]+|[^A-Za-z]` start there?"""
    low = max(at - 1, 0)
    part = raw[low : at + BLOCK]
    letter = ((part | 0x20) - np.uint8(97)) < 26
    inside = (part & 0xC0) == 0x80
    inside[1:] |= letter[1:] & letter[:-1]
    return ~inside[at - low :]


class Units:
    """The units of a UTF-8 text: how many there are, and where each starts."""

    def __init__(self, text: bytes):
        self.raw = np.frombuffer(text, np.uint8)
        self.upto = [0]  # units that start before each block
        for at in range(0, len(self.raw), BLOCK):
            self.upto.append(self.upto[-1] + int(np.count_nonzero(_starts(self.raw, at))))

    def __len__(self) -> int:
        return self.upto[-1]

    def start(self, unit: int) -> int:
        """The byte at which a unit starts; the text's length for the one after the last."""
        if unit >= len(self):
            return len(self.raw)
        block = int(np.searchsorted(self.upto, unit, "right")) - 1
        return block * BLOCK + int(np.flatnonzero(_starts(self.raw, block * BLOCK))[unit - self.upto[block]])


def chars(text: bytes | memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def plan(doc_id: int | None, text: bytes, n: int, seed: int, rate: int, spm_rate: int) -> tuple[str, int, int]:
    """(form, units before the middle, units before the suffix). A null doc_id counts as an empty number."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[i : i + 4]) for i in (0, 4, 8, 12)]
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= rate:
        return "plain", 0, 0
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return "spm" if h[3] % 100 < spm_rate else "psm", first, second


def turned(text: bytes, form: str, first: int, second: int) -> bytearray:
    """The output of a text cut at two bytes: prefix, middle and suffix with sentinels, then one rotation."""
    buffer = bytearray(PREFIX)
    view = memoryview(text)
    for part in (view[:first], MIDDLE, view[first:second], SUFFIX, view[second:]):
        buffer += part
    middle, suffix = first + 3, second + 6
    rotate(np.frombuffer(buffer, np.uint8), middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def turned_back(output: bytes, form: str) -> bytes:
    """The text of an output, from the output and its form alone."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    if form == "psm":  # prefix, suffix, middle
        start, border = output.index(SUFFIX), output.index(MIDDLE)
    else:  # suffix, prefix, middle
        start, border = 0, output.index(PREFIX)
    rotate(np.frombuffer(buffer, np.uint8), start, border, len(buffer))
    suffix = start + len(buffer) - border
    middle = buffer.index(MIDDLE)
    del buffer[suffix : suffix + 3], buffer[middle : middle + 3], buffer[:3]
    return bytes(buffer)


def _binary(texts: pa.Array):
    """Each string's bytes, null as empty, one at a time."""
    return (x.as_py() or b"" for x in texts.cast(pa.large_binary()))


def _strings(rows: list[bytes | bytearray]) -> pa.Array:
    return pa.array(rows, pa.large_binary()).cast(pa.large_string()).cast(pa.string())


def fill_in_middle(docs: DataFrame, seed: int = 1, rate: int = 90, spm_rate: int = 20) -> DataFrame:
    """One row per document: doc_id, n units, form, prefix_chars, middle_chars, output.

    Of documents without a sentinel, `rate` in 100 are turned, `spm_rate` in 100 of them with the
    suffix first; which, and where they are cut, follows from the seed and doc_id alone. Null texts
    count as empty; an empty text is plain, n 0. A null doc_id counts as an empty number. Repeated
    rows come out as often as they are there, an empty table is an empty result, and other columns
    of `docs` are not read. Nothing is shuffled; a task holds a batch of rows.
    """

    @F.arrow_udf(f"struct<{MADE.replace(' ', ':').replace(',:', ',')}>")
    def made(doc_id: pa.Array, text: pa.Array) -> pa.Array:
        rows = []
        for key, raw in zip(doc_id, _binary(text), strict=True):
            units = Units(raw)
            form, first, second = plan(key.as_py(), raw, len(units), seed, rate, spm_rate)
            if form == "plain":
                rows.append((len(units), form, None, None, raw))
            else:
                a, b = units.start(first), units.start(second)
                rows.append((len(units), form, chars(raw[:a]), chars(raw[a:b]), bytes(turned(raw, form, a, b))))
        n, form, prefix, middle, output = zip(*rows, strict=True) if rows else [()] * 5
        return pa.StructArray.from_arrays(
            [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _strings(output)],
            ["n", "form", "prefix_chars", "middle_chars", "output"],
        )

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), made(doc_id, F.col("text")).alias("made")).select("doc_id", "made.*")


def original(output: Column | str, form: Column | str) -> Column:
    """The text that `fill_in_middle` turned into `output`; null where one of the two is null."""

    @F.arrow_udf("string")
    def back(output: pa.Array, form: pa.Array) -> pa.Array:
        pairs = zip(output.cast(pa.large_binary()), form, strict=True)
        return _strings([turned_back(o.as_py(), f.as_py()) if o.is_valid and f.is_valid else None for o, f in pairs])

    return back(output, form)
