"""Joins on what texts contain, without comparing every pair."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.lineage import pinned


#: The longest gram, in bytes, that is a number as it is: with its size it fills a whole number of eight bytes, so equal numbers are equal grams.
LONGEST = 7
#: The sizes of grams. Those above LONGEST are numbers by a hash of 56 bits below the size's place among these.
SIZES = [*range(1, 17), *range(20, 33, 4), *range(40, 65, 8)]
#: The sieve of grams that are looked for: so many bits (8 MB), whatever the number of names.
SIEVE_BITS = 26
MIXER = 0x9E3779B97F4A7C15
ALL_BITS = (1 << 64) - 1


def folded(left, right):
    """A hash of two, for numbers (below 2^64) and for arrays of them alike."""
    one = isinstance(left, int)
    mixer, shift, cut = (MIXER, 32, ALL_BITS) if one else (np.uint64(MIXER), np.uint64(32), np.uint64(ALL_BITS))
    x = left * mixer + right & cut
    x = (x ^ x >> shift) * mixer & cut
    return x ^ x >> shift


def block_number(block: bytes) -> int:
    """The number of 8, 16, 32 or 64 bytes."""
    half = len(block) // 2
    return int.from_bytes(block, "big") if half == 4 else folded(block_number(block[:half]), block_number(block[half:]))


def gram_number(gram: bytes) -> int:
    """The number of a gram of one of the SIZES; a long one is that of the two blocks, of the largest power of two, at its ends."""
    n = len(gram)
    if n <= LONGEST:
        return n << 56 | int.from_bytes(gram, "big")
    width = 1 << n.bit_length() - 1
    return SIZES.index(n) + 1 << 56 | folded(block_number(gram[:width]), block_number(gram[n - width :])) & (1 << 56) - 1


def numbers_by_size(d: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the sizes, ascending, the numbers of all grams of bytes d by their place, as gram_number gives them."""
    value, width = np.zeros(len(d), np.uint64), 8
    for n in range(1, min(sizes[-1], 8) + 1):
        value = value[: max(0, len(d) - n + 1)] << np.uint64(8) | d[n - 1 :]
        if n <= LONGEST and n in sizes:
            yield n, value | np.uint64(n << 56)
    for n in sizes:
        if LONGEST < n <= len(d):
            while width * 2 <= n:
                value, width = folded(value[:-width], value[width:]), width * 2
            yield n, folded(value[: len(d) - n + 1], value[n - width :]) & np.uint64((1 << 56) - 1) | np.uint64(SIZES.index(n) + 1 << 56)


def literal_grams(names: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_name, _gram, _slot, _whole): the grams that every match of a LIKE pattern holds, those of its literal parts, of the longest size that it has.

    `_slot` is a gram's place in the sieve; `_whole` tells that the gram is all of the name.
    """
    for batch in names:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for name in batch.column(0).to_pylist():
            parts = re.split(b"[%_]", name.encode())
            most = max(map(len, parts))
            n = max((size for size in SIZES if size <= most), default=0)
            whole = len(parts) == 1 and len(parts[0]) <= LONGEST
            for gram in sorted({part[i : i + n] for part in parts for i in range(len(part) - n + 1)}) if n else ():
                number = gram_number(gram)
                for column, value in zip(out, (name, number, (number * MIXER & ALL_BITS) >> 64 - SIEVE_BITS, whole), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())], ["_name", "_gram", "_slot", "_whole"])


def sieve(wanted: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The bits of the wanted grams by words of 64 (number and bits of each that isn't empty; 2^20 at most), and the grams' sizes."""
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    words = wanted.groupBy(F.shiftright("_slot", 6).alias("word")).agg(F.bit_or(bit(F.col("_slot").bitwiseAND(63))).alias("bits"), F.bit_or(bit(F.shiftright("_gram", 56))).alias("sizes")).toArrow()
    sizes = int(np.bitwise_or.reduce(words["sizes"].to_numpy())) if len(words) else 0
    return words["word"].to_numpy(), words["bits"].to_numpy().view(np.uint64), [n for i, n in enumerate(SIZES, 1) if sizes >> i & 1]


def gram_lists(body: DataFrame, kept: tuple[np.ndarray, np.ndarray, list[int]], most_bytes: int = 1 << 20) -> DataFrame:
    """(_row, _gram): the grams of texts (_row, _text) that pass the sieve, each once a row; about `most_bytes` of text are looked at at a time."""
    numbers, bits, sizes = kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << SIEVE_BITS - 6, np.uint64)
        words[numbers] = bits
        for batch in batches:
            text = batch.column(1).cast(pa.large_binary())
            rows = batch.column(0).to_numpy()
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2], np.uint8)
            first = 0
            while first < len(rows):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + most_bytes, "right")) - 1)
                d = data[ends[first] : ends[last]].astype(np.uint64)
                of = np.repeat(np.arange(first, last), np.diff(ends[first : last + 1]))
                left = ends[of + 1] - ends[first] - np.arange(len(d))  # bytes of the text from here on
                found_rows, found = [], []
                for n, number in numbers_by_size(d, sizes):
                    slot = number * np.uint64(MIXER) >> np.uint64(64 - SIEVE_BITS)
                    at = np.flatnonzero((words[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool) & (left[: len(number)] >= n))
                    found_rows.append(of[at])
                    found.append(number[at])
                r, g = np.concatenate(found_rows or [of[:0]]), np.concatenate(found or [d[:0]])
                order = np.lexsort((g, r))
                r, g = r[order], g[order]
                once = np.ones(len(r), bool)
                once[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(rows[r[once]]), pa.array(g[once].view(np.int64))], ["_row", "_gram"])
                first = last

    return body.mapInArrow(cut, "_row long, _gram long") if sizes else body.select("_row", F.lit(0).cast("long").alias("_gram")).limit(0)


HOLDS = "_whole OR _text LIKE concat('%', _name, '%') ESCAPE '\\0'"


def near_names(body: DataFrame, names: DataFrame, rows_a_task: int) -> tuple[DataFrame, bool]:
    """(_row, _name, _whole) of texts (_row, _text) that may hold a name (_name), both in lower case and not empty, and surely do where `_whole`; and whether all rows are sure. body must be stored."""
    wanted = pinned(names.select("_name").distinct().mapInArrow(literal_grams, "_name string, _gram long, _slot long, _whole boolean"))
    kept = sieve(wanted)
    lengths = gram_lists(body, kept).groupBy("_gram").agg(F.count("*").alias("_n"))
    least = F.min_by(F.struct("_gram", "_slot", "_whole", "_n"), F.struct("_n", "_gram")).alias("least")
    rarest = pinned(wanted.join(lengths, "_gram", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).groupBy("_name").agg(least).select("_name", "least.*").filter("_n > 0"))
    lists = gram_lists(body, sieve(rarest))
    salts = F.ceil(F.col("_n") / rows_a_task).cast("int")
    long = rarest.filter(F.col("_n") > rows_a_task).select("_gram", salts.alias("_salts")).distinct()  # no more than there are gram places by rows_a_task
    dealt = lists.join(F.broadcast(long), "_gram", "left").select("_row", "_gram", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_salts")), F.lit(0)).cast("int").alias("_salt"))
    asked = rarest.select("_name", "_gram", "_whole", F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    return dealt.join(asked, ["_gram", "_salt"]).select("_row", "_name", "_whole"), rarest.filter("NOT _whole").isEmpty()


def held_names(body: DataFrame, names: DataFrame, rows_a_task: int) -> DataFrame:
    """(_row, _name): which texts (_row, _text) hold which names (_name)."""
    near, sure = near_names(body, names, rows_a_task)
    return (near if sure else near.join(body, "_row").filter(HOLDS)).select("_row", "_name")


def substring_join(texts: DataFrame, names: DataFrame, text: str, name: str, rows_a_task: int = 50_000) -> DataFrame:
    """All pairs of a row of `texts` and a row of `names` with text ILIKE '%' || name || '%'; the columns of both sides.

    An inverted index maps grams of up to 64 bytes to texts; of a text only grams that pass a sieve of
    the names' grams are written. A name looks at one list only, that of the rarest gram of its literal parts,
    which are as long as the longest part allows; a gram of up to seven bytes that is the whole name needs no comparing, other texts on the list are
    compared. A list of more than `rows_a_task` texts is dealt over several tasks. `%` and `_` in a name match
    as they do in LIKE; a name without any other character matches nothing, nor does a null. A
    backslash in a name is an ordinary character. Names that are equal but for case share one search.
    """
    left = pinned(texts.withColumn("_row", F.monotonically_increasing_id()))
    body = left.select("_row", F.lower(text).alias("_text")).filter("_text <> ''")
    near, sure = near_names(body, names.select(F.lower(name).alias("_name")).filter("_name <> ''"), rows_a_task)
    met = left.withColumn("_text", F.lower(text)).join(near, "_row")
    found = (met if sure else met.filter(HOLDS)).drop("_row", "_text", "_whole")
    return found.join(names.withColumn("_name", F.lower(name)), "_name").drop("_name")


def backfilled(nodes: DataFrame, batch: DataFrame, node_key: str, external: str, qualified: str, simple: str, rows_a_task: int = 50_000) -> DataFrame:
    """(node_key, qualified, rule) of the batch row that each node takes over.

    An equal qualified name comes first; else the row whose simple name stands in the external id, the
    longest of several, then the least qualified name. Nodes without a match have no row. Names are
    looked for from the longest down, those of one length up to seven at a time, and only in ids that have found none yet.
    """
    left = pinned(nodes.select(node_key, external).withColumn("_row", F.monotonically_increasing_id()))
    rows = batch.select(F.col(qualified).alias("_qualified"), F.length(simple).alias("_length"), F.lower(simple).alias("_name"))
    exact = left.join(rows.select(F.col("_qualified").alias(external)).distinct(), external).select("_row", F.struct(F.lit("exact").alias("rule"), F.lit(0).alias("back"), F.col(external).alias("qualified")).alias("best"))
    hits = pinned(exact)
    named = rows.filter("_name <> ''").groupBy("_name").agg(F.min(F.struct(F.lit("substring").alias("rule"), (-F.col("_length")).alias("back"), F.col("_qualified").alias("qualified"))).alias("best"))
    named = pinned(named.withColumn("_class", F.least(-F.col("best.back"), F.lit(LONGEST + 1))))
    classes = sorted((r[0] for r in named.select("_class").distinct().collect()), reverse=True)  # eight at most
    open_rows, found = left.select("_row", F.lower(external).alias("_text")).filter("_text <> ''"), [hits]
    for each in classes:
        open_rows = pinned(open_rows.join(found[-1], "_row", "left_anti"))
        own = named.filter(F.col("_class") == each).select("_name", "best")
        pairs = held_names(open_rows, own, rows_a_task)
        found.append(pinned(pairs.join(own, "_name").groupBy("_row").agg(F.min("best").alias("best"))))
    every = found[0]
    for hits in found[1:]:
        every = every.unionAll(hits)
    best = left.select("_row", node_key).join(every, "_row").groupBy(node_key).agg(F.min("best").alias("best"))
    return best.select(node_key, F.col("best.qualified").alias(qualified), "best.rule")


def resolved_calls(calls: DataFrame, symbols: DataFrame, most: int = 3) -> DataFrame:
    """(caller, callee, confidence, sites) for call sites (caller, callee_text) and symbols (urn, qualified_name, name).

    Of a callee's text the arguments and a leading `this.` or `self.` go. A symbol of that qualified name is
    called with confidence .95; else symbols of its last name are, with .70, if there are `most`
    or fewer. Nobody calls himself. Sites of one text are resolved once, and symbols of a name that
    is too common to count are dropped before the join, so no common name is joined to all its symbols.
    """
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace("callee_text", r"(?s)\(.*$", ""), r"^(this|self)\.", ""), r"^\s+|\s+$", "")
    sites = pinned(calls.withColumn("text", clean).filter("text <> ''").groupBy("caller", "text").agg(F.count("*").alias("sites")))
    last = F.regexp_extract("text", r"([^.]*)$", 1)
    texts = sites.select("text").distinct().withColumn("name", last)
    own = symbols.select("urn", "qualified_name", "name").distinct()
    exact = texts.join(own, (texts.text == own.qualified_name) & (texts.name == own.name)).select("text", "urn", F.lit(0.95).alias("confidence"))
    exact = pinned(exact)
    few = own.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select("name")
    loose = texts.join(exact.select("text").distinct(), "text", "left_anti").join(own.join(few, "name"), "name").select("text", "urn", F.lit(0.70).alias("confidence"))
    met = sites.join(exact.unionByName(loose), "text").filter("urn <> caller")
    return met.groupBy("caller", F.col("urn").alias("callee")).agg(F.max("confidence").alias("confidence"), F.sum("sites").alias("sites"))
