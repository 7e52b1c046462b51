"""Near-duplicate components by circulant MinHash, banding and exact Jaccard verification.

Documents with equal shingle sets form one class. Signatures of the classes are cut into bands,
classes with an equal band share a bucket. Signatures are compared with that of the bucket's least
member, and what this leaves apart block against block; only a spanning forest of plausible links
is kept. The components of these links are small families. In each family full shingle sets are compared, again block against block, and a
spanning forest of exact links gives the final components. Neither step writes all pairs of a
group, and no block holds more than a fixed number of members.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veinway.llm.common import pinned
from veinway.llm.components import components
from veinway.llm.shingles import ShingleSets, set_digest, shingler

BLOCK = 256
#: Parts that rows which repeat doc_id and text are dealt over when full sets are read.
PARTS = 4


class Forest:
    """Union-find over positions; join() says whether two were apart."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def near_components(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50, rows: int = 7) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest doc_id reachable over links, kept says that it is the document's
    own. A document without words (null, empty or white space) has an empty set and is its own
    component. Rows that repeat a doc_id each get a row; null doc_ids are linked like others, and
    are kept only if all doc_ids of the component are null and then all of them. An empty table
    gives an empty result.

    A pair at exactly the threshold shares no band with a chance of about (1 - 0.8^7)^50, 1 in
    130,000; pairs that share one are never dropped by a cap.
    """
    known, named = _named(docs, words, percent, bands, rows)
    full = known.filter("n_shingles > 0").select("doc_id", "n_shingles", "digest").join(named, "digest")
    empty = known.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return (
        full.select("doc_id", "n_shingles", "component_id")
        .unionAll(empty.select("doc_id", "n_shingles", "component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 50, rows: int = 7) -> DataFrame:
    """One row of each component in the documents' own columns: that of the smallest doc_id, null only if all are null.

    Rows of the component with that doc_id but other texts go too; of rows that repeat doc_id and
    text one stays, decided by a hash of the other columns. Documents without words all stay.
    """
    known, named = _named(docs, words, percent, bands, rows)
    best = named.groupBy("component").agg(F.min("best").alias("winner"))
    full = known.filter("n_shingles > 0").select("doc_id", "text_md5", "digest").join(named, "digest").join(best, "component")
    winner = F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("text_md5") == F.col("winner.text_md5"))
    decided = full.select(row_key("text_md5").alias("key"), winner.alias("won")).distinct()
    others = [f"`{c}`" for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]
    first = Window.partitionBy("key").orderBy("tie")
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("key"), F.xxhash64(*others).alias("tie"))
    left = rows.join(decided, "key", "left").filter(F.coalesce("won", F.lit(True)))
    # rows without words have no decision and all stay
    return left.withColumn("at", F.row_number().over(first)).filter("at = 1 OR won IS NULL").select("row.*")


def row_key(text_md5: str | None = None) -> Column:
    """A text's digest with the row's doc_id, null or not: equal only for rows that repeat both."""
    digest = _md5() if text_md5 is None else F.col(text_md5)
    return F.concat_ws("/", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.hex(digest))


def _named(docs: DataFrame, words: int, percent: int, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(signed documents, for each class of equal sets its component's id and digest, and the least row of the class)."""
    known = pinned(_signed(docs, words, bands, rows))
    classes = pinned(
        known.filter("n_shingles > 0").groupBy("digest").agg(
            F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_md5")).alias("source"),
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5")).alias("best"),
            F.first("bands").alias("bands"), F.first("low").alias("low"),  # equal sets have equal signatures
        )
    )
    # stored between the steps, so that no task runs two Python workers at once
    plausible = pinned(_plausible(classes, percent, bands * rows))
    family = pinned(components(plausible))
    linked = components(pinned(_exact(docs, family, classes, words, percent)))
    least = linked.join(classes, linked.v == classes.digest).groupBy("root").agg(F.min("least_id").alias("component_id"))
    grouped = pinned(linked.join(least, "root").select(F.col("v").alias("digest"), F.col("root").alias("component"), "component_id"))
    return known, pinned(classes.select("digest", "least_id", "best").join(grouped, "digest", "left").select(
        "digest", F.coalesce("component_id", "least_id").alias("component_id"), F.coalesce("component", "digest").alias("component"), "best"
    ))


def _signed(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """A row per document with its set's size and digest, its bands and the low bytes of its signature."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets, ring = shingler(words, bands, rows)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                n, digests, keys, low = [], [], [], []
                for text in part["text"]:
                    found = sets.of(text)
                    n.append(len(found))
                    digests.append(set_digest(found))
                    signature = ring.signature(found)
                    keys.append(ring.band_keys(signature) if len(found) else None)
                    low.append(signature.astype(np.uint8).tobytes() if len(found) else None)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").array, "text_md5": part["text_md5"].array,
                    "n_shingles": n, "digest": digests, "bands": keys, "low": low,
                })

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _md5().alias("text_md5"))
    return read.mapInPandas(sign, "doc_id long, text_md5 binary, n_shingles long, digest binary, bands array<long>, low binary")


def _md5():
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def _in_blocks(members: DataFrame, group: list[str], v: str) -> DataFrame:
    """Gives rows of a group of n members to every pair of its blocks of about BLOCK members; column g names the pair."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64(v), blocks).cast("int")
    return (
        members.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("g", F.xxhash64(*group, F.least("_own", "_other"), F.greatest("_own", "_other")))
        .drop("_own", "_other", "n")
        .repartition("g")
        .sortWithinPartitions("g")
    )


def _groups(batches: Iterator[pd.DataFrame], payload: str) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """(vertices, payloads) of each run of equal g, each vertex once."""
    last, seen = None, {}
    for batch in batches:
        for g, v, x in zip(batch["g"].to_numpy(), batch["v"], batch[payload], strict=True):
            if g != last:
                if len(seen) > 1:
                    yield list(seen), list(seen.values())
                last, seen = g, {}
            seen.setdefault(v, x)
    if len(seen) > 1:
        yield list(seen), list(seen.values())


def _edges(groups: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Of each group's matrix of links a spanning forest, as edges; a third item says which vertices are joined already."""
    a, b = [], []
    for vertices, links, *joined in groups:
        of = joined[0].tolist() if joined else list(range(len(vertices)))
        forest = Forest(len(vertices))
        for i, j in np.argwhere(links).tolist():
            if i < j and forest.join(of[i], of[j]):
                a.append(vertices[i])
                b.append(vertices[j])
        if len(a) > 10_000:
            yield pd.DataFrame({"a": a, "b": b})
            a, b = [], []
    yield pd.DataFrame({"a": a, "b": b})


def _plausible(classes: DataFrame, percent: int, size: int) -> DataFrame:
    """Edges between classes that share a bucket and whose signatures agree about as often as linked sets' do.

    First every member of a bucket is compared with the bucket's least member. Buckets that this
    leaves with more than one label are looked at again: members without the bucket's commonest
    label are compared with all others, block against block.
    """
    p = percent / 100
    least = max(0.0, p - 5.2 * (p * (1 - p) / size) ** 0.5)
    keyed = classes.select(F.col("digest").alias("v"), F.explode("bands").alias("key"))
    low = classes.select(F.col("digest").alias("v"), "low")
    buckets = (
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"), F.sum(F.hash("v").cast("long")).alias("s"), F.bit_xor(F.xxhash64("v")).alias("x"), F.min("v").alias("first"))
        .filter("n > 1")
    )
    # buckets with the same members say the same: one of them is enough
    buckets = pinned(buckets.groupBy("n", "s", "x", "first").agg(F.min("key").alias("key")).select("key", "n", "first"))
    members = pinned(keyed.join(buckets, "key").select("key", "n", "first", "v"))

    pairs = members.filter(F.col("v") != F.col("first")).select("v", "first").distinct()
    pairs = pairs.join(low, "v").withColumnRenamed("low", "a_low").join(low.select(F.col("v").alias("first"), F.col("low").alias("b_low")), "first")

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c]), np.uint8).reshape(len(batch), size) for c in ("a_low", "b_low"))
            yield batch[["v", "first"]][(x == y).mean(1) >= least].rename(columns={"v": "a", "first": "b"})

    stars = pinned(pairs.mapInPandas(alike, "a binary, b binary"))
    # a label that linked members tend to share; it only saves comparisons, so two steps towards the least are enough
    step = stars.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("up"))
    roots = pinned(step.join(step.select(F.col("v").alias("up"), F.col("up").alias("top")), "up", "left").select("v", F.coalesce("top", "up").alias("root")))
    rooted = pinned(
        members.filter("n > 2").join(roots, "v", "left").select("key", "v", F.coalesce("root", "v").alias("root"))
    )
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("m"))
    mixed = pinned(
        parts.groupBy("key").agg(F.count("*").alias("k"), F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("major"))
        .filter("k > 1").select("key", "n", F.col("major.root").alias("major"), (F.col("n") - F.col("major.m")).alias("minor"))
    )
    rest = rooted.join(mixed, "key").join(low, "v")
    return stars.unionAll(_against_minor(rest).mapInPandas(_cross(least), "a binary, b binary"))


def _against_minor(rest: DataFrame) -> DataFrame:
    """Deals members of a bucket so that each one without the commonest label meets all others.

    Blocks of the larger and of the minor part are paired, and blocks of the minor part with each other.
    """
    major_blocks = F.ceil((F.col("n") - F.col("minor")) / BLOCK).cast("int")
    minor_blocks = F.ceil(F.col("minor") / BLOCK).cast("int")
    own = F.xxhash64("v")
    is_minor = F.col("root") != F.col("major")
    mine = F.when(is_minor, F.pmod(own, minor_blocks)).otherwise(-1 - F.pmod(own, major_blocks)).cast("int")
    others = F.when(is_minor, F.sequence(-major_blocks, minor_blocks - 1)).otherwise(F.sequence(F.lit(0), minor_blocks - 1))
    return (
        rest.withColumn("mine", mine).withColumn("other", F.explode(others))
        .withColumn("g", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
        .select("g", "v", F.concat("root", "low").alias("low"))
        .repartition("g").sortWithinPartitions("g")
    )


def _cross(least: float):
    """Plausible links between members with different labels, one for each two labels of a block."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links() -> Iterator[tuple[list[bytes], np.ndarray]]:
            for vertices, found in _groups(batches, "low"):
                root = [x[:16] for x in found]
                s = np.frombuffer(b"".join(x[16:] for x in found), np.uint8).reshape(len(vertices), -1)
                _, of = np.unique(np.array(root, "S16"), return_inverse=True)
                if of.max() == 0:
                    continue
                out = np.zeros((len(s), len(s)), bool)
                for i in range(len(s) - 1):
                    far = i + 1 + np.flatnonzero(of[i + 1 :] != of[i])
                    if len(far):
                        out[i, far] = (s[far] == s[i]).mean(1) >= least
                yield vertices, out, of

        return _edges(links())

    return compare


def _exact(docs: DataFrame, family: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges between classes of one family whose full sets are alike enough."""
    sizes = pinned(family.groupBy("root").agg(F.count("*").alias("n")))
    wanted = (
        family.join(sizes, "root").join(classes, family.v == classes.digest)
        .select("v", "root", "n", F.col("source.doc_id").alias("doc_id"), F.col("source.text_md5").alias("text_md5"))
        .select("v", "root", "n", row_key("text_md5").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    )
    # of rows that repeat doc_id and text one a part stays; the rows lie as the join has dealt them, so nothing is shuffled again
    texts = docs.select(row_key().alias("at"), F.pmod(F.spark_partition_id(), F.lit(PARTS)).alias("part"), "text")
    found = texts.join(wanted.hint("shuffle_hash"), ["at", "part"]).dropDuplicates(["at", "part"]).select("root", "n", "v", "text")

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = ShingleSets(words)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                yield part[["root", "n", "v"]].assign(elements=[sets.of(t).tobytes() for t in part["text"]])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links() -> Iterator[tuple[list[bytes], np.ndarray]]:
            for vertices, found in _groups(batches, "elements"):
                yield vertices, jaccard_links([np.frombuffer(x, np.uint64) for x in found], percent)

        return _edges(links())

    members = found.mapInPandas(elements, "root binary, n long, v binary, elements binary")
    return _in_blocks(members, ["root"], "v").select("g", "v", "elements").mapInPandas(compare, "a binary, b binary")


def jaccard_links(sets: list[np.ndarray], percent: int, columns: int = 8192) -> np.ndarray:
    """The matrix of pairs with 100 * intersection >= percent * union, from exact counts."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    row, column = row[shared], column[shared]
    if not len(column):
        return np.zeros((len(sets), len(sets)), bool)
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column.max()) + 1, columns):
        inside = (column >= at) & (column < at + columns)
        matrix = np.zeros((len(sets), columns), np.float32)
        matrix[row[inside], column[inside] - at] = 1
        both += matrix @ matrix.T
    both = np.rint(both).astype(np.int64)
    return (both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
