"""Bounded samples of labelled documents for the classifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinway.llm.common import held_out, pinned


def training_ids(labels: DataFrame, label: str, most_per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label) of at most `most_per_class` rows of each class, and how many there are of each class.

    Rows of the held-out fifth and null labels are left out; a document that is labelled twice
    counts once, by its larger label. Which rows are taken depends on a hash of doc_id alone.
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    )
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_per_class) for c in (0, 1)]
    return pinned(parts[0].unionAll(parts[1])), counts


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sampled documents' texts, each text once for a label; ids is bounded, so it is broadcast."""
    return docs.join(F.broadcast(ids), "doc_id").dropDuplicates(["text", "label"])
