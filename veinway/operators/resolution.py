"""Decisions on which records are the same thing, kept as they come, and the classes that follow from them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinway.lineage import pinned

EVENTS = "match_id string, a string, b string, status string, at long"


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, class): the least id that each vertex (id) reaches over edges (a, b), itself included.

    Labels go to neighbours and then take over their label's label, so that distances halve; rounds
    end when no label changes. A vertex's labels are reduced to one before each shuffle.
    """
    both = edges.select("a", "b").unionAll(edges.select("b", "a")).toDF("id", "other").distinct()
    both = pinned(both.filter("id <> other"))
    labels = pinned(vertices.select("id").distinct().withColumn("class", F.col("id")))
    while True:
        heard = both.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("class").alias("heard"))
        least = labels.join(heard, "id", "left").select("id", "class", F.least("class", F.coalesce("heard", "class")).alias("least"))
        least = pinned(least)
        if least.filter("least <> class").isEmpty():
            return labels
        jump = least.select(F.col("id").alias("least"), F.col("least").alias("next"))
        labels = pinned(least.join(jump, "least", "left").select("id", F.least("least", F.coalesce("next", "least")).alias("class")))


def latest(events: DataFrame) -> DataFrame:
    """Of each match the last decision by (at, then status, a and b); columns as in EVENTS. Events without a match, an end or a time are left out."""
    known = events.select("match_id", "a", "b", "status", "at").dropna(subset=["match_id", "a", "b", "at"])
    last = F.max(F.struct("at", F.coalesce("status", F.lit("pending")).alias("status"), "a", "b")).alias("last")
    return known.groupBy("match_id").agg(last).select("match_id", "last.a", "last.b", "last.status", "last.at")


def advanced(links: DataFrame | None, classes: DataFrame | None, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, classes) after a batch of decisions (`confirmed`, `rejected` or `pending`).

    Links are the last decision on each match, classes are (id, class) with the least id of each class as its
    name. Only classes with an end of a link that was made or taken back are built anew, from the
    confirmed links among their members: a rejection can split them. Events of a batch may
    come in any order, late or twice.
    """
    spark = events.sparkSession
    links = spark.createDataFrame([], EVENTS) if links is None else links
    classes = spark.createDataFrame([], "id string, class string") if classes is None else classes
    now = pinned(latest(links.unionByName(events.select(*links.columns))))
    on = lambda df: df.filter("status = 'confirmed'").select("match_id", "a", "b")
    changed = on(now).exceptAll(on(links)).unionAll(on(links).exceptAll(on(now)))
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("id"))
    touched = ends(changed).distinct()
    hit = classes.join(touched, "id", "left_semi").select("class").distinct()
    fresh = ends(now).distinct().join(classes, "id", "left_anti")
    members = pinned(classes.join(hit, "class", "left_semi").select("id").unionAll(fresh).distinct())
    inside = on(now).join(members.select(F.col("id").alias("a")), "a", "left_semi")
    made = components(members, inside)
    return now, pinned(classes.join(members, "id", "left_anti").unionByName(made))


class Store:
    """Versions of links and classes as Parquet below a folder that all machines share; one version for each batch.

    A batch that is run again, after a failure, starts from the version before it and writes the
    same one anew, so `advance` can be the sink of a stream.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def versions(self) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        whole = [s.getPath() for s in fs.listStatus(at) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "classes/_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in whole)

    def read(self, version: int | None = None) -> tuple[DataFrame | None, DataFrame | None]:
        """(links, classes) of a version, else of the last one; None where there is none."""
        known = self.versions()
        version = (known[-1] if known else None) if version is None else version
        if version not in known:
            return None, None
        return tuple(self.spark.read.parquet(f"{self.folder}/v{version}/{name}") for name in ("links", "classes"))

    def advance(self, events: DataFrame, batch: int) -> None:
        before = [v for v in self.versions() if v < batch]
        links, classes = advanced(*(self.read(before[-1]) if before else (None, None)), events)
        links.write.mode("overwrite").parquet(f"{self.folder}/v{batch}/links")
        classes.write.mode("overwrite").parquet(f"{self.folder}/v{batch}/classes")

    def pending(self) -> DataFrame | None:
        links, _ = self.read()
        return links and links.filter("status = 'pending'")

    def of(self, ids: DataFrame) -> DataFrame | None:
        """(id, class) of the asked ids (id)."""
        _, classes = self.read()
        return classes and classes.join(ids.select("id").distinct(), "id", "left_semi")
