"""Text mining: names, glossary terms, assumptions, contracts, SQL references and schema text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinway.operators import retrieval

# Rules that results depend on.
ASSUMPTION_RULES = [
    ("explicit_jsdoc", r"(?i)@assumption\s+(.+)", "low", 0.95), ("explicit_python", r"(?i)#\s*ASSUMPTION:\s*(.+)", "low", 0.95), ("explicit_js", r"(?i)//\s*ASSUME:\s*(.+)", "low", 0.95),
    ("non_null_ts", r"(\w+)!\.(\w+)", "medium", 0.70), ("guard_throw", r"if\s*\(\s*!(.+?)\s*\)\s*(?:throw|raise)", "high", 0.85), ("assert", r"\bassert\s*\((.+?)\)", "high", 0.90),
    ("invariant", r"\binvariant\s*\((.+?)\)", "critical", 0.95), ("zod_parse", r"\.parse\s*\((.+?)\)", "medium", 0.80),
]
METHODS = "GET|POST|PUT|PATCH|DELETE"


def normal_name(name: Column) -> Column:
    """Lower case, marks and runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def terms(text: Column) -> Column:
    """Distinct capitalised phrases and all-caps words."""
    phrases = F.regexp_extract_all(text, F.lit("([A-Z][a-z]+( [A-Z][a-z]+)+)"), F.lit(1))
    caps = F.regexp_extract_all(text, F.lit("([A-Z]{2,})"), F.lit(1))
    return F.array_distinct(F.concat(phrases, caps))


def glossary(docs: DataFrame, text: str, source: str) -> DataFrame:
    """(term, occurrences, sources) over all documents."""
    return docs.select(source, F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(
        F.count("*").alias("occurrences"), F.count_distinct(source).alias("sources")
    )


def aliases(terms: DataFrame) -> DataFrame:
    """Terms with the same normal form; the canonical one has most occurrences, then is longest, then last in order."""
    best = F.max(F.struct("occurrences", F.length("term").alias("len"), "term"))
    return terms.groupBy(normal_name(F.col("term")).alias("norm")).agg(
        best.alias("best"), F.count("*").alias("forms"), F.sum("occurrences").alias("total")
    ).select("norm", F.col("best.term").alias("canonical"), "forms", "total")


def assumptions(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, rule, severity, confidence, hits) for each rule that a text meets."""
    each = [
        F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.regexp_count(F.col(text), F.lit(pattern)).alias("hits"))
        for name, pattern, severity, confidence in ASSUMPTION_RULES
    ]
    return docs.select(id_column, F.explode(F.filter(F.array(*each), lambda r: r["hits"] > 0)).alias("r")).select(id_column, "r.*")


def normal_path(path: Column) -> Column:
    """Route paths with their parameters made alike: {x}, :x and numbers become {}."""
    return F.regexp_replace(F.regexp_replace(F.lower(path), r"\{[^}/]*\}|:[a-z_]+", "{}"), r"/[0-9]+(?=/|$)", "/{}")


def sql_references(df: DataFrame, id_column: str, sql: str) -> DataFrame:
    """(id, etype, target): tables that a statement reads and writes, by the words before them."""
    low = F.lower(F.col(sql))
    names = lambda pattern: F.array_distinct(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)))
    reads = F.transform(names(r"\b(?:from|join)\s+([a-z_][a-z0-9_.]*)"), lambda t: F.struct(F.lit("READS_TABLE").alias("etype"), t.alias("target")))
    writes = F.transform(names(r"\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+([a-z_][a-z0-9_.]*)"), lambda t: F.struct(F.lit("WRITES_TABLE").alias("etype"), t.alias("target")))
    return df.select(id_column, F.explode(F.concat(reads, writes)).alias("r")).select(id_column, "r.*").distinct()


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def shape_overlap(a: Column, b: Column) -> Column:
    """Shared elements over the length of the longer array; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.greatest(F.size(a), F.size(b))), F.lit(0.0))


def decided(left_id: str, right_id: str, links: DataFrame) -> DataFrame:
    """(left, right, rung, confidence, decision) of candidate links (left, right, rung, cosine): the surest rung of each pair.

    Rungs: explicit .95, name .82, embedding the cosine but .72 at most where it is .80 at least, human 1.
    From .80 on a pair is joined by itself, from .60 on it is suggested, others are kept apart.
    """
    sure = (
        F.when(F.col("rung") == "human", 1.0).when(F.col("rung") == "explicit", 0.95).when(F.col("rung") == "name", 0.82)
        .when((F.col("rung") == "embedding") & (F.col("cosine") >= 0.80), F.least(F.col("cosine"), F.lit(0.72)))
    )
    best = links.withColumn("confidence", sure).filter("confidence IS NOT NULL").groupBy(left_id, right_id).agg(F.max(F.struct("confidence", "rung")).alias("best"))
    decision = F.when(F.col("confidence") >= 0.80, "auto").when(F.col("confidence") >= 0.60, "suggest").otherwise("apart")
    return best.select(left_id, right_id, "best.rung", "best.confidence").withColumn("decision", decision)


def resolution_id(a: Column, b: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.array_sort(F.array(a, b)))), 1, 12)


def resolve_by_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (left_id, right_id) of the same normal name, by an equi-join on it; empty names match nothing."""
    a = left.select(F.col("id").alias("left_id"), normal_name(F.col("name")).alias("norm")).filter("norm <> ''")
    b = right.select(F.col("id").alias("right_id"), normal_name(F.col("name")).alias("norm"))
    return a.join(b, "norm").select("left_id", "right_id", "norm", resolution_id(F.col("left_id"), F.col("right_id")).alias("resolution_id"), F.lit(0.82).alias("confidence"))


def candidate_links(rows: DataFrame) -> DataFrame:
    """(left_id, right_id, rung, cosine) for `decided`: who may be the same of (urn, title, domain_urn), by equi-joins.

    Records that name one domain are linked, and a record to the record whose urn it names as its
    domain (`explicit`); so are records of one normal title (`name`). A group of n equal records gives n - 1 links,
    from each to the least urn, and not all pairs: their classes are the same. The lesser urn of
    a link is its left one. Records without an urn count for nothing; empty titles and domains match nothing.
    """
    known = rows.select("urn", F.nullif(F.col("domain_urn"), F.lit("")).alias("domain_urn"), normal_name(F.col("title")).alias("norm")).filter("urn IS NOT NULL").distinct()

    def star(key: str, rung: str) -> DataFrame:
        keyed = known.select("urn", key).filter(F.col(key).isNotNull() & (F.col(key) != "")).distinct()
        least = keyed.groupBy(key).agg(F.min("urn").alias("other"), F.count("*").alias("n")).filter("n > 1")
        return keyed.join(least, key).select("urn", "other", F.lit(rung).alias("rung"))

    named = known.select("urn", F.col("domain_urn").alias("other")).join(known.select(F.col("urn").alias("other")).distinct(), "other", "left_semi")
    links = star("domain_urn", "explicit").unionByName(named.withColumn("rung", F.lit("explicit"))).unionByName(star("norm", "name")).filter("urn <> other")
    return links.select(F.least("urn", "other").alias("left_id"), F.greatest("urn", "other").alias("right_id"), "rung", F.lit(None).cast("double").alias("cosine")).distinct()


def vector_links(vectors: DataFrame, asked: DataFrame, most: int = 5, least: float = 0.80) -> DataFrame:
    """(left_id, right_id, rung, cosine): for each asked vector (query_id, embedding) up to `most` others (id, embedding) with a cosine of at least `least`."""
    near = retrieval.dense_top_k(vectors, asked, most + 1).filter((F.col("score") >= least) & (F.col("id") != F.col("query_id")))
    best = retrieval.top_k(near.select("query_id", "id", "score"), ["query_id"], "score", most)
    ends = lambda f: f("query_id", "id")
    return best.select(ends(F.least).alias("left_id"), ends(F.greatest).alias("right_id"), F.lit("embedding").alias("rung"), F.col("score").alias("cosine")).distinct()
