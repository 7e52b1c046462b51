"""Who knows what: ownership shares, bus factors, alerts, idioms and clusters of work."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shares(lines: DataFrame, unit: str, author: str) -> DataFrame:
    """(unit, author, lines, share, place): rows per author, their share of the unit, and the place by size."""
    counted = lines.groupBy(unit, author).agg(F.count("*").alias("lines"))
    w = Window.partitionBy(unit)
    return counted.withColumn("share", F.round(F.col("lines") / F.sum("lines").over(w), 4)).withColumn(
        "place", F.row_number().over(w.orderBy(F.desc("lines"), author))
    )


def bus_factor(lines: DataFrame, unit: str, author: str, least: float = 0.10) -> DataFrame:
    """Authors with at least that share of the unit."""
    return shares(lines, unit, author).groupBy(unit).agg(
        F.count("*").alias("authors"), F.count_if(F.col("share") >= least).alias("bus_factor"), F.max(F.when(F.col("place") == 1, F.col(author))).alias("primary_author")
    )


def owners(lines: DataFrame, unit: str, author: str, n: int = 3) -> DataFrame:
    """The n largest owners with their share, and how many of them hold a fifth at least (1 at least)."""
    top = shares(lines, unit, author).filter(F.col("place") <= n)
    return top.withColumn("bus_factor", F.greatest(F.lit(1), F.count_if(F.col("share") >= 0.2).over(Window.partitionBy(unit))))


def churn(commits: DataFrame, unit: str, when: str, as_of: Column) -> DataFrame:
    age = F.datediff(as_of, F.col(when))
    return commits.groupBy(unit).agg(F.count_if(age <= 30).alias("churn_30d"), F.count_if(age <= 90).alias("churn_90d"), F.min(age).alias("age_days"))


def risk_alerts(lines: DataFrame, unit: str, author: str, when: str, as_of: Column) -> DataFrame:
    """(unit, alert, severity): one author alone, much change, or an owner who has long gone quiet."""
    s = shares(lines, unit, author)
    lead = s.groupBy(unit).agg(
        F.max(F.when(F.col("place") == 1, F.col("share"))).alias("first"), F.max(F.when(F.col("place") == 2, F.col("share"))).alias("second"),
        F.max(F.when(F.col("place") == 1, F.col(author))).alias("owner"),
    )
    quiet = lines.groupBy(unit, F.col(author).alias("owner")).agg(F.datediff(as_of, F.max(when)).alias("quiet_days"))
    joined = lead.join(churn(lines, unit, when, as_of), unit).join(quiet, [unit, "owner"])
    alerts = F.array_compact(F.array(
        F.when((F.col("first") > 0.70) & (F.coalesce("second", F.lit(0.0)) < 0.10), F.struct(F.lit("bus_factor_one").alias("alert"), F.lit("HIGH").alias("severity"))),
        F.when(F.col("churn_30d") > 5, F.struct(F.lit("high_churn").alias("alert"), F.when(F.col("churn_30d") >= 10, "HIGH").otherwise("MEDIUM").alias("severity"))),
        F.when(F.col("quiet_days") >= 90, F.struct(F.lit("stale_owner_left").alias("alert"), F.lit("MEDIUM").alias("severity"))),
    ))
    return joined.select(unit, F.explode(alerts).alias("a")).select(unit, "a.alert", "a.severity")


def gap_clusters(events: DataFrame, by: str, when: str, tie: str, hours: int) -> DataFrame:
    """Adds cluster: a number that grows where more than so many hours lie between two events of a group."""
    w = Window.partitionBy(by).orderBy(when, tie)
    before = F.lag(when).over(w)
    apart = before.isNull() | (F.col(when) > before + F.expr(f"INTERVAL {int(hours)} HOURS"))
    return events.withColumn("_new", apart.cast("int")).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def idioms(calls: DataFrame, callee: str, caller: str, least: int = 5) -> DataFrame:
    """Callees that at least so many distinct callers share, with a confidence that grows with them."""
    return calls.groupBy(callee).agg(F.count_distinct(caller).alias("callers")).filter(F.col("callers") >= least).withColumn(
        "confidence", F.round(F.least(F.lit(0.95), 0.6 + 0.05 * (F.col("callers") - least)), 2)
    )


def minority(rows: DataFrame, by: str, flag: str, least_share: float = 0.8, least_rows: int = 5) -> DataFrame:
    """Rows without the flag in groups of at least so many rows of which at least that share have it."""
    w = Window.partitionBy(by)
    marked = rows.withColumn("adoption", F.avg(F.col(flag).cast("double")).over(w)).withColumn("population", F.count("*").over(w))
    return marked.filter((F.col("adoption") >= least_share) & (F.col("population") >= least_rows) & ~F.col(flag)).withColumn("adoption", F.round("adoption", 4))
