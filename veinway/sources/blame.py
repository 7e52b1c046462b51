"""Line-by-line authorship from the porcelain output of git blame."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The seconds of the years 1 to 9999.
EARLIEST, LATEST = -62_135_596_800, 253_402_300_799


def blame_lines(output: DataFrame) -> DataFrame:
    """(file, line_no, author, author_mail, commit_sha, commit_time, content) of porcelain lines (file, n, raw), n giving their order.

    A header begins with a commit's 40 hex digits; what it says of the author holds for the lines
    behind it. Where a commit comes again without its author, what was said last is taken. The lines of a
    file lie in one partition. A line without a commit has the sha ''; a time that is none, or beyond the
    years 1 to 9999, is 1970; a null line counts as empty; an empty table is an empty result.
    """
    raw = F.coalesce("raw", F.lit(""))
    head, rest = F.substring_index("raw", " ", 1), F.regexp_replace("raw", r"(?s)^[^ ]* ?", "")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    in_file = Window.partitionBy("file").orderBy("n").rowsBetween(*so_far)
    of_commit = Window.partitionBy("file", "sha").orderBy("n").rowsBetween(*so_far)
    is_line, is_header = F.col("raw").startswith("\t"), head.rlike(r"^[0-9a-fA-F]{40}\z")
    rows = output.select(F.col("file").cast("string").alias("file"), "n", raw.alias("raw"))
    rows = rows.withColumns({
        "line_no": F.sum(is_line.cast("int")).over(in_file).cast("int"), "sha": F.coalesce(F.last(F.when(is_header, head), ignorenulls=True).over(in_file), F.lit("")),
    })
    rows = rows.filter(is_line | head.isin("author", "author-mail", "author-time"))  # the rest is not looked at again
    said = lambda what: F.last(F.when(head == what, rest), ignorenulls=True).over(of_commit)
    known = rows.withColumns({"author": said("author"), "mail": said("author-mail"), "time": said("author-time")}).filter(is_line)
    number = F.when(F.col("time").rlike(r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z"), F.regexp_replace("time", r"[\s_]", ""))
    seconds = F.expr("try_cast(number AS BIGINT)")
    mail = F.regexp_replace(F.coalesce("mail", F.lit("")), r"^[<>]+|[<>]+\z", "")
    known = known.withColumn("number", number).withColumns({"seconds": F.when(seconds.between(EARLIEST, LATEST), seconds), "mail": mail})
    return known.select(
        "file", "line_no", F.coalesce(F.nullif("author", F.lit("")), "mail").alias("author"), F.col("mail").alias("author_mail"), F.col("sha").alias("commit_sha"),
        F.timestamp_seconds(F.coalesce("seconds", F.lit(0))).alias("commit_time"), F.substring("raw", 2, 1 << 30).alias("content"),
    )
