"""Fixed schemas of the commit and numstat tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweave.functions.text import commit_date, message, short_sha

COMMITS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("seq", T.LongType()),          # position in the log, 0 = newest
    T.StructField("sha", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),   # UTC wall time
    T.StructField("subject", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("ts_valid", T.BooleanType()),
])

NUMSTAT = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("ref", T.StringType()),
    T.StructField("commit_seq", T.LongType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("added", T.LongType()),        # NULL = binary / not a number
    T.StructField("deleted", T.LongType()),
    T.StructField("path", T.StringType()),
])


def with_derived(commits):
    """Add ``message``, ``date`` and ``short_sha``."""
    return commits.select(
        "*",
        message().alias("message"),
        commit_date().alias("date"),
        short_sha().alias("short_sha"),
    )


def date_string(col: str = "date"):
    return F.date_format(F.col(col), "yyyy-MM-dd")
