"""Activity roll-ups per repo: authors, days, weeks, header.

All are hash aggregations with map-side partial aggregation; the only
windows run over already aggregated rows (authors / weeks per repo) and are
top-k windows, which Spark plans with a partial per-partition group limit
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.display import TIMELINE_BAR_WIDTH, bar_cells, week_start
from logweave.operators.keyed import rank_within


def _date(commits: DataFrame):
    return F.to_date(F.col("ts"))


def author_counts(commits: DataFrame) -> DataFrame:
    """A1: commits per (repo, author).  Order: ``n_commits desc, first_seq``
    (ties keep first-seen, i.e. newest-first, order)."""
    return (commits.groupBy("repo", "author")
            .agg(F.count(F.lit(1)).alias("n_commits"),
                 F.min("seq").alias("first_seq")))


def top_authors(commits: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most active authors per repo with their rank."""
    w = Window.partitionBy("repo").orderBy(F.desc("n_commits"), F.asc("first_seq"))
    return (author_counts(commits)
            .withColumn("author_rank", F.row_number().over(w))
            .filter(F.col("author_rank") <= n))


def commits_by_date(commits: DataFrame) -> DataFrame:
    """A2: one row per (repo, day) with its commit count and seq range;
    ``commits_of_days`` has the commits themselves."""
    return (commits.groupBy("repo", _date(commits).alias("date"))
            .agg(F.count(F.lit(1)).alias("n_commits"),
                 F.min("seq").alias("first_seq"),
                 F.max("seq").alias("last_seq")))


def commits_of_days(commits: DataFrame) -> DataFrame:
    """A2: every commit with its day and ``day_pos``, its 1-based place in log
    order among the commits of that day: the list of each day, one row a commit.
    A day of any size is numbered by many tasks."""
    rows = commits.select("repo", _date(commits).alias("date"), "seq", "sha")
    return rank_within(rows, ["repo", "date"], [F.asc("seq")], "day_pos")


def weekly_timeline(commits: DataFrame, max_weeks: int = 26,
                    width: int = TIMELINE_BAR_WIDTH) -> DataFrame:
    """Commits per Monday-week, the last ``max_weeks`` non-empty weeks
    per repo, with bar cells scaled to the busiest shown week."""
    weeks = (commits.groupBy("repo", week_start("ts").alias("week_start"))
             .agg(F.count(F.lit(1)).alias("n_commits")))
    recent = Window.partitionBy("repo").orderBy(F.desc("week_start"))
    shown = (weeks.withColumn("week_back", F.row_number().over(recent))
             .filter(F.col("week_back") <= max_weeks))
    peak = F.max("n_commits").over(Window.partitionBy("repo"))
    return (shown.withColumn("peak", peak)
            .withColumn("bar_cells", bar_cells("n_commits", "peak", width))
            .withColumn("is_peak", F.col("n_commits") == F.col("peak"))
            .drop("peak"))


def author_velocity(commits: DataFrame) -> DataFrame:
    """A4: count, first/last day, inclusive span (min 1) and commits/week."""
    d = _date(commits)
    agg = (commits.groupBy("repo", "author")
           .agg(F.count(F.lit(1)).alias("n_commits"),
                F.min(d).alias("first_date"),
                F.max(d).alias("last_date"),
                F.min("seq").alias("first_seq")))
    span = F.greatest(F.lit(1), F.datediff("last_date", "first_date") + 1)
    return (agg.withColumn("span_days", span)
            .withColumn("avg_per_week",
                        F.col("n_commits") / (F.col("span_days") / F.lit(7.0))))


def log_header(commits: DataFrame, n_authors: int = 5) -> DataFrame:
    """Total, positional oldest/newest day (last / first log row) and the
    top authors as ``"name count"`` text joined by two spaces."""
    d = _date(commits)
    totals = (commits.groupBy("repo")
              .agg(F.count(F.lit(1)).alias("total_commits"),
                   F.min_by(d, F.col("seq")).alias("newest_date"),
                   F.max_by(d, F.col("seq")).alias("oldest_date")))
    tops = (top_authors(commits, n_authors)
            .groupBy("repo")
            .agg(F.sort_array(F.collect_list(
                F.struct("author_rank", "author", "n_commits"))).alias("t")))
    tops = tops.select(
        "repo",
        F.array_join(F.transform("t", lambda s: F.concat(
            s["author"], F.lit(" "), s["n_commits"].cast("string"))), "  ").alias("top_authors"))
    return totals.join(tops, "repo", "left")
