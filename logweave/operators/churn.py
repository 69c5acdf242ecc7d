"""File churn (A5, P4) and the hot-files table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.display import HEAT_BAR_WIDTH, bar_cells, display_path, heat_level


def file_churn(numstat: DataFrame, min_commits: int = 2) -> DataFrame:
    """A5 + F7: touches and line totals per (repo, path).

    Binary (``-``) and non-numeric rows are skipped entirely (NULL added or
    deleted), they do not count as a touch.  ``first_commit_seq`` /
    ``first_line_no`` give the first-seen position in the log, the stable
    tie-break of the reference's sort.  One shuffle on (repo, path) with
    map-side partial aggregation.
    """
    valid = numstat.filter(F.col("added").isNotNull() & F.col("deleted").isNotNull())
    agg = (valid.groupBy("repo", "path")
           .agg(F.count(F.lit(1)).alias("commit_count"),
                F.sum("added").alias("lines_added"),
                F.sum("deleted").alias("lines_deleted"),
                F.min(F.struct("commit_seq", "line_no")).alias("first")))
    return (agg.filter(F.col("commit_count") >= min_commits)
            .select("repo", "path", "commit_count", "lines_added", "lines_deleted",
                    (F.col("lines_added") + F.col("lines_deleted")).alias("churn_score"),
                    (F.col("lines_added") - F.col("lines_deleted")).alias("net_change"),
                    F.col("first.commit_seq").alias("first_commit_seq"),
                    F.col("first.line_no").alias("first_line_no")))


def churn_order():
    return [F.desc("commit_count"), F.desc("churn_score"),
            F.asc("first_commit_seq"), F.asc("first_line_no")]


def hot_files(churn: DataFrame, top_n: int = 20, width: int = HEAT_BAR_WIDTH) -> DataFrame:
    """Top-n files per repo with rank, heat ratio against the top
    file, bar cells, heat level and shortened display path.

    ``row_number() <= n`` is planned with a per-partition group limit before
    the shuffle, so a repo with many files ships at most n rows per task.
    """
    w = Window.partitionBy("repo").orderBy(*churn_order())
    top = churn.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
    peak = F.max("commit_count").over(Window.partitionBy("repo"))
    return (top.withColumn("peak", peak)
            .select("repo", "rank", "path", display_path("path").alias("display_path"),
                    "commit_count", "lines_added", "lines_deleted", "churn_score", "net_change",
                    (F.col("commit_count") / F.col("peak")).alias("heat_ratio"),
                    bar_cells("commit_count", "peak", width).alias("bar_cells"),
                    heat_level("commit_count", "peak").alias("heat_level")))
