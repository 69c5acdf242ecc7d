"""Incremental ingestion of commit-log dumps with Structured Streaming.

The reference reads one log once.  At scale, dumps keep arriving (one file
per repository and ref, re-dumped as history grows); this job picks up new
files from a folder, parses them with the same S1 rules, and appends them to
the Parquet store partitioned by ``repo``/``ref`` that the batch operators
read (so date and ref filters prune partitions and push into the scan).

Each row keeps the time and name of its dump; ``latest_commits`` reads the newest
dump of each repository and ref, so a re-dump (a new file of the same base name, as
in ``2024-05/alpha.log``) takes the place of the older one.

Exactly-once comes from the file source plus the checkpoint location: a
restarted query resumes from the files it has not committed yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators.keyed import join_per_repo
from logweave.sources.gitlog import parse_commit_text, repo_from_path


def stream_commit_dumps(spark: SparkSession, folder: str, ref: str = "HEAD",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of parsed commits from dump files in ``folder``."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.load(folder).select(
        repo_from_path(F.col("_metadata.file_path")).alias("repo"), "value",
        F.col("_metadata.file_modification_time").alias("dump_time"),
        F.col("_metadata.file_path").alias("dump_file"))
    return parse_commit_text(raw, "value", "repo", ref, ("dump_time", "dump_file"))


def ingest_commit_dumps(spark: SparkSession, folder: str, store: str, checkpoint: str,
                        ref: str = "HEAD", available_now: bool = True):
    """Append newly arrived dumps to ``store``; returns the started query.

    ``available_now=True`` processes everything present and stops (a
    scheduled batch-style run); otherwise it keeps running every minute.
    """
    stream = stream_commit_dumps(spark, folder, ref)
    writer = (stream.writeStream.format("parquet")
              .option("path", store)
              .option("checkpointLocation", checkpoint)
              .partitionBy("repo", "ref")
              .outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def latest_commits(store: DataFrame) -> DataFrame:
    """Rows of ``store`` that stand in the newest dump (by file time, then by name) of
    their repository and ref.  A dump without any record replaces nothing."""
    newest = store.groupBy("repo", "ref").agg(F.max(F.struct("dump_time", "dump_file")).alias("d"))
    # a few refs per repository
    per_repo = newest.groupBy("repo").agg(F.collect_set(F.struct("ref", F.col("d.dump_file"))).alias("_newest"))
    rows = join_per_repo(store, per_repo)
    return rows.filter(F.array_contains("_newest", F.struct("ref", "dump_file"))).select(*store.columns)
