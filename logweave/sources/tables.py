"""Adapters: the driver's tables viewed as commit logs and numstat logs.

Each adapter is a plain projection (plus a dimension join for numstat) so
Catalyst prunes columns and pushes filters into the Parquet scan.  The same
mappings are written as SQL in ``__spark_entry__.oracle_sql``.

Mappings (all whole tables, whole texts):

* ``documents``     repo=source, seq=doc_id, author=lang, subject=first line
                    of text, body=the rest, ts=2024-01-01 + doc_id hours
* ``orders``        repo=o_orderstatus, seq=o_orderkey, author=o_custkey,
                    ts=o_orderdate, subject=o_orderpriority
* ``events``        repo=event_type, seq=event_id, author=user_id, ts=ts,
                    subject=props
* ``conversations`` repo=conv_id, seq=turn, author=role, subject/body from text
* ``lineitem`` x ``part`` x ``orders`` -> numstat: repo=o_orderstatus,
  commit_seq=l_orderkey, line_no=l_linenumber,
  path='src/'||p_brand||'/'||p_type||'/'||p_name||'/'||l_partkey,
  added=l_quantity, deleted=l_linenumber; l_returnflag='R' rows are binary
  entries (added/deleted NULL, like git's ``-``).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.text import py_strip

BASE_TIME = _dt.datetime(2024, 1, 1)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sha(col) -> F.Column:
    return F.lpad(col.cast("string"), 12, "0")


def _split_message(text) -> tuple:
    """First line -> subject, remainder -> body (both stripped)."""
    parts = F.split(text, "\n", 2)
    subject = py_strip(F.element_at(parts, 1))
    body = py_strip(F.coalesce(F.get(parts, 1), F.lit("")))
    return subject, body


def _ntz(d: _dt.datetime):
    return F.lit(d).cast("timestamp_ntz")


def commits_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    subject, body = _split_message(F.col("text"))
    return d.select(
        F.col("source").alias("repo"),
        F.lit("HEAD").alias("ref"),
        F.col("doc_id").cast("long").alias("seq"),
        _sha(F.col("doc_id")).alias("sha"),
        F.col("lang").alias("author"),
        F.concat(F.col("lang"), F.lit("@example.com")).alias("email"),
        F.timestamp_add("HOUR", F.col("doc_id"), _ntz(BASE_TIME)).alias("ts"),
        subject.alias("subject"),
        body.alias("body"),
        F.lit(True).alias("ts_valid"),
    )


def commits_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderstatus").alias("repo"),
        F.lit("HEAD").alias("ref"),
        F.col("o_orderkey").cast("long").alias("seq"),
        _sha(F.col("o_orderkey")).alias("sha"),
        F.col("o_custkey").cast("string").alias("author"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_orderpriority").alias("subject"),
        F.lit("").alias("body"),
        F.lit(True).alias("ts_valid"),
    )


def commits_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("repo"),
        F.lit("HEAD").alias("ref"),
        F.col("event_id").cast("long").alias("seq"),
        _sha(F.col("event_id")).alias("sha"),
        F.col("user_id").cast("string").alias("author"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.coalesce(F.col("props"), F.lit("")).alias("subject"),
        F.lit("").alias("body"),
        F.lit(True).alias("ts_valid"),
    )


def commits_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    subject, body = _split_message(F.col("text"))
    return c.select(
        F.col("conv_id").cast("string").alias("repo"),
        F.lit("HEAD").alias("ref"),
        F.col("turn").cast("long").alias("seq"),
        F.concat(_sha(F.col("conv_id")), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("sha"),
        F.col("role").alias("author"),
        F.concat(F.col("role"), F.lit("@example.com")).alias("email"),
        F.timestamp_add("MINUTE", F.col("turn"), _ntz(BASE_TIME)).alias("ts"),
        subject.alias("subject"),
        body.alias("body"),
        F.lit(True).alias("ts_valid"),
    )


def numstat_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    j = (li.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")
         .join(part, F.col("l_partkey") == F.col("p_partkey"))
         .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    binary = F.col("l_returnflag") == F.lit("R")
    return j.select(
        F.col("o_orderstatus").alias("repo"),
        F.lit("HEAD").alias("ref"),
        F.col("l_orderkey").cast("long").alias("commit_seq"),
        F.col("l_linenumber").cast("long").alias("line_no"),
        F.when(binary, F.lit(None)).otherwise(F.col("l_quantity").cast("long")).alias("added"),
        F.when(binary, F.lit(None)).otherwise(F.col("l_linenumber").cast("long")).alias("deleted"),
        F.concat_ws("/", F.lit("src"), F.col("p_brand"), F.col("p_type"), F.col("p_name"),
                    F.col("l_partkey").cast("string")).alias("path"),
    )


def on_two_refs(commits: DataFrame) -> DataFrame:
    """``commits`` with the odd positions on ref ``dev`` and the even ones on ``main``."""
    return commits.withColumn("ref", F.when(F.col("seq") % 2 == 1, "dev").otherwise("main"))


def log_text_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log dump per order (repo=o_orderkey): its record, with bad and huge epochs,
    empty subjects, separators and line ends in bodies, and a short record before every
    fifth order's."""
    o = read_table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    seconds = F.timestamp_diff("SECOND", _ntz(_dt.datetime(1970, 1, 1)), F.col("o_orderdate")).cast("string")
    epoch = (F.when(key % 6 == 0, "17x").when(key % 6 == 1, "99999999999999999")
             .when(key % 6 == 2, F.concat(F.lit(" "), seconds, F.lit(" "))).otherwise(seconds))
    subject = F.when(key % 11 == 0, "").otherwise(F.concat(F.lit(" "), "o_orderpriority"))
    body = (F.when(key % 4 == 0, "").when(key % 4 == 1, "a\x1fb")
            .when(key % 4 == 2, "  line one\nline two  ").otherwise("done"))
    record = F.concat_ws("\x1f", _sha(key), F.col("o_custkey").cast("string"),
                         F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit("@example.com")),
                         epoch, subject, body)
    short = F.when(key % 5 == 0, "short\x1frecord\x1e").otherwise("")
    return o.select(key.cast("string").alias("repo"), F.concat(short, record, F.lit("\x1e\n")).alias("value"))


def numstat_text_from_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numstat dump per order (repo=l_orderkey), one commit per line item: binary
    entries for l_returnflag='R', a count that is no number at every fourth
    l_linenumber, a blank line before every third, and a line without tabs after each."""
    bad, binary = F.col("l_linenumber") % 4 == 0, F.col("l_returnflag") == "R"
    added = F.when(binary, "-").when(bad, "x").otherwise(F.col("l_quantity").cast("long").cast("string"))
    deleted = F.when(binary, "-").otherwise(F.col("l_linenumber").cast("string"))
    path = F.concat(F.lit("src/part-"), F.col("l_partkey").cast("string"))
    blank = F.when(F.col("l_linenumber") % 3 == 0, "\n").otherwise("")
    block = F.concat(F.lit("COMMIT\n"), blank, F.concat_ws("\t", added, deleted, path), F.lit("\nno counts\n"))
    li = read_table(spark, sf_dir, "lineitem")
    per = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(  # a few items per order
        "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", block.alias("block")))).alias("b"))
    return per.select(F.col("l_orderkey").cast("string").alias("repo"), F.array_join("b.block", "").alias("value"))


COMMIT_ADAPTERS = {
    "documents": commits_from_documents,
    "orders": commits_from_orders,
    "events": commits_from_events,
    "conversations": commits_from_conversations,
}
