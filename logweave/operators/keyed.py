"""Attach per-repo values to large per-row tables without a hot partition.

A join on ``repo`` alone would hash every row of a repo into one task; one
repo may hold a third of all rows.  Per-repo tables have one row per repo,
so they are broadcast when their measured bytes are few, and otherwise
joined on ``(repo, salt)`` with the small side replicated once per salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import stored

MAX_BROADCAST_BYTES = 16 << 20
SALTS = 64


def join_per_repo(big: DataFrame, per_repo: DataFrame, how: str = "inner",
                  salt_cols: tuple = ("seq",), max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                  salts: int = SALTS) -> DataFrame:
    """``big JOIN per_repo USING (repo)`` for ``how`` in inner, left,
    left_semi, left_anti; ``per_repo`` must have one row per repo."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    size = per_repo.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= max_broadcast_bytes:
        return big.join(F.broadcast(per_repo), "repo", how)
    salted_small = per_repo.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    key = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts)).cast("int")
    return big.withColumn("_salt", key).join(salted_small, ["repo", "_salt"], how).drop("_salt")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition ``df`` by ``keys`` only when it has fewer partitions
    than the cluster's default parallelism (e.g. a source file with a single
    row group), so CPU-heavy per-row work (regex tokenizing of whole texts)
    uses every core.  Large inputs already have many splits and are left
    alone, so no extra shuffle is added at scale."""
    sc = df.sparkSession.sparkContext
    target = sc.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, *[F.col(k) for k in keys])


def rank_within(df: DataFrame, keys, order: list, name: str) -> DataFrame:
    """Add a 1-based BIGINT ``name`` = position of each row inside its group of ``keys``
    (not null) under ``order`` (``order`` must make positions unique).

    A group of any size is ranked by many tasks: a range sort by keys and order deals
    it over partitions and is written once, per (group, partition) counts give each
    partition's offset inside its group, and rank = offset + place in the partition.
    """
    from pyspark.sql import Window

    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
            .withColumn("_row", F.monotonically_increasing_id()))
    rows = stored(rows, "rank").withColumn("_part", F.shiftright("_row", 33))
    runs = rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_off"))
    return (rows.join(runs, [*keys, "_part"])
            .withColumn(name, F.col("_row") + F.col("_off")).drop("_part", "_row", "_off"))
