"""Packed vectors, vectors in files, and what is left on disk."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from logweave.operators import blocks, packs
from logweave.operators import cluster as cl
from logweave.operators import vectors as vec
from logweave.plans import analyse
from logweave.session import stored
from test_blocks import messages, small_blocks


def odd_messages(spark):
    extra = [("r0", 3, "copper copper lantern"), ("r0", 3, "velvet"), ("r0", None, "velvet ribbon"), ("r0", None, "ribbon"),
             ("r1", None, "falcon"), (None, 7, "copper velvet"), ("r1", 901, None), ("r1", 902, ""), ("r2", 1, "alone")]
    return messages(spark, 60).unionByName(spark.createDataFrame(extra, "repo string, seq long, message string"))


@pytest.mark.parametrize("tokens", [1, 30, 1 << 20])
def test_postings_of_packs_equal_tfidf(spark, monkeypatch, tokens):
    monkeypatch.setattr(packs, "PACK_TOKENS", tokens)
    monkeypatch.setattr(packs, "SLICE_ROWS", 2)
    docs = odd_messages(spark)
    rows = lambda p: sorted([(r.repo, -1 if r.seq is None else r.seq, r.term, r.cnt, r.df, round(r.weight, 9)) for r in p.collect()])
    assert rows(packs.pack_texts(docs).postings()) == rows(vec.tfidf(docs))


def test_themes_from_packs_equal_themes_from_postings(spark, monkeypatch):
    small_blocks(monkeypatch)
    monkeypatch.setattr(packs, "PACK_TOKENS", 30)
    monkeypatch.setattr(packs, "SLICE_ROWS", 2)
    docs = odd_messages(spark)
    plain, packed = (analyse.theme_tables(docs, 0.2, 2, 3, method=m) for m in ("plain", "blocks"))
    place = lambda t: sorted([(r.repo or "", -1 if r.seq is None else r.seq, r.seed_seq, r.cluster_id) for r in t.ranked.collect()], key=str)
    words = lambda t: sorted([(r.repo, r.cluster_id, r.rank, r.term, round(r.weight, 9)) for r in t.keywords.collect()])
    assert place(packed) == place(plain)
    assert words(packed) == words(plain) and words(plain)


def test_pairs_of_blocks_ship_no_vectors(spark, monkeypatch):
    small_blocks(monkeypatch)
    coded = blocks.coded(vec.tfidf(messages(spark, 60), term_ids=True))
    plan = blocks.nearest(coded, coded, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "weights" not in plan    # each block was shuffled once per block that it meets


def test_stored_leaves_no_shuffle_files(spark):
    from pyspark import SparkContext

    root = SparkContext._active_spark_context._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in root for f in glob.glob(os.path.join(d, "*", "shuffle_*.data"))}
    before = files()
    made = stored(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    assert made.count() == 7 and spark.conf.get("spark.sql.shuffle.partitions")
    left = files() - before
    assert len(left) <= 1    # that of made.count(), at most


def test_copies_by_digest(spark):
    docs = messages(spark, 60)
    post = vec.tfidf(docs).cache()
    later = {(r.repo, r.seq, r.rep) for r in cl.later_copies(post).collect()}
    rows = packs.pack_texts(docs).vectors(F.lit(0)).collect()
    same = {}
    for r in rows:
        same.setdefault((r.repo, bytes(r.digest)), set()).add(r.seq)
    groups = {}
    for repo, seq, rep in later:
        groups.setdefault((repo, rep), {rep}).add(seq)
    assert sorted((k[0], sorted(v)) for k, v in same.items() if len(v) > 1) == sorted((k[0], sorted(v)) for k, v in groups.items()) != []


def test_pieces_give_weights_back_bit_for_bit():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    sizes = np.array([3, 1, 400])
    n = int(sizes.sum())
    ids = np.sort(rng.choice(1 << 40, n, replace=False))[::-1].copy()    # in any order, and shared
    ids[4:7], idf = ids[:3], rng.random(n)
    idf[4:7] = idf[:3]
    counts, norm = rng.integers(1, 400, n).astype(np.int32), rng.random(3)
    one = pa.table({"seq": [7, -2, 9], "ids": packs.lists(ids, sizes), "counts": packs.lists(counts, sizes),
                    "idfs": packs.lists(idf, sizes), "norm": norm})
    weights = counts * idf / np.repeat(norm, sizes)
    two = pa.table({"seq": [7, -2, 9], "ids": packs.lists(ids, sizes), "weights": packs.lists(weights, sizes)})
    for table in (one, two):
        got = blocks._decode(blocks._encode(table))
        assert got["seq"].to_pylist() == [7, -2, 9]
        assert (got["ids"].combine_chunks().flatten().to_numpy() == ids).all()
        assert (got["weights"].combine_chunks().flatten().to_numpy() == weights).all()
        assert got["ids"].combine_chunks().value_lengths().to_pylist() == sizes.tolist()


def test_files_of_themes_take_less_than_the_texts(spark):
    """Weights went to the files as they are, and every pack of a repo listed its words once more."""
    import random

    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(4, 9))) for _ in range(3000)]
    rows = [(f"r{i % 4}", i, " ".join(vocab[min(2999, int(rng.paretovariate(0.6)))] for _ in range(300))) for i in range(400)]
    docs = spark.createDataFrame(rows, "repo string, seq long, message string").cache()
    made = packs.pack_texts(docs)
    placed = blocks.placed(made.vectors(F.lit(0)))
    size = lambda folder: sum(os.path.getsize(f) for f in glob.glob(f"{folder.removeprefix('file:')}/**/*", recursive=True) if os.path.isfile(f))
    n = made.docs.select(F.explode("codes")).count()
    assert size(placed.folder) < 4 * n    # 16 bytes a posting before they are compressed, and weights hardly are
    per_repo = made.terms.groupBy("repo").count().collect()
    assert sum(r["count"] for r in per_repo) < 4 + max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
