"""Block products behind X3 and C2, vocabulary of rows without a place, shuffles of TF-IDF."""

import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import blocks
from logweave.operators import cluster as cl
from logweave.operators import vectors as vec

WORDS = "harbour lantern copper meadow violin glacier saddle walnut compass thunder orchard velvet falcon ribbon".split()


def messages(spark, n, seed=3):
    rng = random.Random(seed)
    made = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) for _ in range(n)]
    rows = [(f"r{i % 2}", i, rng.choice(made) if i % 5 == 0 else m) for i, m in enumerate(made)]
    return spark.createDataFrame(rows, "repo string, seq long, message string")


def small_blocks(monkeypatch):
    for name, value in (("BLOCK_POSTINGS", 40), ("CELLS", 64), ("STEPS", 50)):
        monkeypatch.setattr(blocks, name, value)
    monkeypatch.setattr(cl, "FIRST_ROWS", 4)


@pytest.mark.parametrize("gain", [0.0, 1 / 200, 10.0])
def test_links_of_blocks_equal_plain_join(spark, monkeypatch, gain):
    small_blocks(monkeypatch)
    monkeypatch.setattr(blocks, "DENSE_GAIN", gain)
    post = vec.tfidf(messages(spark, 60), term_ids=True).cache()
    want = {(r.repo, r.seq_a, r.seq_b): round(r.sim, 9) for r in vec.similarity_join(post, 0.2, "plain").collect()}
    for p in (post, post.drop("term_id")):
        got = blocks.links(blocks.coded(p), 0.2).collect()
        assert len(got) == len(want)
        assert {(r.repo, r.seq_a, r.seq_b): round(r.sim, 9) for r in got} == want


def test_levels_equal_leader_themes_and_keep_few_links(spark, monkeypatch):
    small_blocks(monkeypatch)
    docs = messages(spark, 150, 9)
    post = vec.tfidf(docs, term_ids=True).cache()
    edges = vec.similarity_join(post, 0.2, "plain").cache()
    want = {(r.repo, r.seq): r.seed_seq for r in cl.leader_themes(docs, edges).collect()}
    kept, links = [], blocks.links
    monkeypatch.setattr(blocks, "links", lambda d, t: (kept.append(links(d, t).count()), links(d, t))[1])
    got = {(r.repo, r.seq): r.seed_seq for r in cl.leader_themes_collapsed(docs, post, 0.2).collect()}
    assert got == want
    assert len(kept) > 2 and sum(kept) < edges.count() / 4    # the links of all rows were written before


def test_link_counts(spark, monkeypatch):
    small_blocks(monkeypatch)
    docs = messages(spark, 80, 5).unionByName(spark.createDataFrame(
        [("r0", 900, ""), (None, 901, "harbour lantern")], "repo string, seq long, message string"))
    post = vec.tfidf(docs).cache()
    n, bags = {}, {}
    for r in vec.similarity_join(post, 0.2, "plain").collect():
        for s in (r.seq_a, r.seq_b):
            n[s] = n.get(s, 0) + 1
    rows = {r.seq: (r.repo, tuple(sorted(r.message.split()))) for r in docs.collect()}
    for s in sorted(rows):
        if rows[s][0] and rows[s][1]:
            bags.setdefault(rows[s], s)
    got = cl.link_counts(docs, post, 0.2).collect()
    assert len(got) == len(rows)
    assert {r.seq: (r.class_id, r.n_links) for r in got} == {s: (bags.get(rows[s], s), n.get(s, 0)) for s in rows}


def test_vocabulary_without_sorting_tokens(spark):
    tokens = spark.createDataFrame(
        [("r", 5, 0, "copper"), ("r", 5, 3, "velvet"), ("r", 5, 4, "copper"), ("r", 2, 7, "velvet"), ("r", None, 9, "copper")],
        "repo string, seq long, pos int, term string")
    got = {(r.term, r.df, r.term_id, r.first_seq) for r in vec.vocab_stats(tokens).collect()}
    assert got == {("copper", 1, 0, None), ("velvet", 2, 1, 2)}


def test_tfidf_counts_where_documents_lie(spark):
    tokens = vec.token_rows(messages(spark, 20))
    plan = tokens.groupBy("repo", "seq", "term").agg(F.count(F.lit(1)))._jdf.queryExecution().optimizedPlan().toString()
    per_doc = tokens.groupBy("repo", "seq", "term").agg(F.min("pos"))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("Repartition") == 1 and "SortAggregate" not in per_doc
    executed = tokens.groupBy("repo", "seq", "term").count()._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange") == 1    # texts once, tokens never
