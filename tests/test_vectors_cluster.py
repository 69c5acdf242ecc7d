"""TF-IDF (K-4, K-5), similarity join (X3 prefix == plain), clustering
(C1 and C2: every row is checked against the rule, given the rows before it),
keywords (K-10) and invariants (F-4, F-5)."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from logweave.functions.text import ALL_STOP_WORDS
from logweave.operators import cluster as cl
from logweave.operators import vectors as vec

CLOSE = 1e-9
WORDS = "harbour lantern copper meadow violin glacier saddle walnut compass thunder orchard velvet falcon ribbon".split()


def docs_df(spark, messages, repo="r"):
    return spark.createDataFrame([(repo, i, m) for i, m in enumerate(messages)],
                                 "repo string, seq long, message string")


def random_messages(rng, n):
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 5))) for _ in range(n)]


# --- checks of outputs: WORDS are whole tokens, so a message's bag is its split ---

def weight_maps(messages):
    """One {term: weight} per message, from the definition of the weights."""
    assert not set(WORDS) & set(ALL_STOP_WORDS)
    bags = [Counter(m.split()) for m in messages]
    holders = Counter(t for b in bags for t in b)
    out = []
    for b in bags:
        raw = {t: c * (1 + math.log((len(bags) + 1) / (holders[t] + 1))) for t, c in b.items()}
        length = math.hypot(*raw.values())
        out.append({t: x / length for t, x in raw.items()})
    return out


def dot(a, b):
    return sum(x * b[t] for t, x in a.items() if t in b)


def assert_moving_mean_rule(given, maps, t):
    """Each row of ``given`` (row -> first member of its cluster) stands where the
    rule puts it, the clusters before it taken from ``given`` itself."""
    for row in range(len(maps)):
        offers = {}
        for seed in {given[r] for r in range(row)}:
            total = Counter()
            for r in range(row):
                if given[r] == seed:
                    total.update(maps[r])
            length = math.hypot(*total.values())
            offers[seed] = dot(maps[row], total) / length if length else 0.0
        if given[row] == row:
            assert all(x <= t + CLOSE for x in offers.values()), row
        else:
            assert offers[given[row]] > t - CLOSE, row
            assert offers[given[row]] >= max(offers.values()) - CLOSE, row
            assert given[row] == min(k for k, x in offers.items() if x >= offers[given[row]] - CLOSE), row


def visited(rows, repo="r"):
    return sorted(rows, key=lambda k: (hashlib.md5(f"{repo}:{k}".encode()).hexdigest()[:15], k))


def assert_fixed_seed_rule(given, maps, t):
    """A row is a seed when no seed visited before it is nearer than ``t``; any other
    row belongs to the nearest seed, the first of equally near ones."""
    before = []
    for row in visited(range(len(maps))):
        assert (given[row] == row) == all(dot(maps[row], maps[s]) <= t for s in before), row
        if given[row] == row:
            before.append(row)
    for row in set(range(len(maps))) - set(before):
        near = {s: dot(maps[row], maps[s]) for s in before}
        assert given[row] == min(s for s, x in near.items() if x >= max(near.values()) - CLOSE), row


# --- tests ------------------------------------------------------------------

def test_tfidf_values_and_norm(spark):
    post = vec.tfidf(docs_df(spark, ["river granite", "river cotton", ""]))
    w = {(r.seq, r.term): r.weight for r in post.collect()}
    idf_u = math.log(4 / 2) + 1
    assert abs(w[(0, "granite")] - idf_u / math.hypot(idf_u, math.log(4 / 3) + 1)) < 1e-12
    assert 2 not in {s for s, _ in w}  # empty document: no postings
    norms = post.groupBy("seq").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)


def test_tfidf_matches_definition(spark):
    rng = random.Random(3)
    msgs = random_messages(rng, 40)
    maps = weight_maps(msgs)
    post = vec.tfidf(docs_df(spark, msgs)).collect()
    assert len(post) == sum(map(len, maps))
    for r in post:
        assert abs(r.weight - maps[r.seq][r.term]) < CLOSE


def test_prefix_join_equals_plain(spark):
    rng = random.Random(5)
    msgs = random_messages(rng, 80)
    post = vec.tfidf(docs_df(spark, msgs)).cache()
    for t in (0.1, 0.2, 0.5, 0.8):
        a = {(r.seq_a, r.seq_b): round(r.sim, 9) for r in vec.similarity_join(post, t, "prefix").collect()}
        b = {(r.seq_a, r.seq_b): round(r.sim, 9) for r in vec.similarity_join(post, t, "plain").collect()}
        c = {(r.seq_a, r.seq_b): round(r.sim, 9) for r in vec.similarity_join(post, t, block=4).collect()}
        assert c == a
        assert a == b
        maps = weight_maps(msgs)
        want = {(i, j) for i in range(len(msgs)) for j in range(i + 1, len(msgs)) if dot(maps[i], maps[j]) > t}
        assert set(a) == want


def test_pairwise_symmetric_unit_diagonal(spark):
    msgs = ["harbour lantern", "harbour lantern copper", "", "violin glacier"]
    d = docs_df(spark, msgs)
    m = {(r.seq_i, r.seq_j): r.sim for r in vec.pairwise_similarity(vec.tfidf(d), d).collect()}
    assert m[(0, 0)] == 1.0 and m[(2, 2)] == 0.0
    assert abs(m[(0, 1)] - m[(1, 0)]) < 1e-15
    assert (0, 3) not in m


def test_greedy_two_groups(spark):
    msgs = ["harbour lantern copper"] * 4 + ["violin glacier saddle"] * 4
    d = docs_df(spark, msgs)
    post = vec.tfidf(d)
    ranked = cl.rank_clusters(cl.greedy_themes(d, post, 0.1), 2).collect()
    groups = {}
    for r in ranked:
        groups.setdefault(r.cluster_id, set()).add(r.seq)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [4, 5, 6, 7]]


def test_greedy_tie_keeps_seed_order_and_min_size(spark):
    msgs = ["walnut"] * 5 + ["compass"] * 5 + ["thunder orchard velvet"]
    d = docs_df(spark, msgs)
    r = cl.rank_clusters(cl.greedy_themes(d, vec.tfidf(d), 0.05), 2).collect()
    cid = {x.seq: x.cluster_id for x in r}
    assert cid[0] == 1 and cid[5] == 2 and cid[10] is None


def test_empty_input(spark):
    d = docs_df(spark, [])
    assert cl.greedy_themes(d, vec.tfidf(d), 0.2).count() == 0


def test_greedy_hand_worked(spark):
    # two rows share a word; the third shares nothing with either
    d = docs_df(spark, ["harbour lantern", "harbour copper", "violin"])
    post = vec.tfidf(d)
    shared, single = 1 + math.log(4 / 3), 1 + math.log(4 / 2)
    sim = shared ** 2 / (shared ** 2 + single ** 2)  # 0.365
    for t, want in ((sim - 0.01, {0: 0, 1: 0, 2: 2}), (sim + 0.01, {0: 0, 1: 1, 2: 2})):
        assert {r.seq: r.seed_seq for r in cl.greedy_themes(d, post, t).collect()} == want


def test_greedy_follows_rule(spark):
    rng = random.Random(11)
    for t in (0.1, 0.2, 0.4):
        msgs = random_messages(rng, 60)
        d = docs_df(spark, msgs)
        got = {r.seq: r.seed_seq for r in cl.greedy_themes(d, vec.tfidf(d), t).collect()}
        assert_moving_mean_rule(got, weight_maps(msgs), t)


def test_leader_follows_rule(spark):
    rng = random.Random(17)
    for t in (0.1, 0.3):
        msgs = random_messages(rng, 70)
        d = docs_df(spark, msgs)
        post = vec.tfidf(d)
        got = {r.seq: r.seed_seq for r in cl.leader_themes(d, vec.similarity_join(post, t)).collect()}
        assert_fixed_seed_rule(got, weight_maps(msgs), t)


def test_leader_chain_takes_few_rounds(spark):
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("arn", "elk", "ion", "oak", "ulm")]
    msgs = [f"{words[k]} {words[k + 1]}" for k in range(24)]  # each shares a word with the next only
    edges = vec.similarity_join(vec.tfidf(docs_df(spark, msgs)), 0.2)
    pairs = sorted((r.seq_a, r.seq_b) for r in edges.collect())
    assert pairs == [(k, k + 1) for k in range(23)]
    members, rounds = cl.members_by_round(edges)
    want, seeds = set(), set()
    for row in visited(range(24)):
        (want if {row - 1, row + 1} & seeds else seeds).add(row)
    assert {r.seq for r in members.collect()} == want and rounds <= 8
    none, rounds = cl.members_by_round(edges.limit(0))
    assert none.count() == 0 and rounds == 1


def test_invariants_and_partitioning(spark):
    rng = random.Random(23)
    rows = [(f"repo{k}", i, m) for k in range(3) for i, m in enumerate(random_messages(rng, 40))]
    d = spark.createDataFrame(rows, "repo string, seq long, message string")
    base = None
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        dd = d.repartition(parts)
        post = vec.tfidf(dd)
        ranked = cl.rank_clusters(cl.leader_themes(dd, vec.similarity_join(post, 0.2)), 2)
        res = sorted((r.repo, r.seq, r.cluster_id or 0) for r in ranked.collect())
        if base is None:
            base = res
        assert res == base
        assert len(res) == len(rows)  # each row once; clustered + unclustered = total
        sizes = ranked.filter("cluster_id IS NOT NULL").groupBy("repo", "cluster_id").count().collect()
        assert all(s["count"] >= 2 for s in sizes)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_keywords(spark):
    msgs = ["harbour lantern copper", "harbour meadow violin", "harbour glacier saddle"]
    d = docs_df(spark, msgs)
    post = vec.tfidf(d)
    ranked = cl.rank_clusters(cl.greedy_themes(d, post, 0.0), 1)
    kw = cl.top_keywords(ranked, post, 3).collect()
    terms = [r.term for r in sorted(kw, key=lambda r: r.rank)]
    assert len(terms) <= 3 and "harbour" in terms
    assert all(r.weight > 0 for r in kw)


def test_threshold_checked():
    import pytest
    with pytest.raises(ValueError):
        cl._check_args(1.5, 2)
    with pytest.raises(ValueError):
        cl._check_args(0.2, 0)


def test_distributed_rank_equals_window(spark):
    from logweave.operators.keyed import rank_within
    rng = random.Random(29)
    rows = [("hot" if i % 3 else f"r{i % 7}", i, rng.randint(1, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "repo string, seq long, size long")
    order = [F.desc("size"), F.asc("seq")]
    got = {(r.repo, r.seq): r.k for r in rank_within(df, "repo", order, "k").collect()}
    want = {}
    for repo, seq, size in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        want[repo, seq] = 1 + sum(1 for k in want if k[0] == repo) if repo != "hot" else None
    hot = sorted((-size, seq) for repo, seq, size in rows if repo == "hot")
    want.update({("hot", seq): k for k, (_, seq) in enumerate(hot, 1)})
    assert got == want
    assert rank_within(df.limit(0), "repo", order, "k").count() == 0


def test_successor_pairs_bridge_gaps(spark):
    rows = [(9, 1), (2, 1), (40, 1), (3, 2), (7, None), (8, None), (100, 3)]
    v = spark.createDataFrame(rows, "vec_id long, label int")
    assert {tuple(r) for r in vec.successor_pairs(v, "vec_id", "label").collect()} == {(2, 9), (9, 40), (7, 8)}


def test_collapsed_leader_equals_plain(spark):
    rng = random.Random(41)
    base = random_messages(rng, 30)
    msgs = [rng.choice(base) for _ in range(120)] + ["", "", "harbour"]
    rows = [(f"r{i % 2}", i, m) for i, m in enumerate(msgs)]
    d = spark.createDataFrame(rows, "repo string, seq long, message string")
    post = vec.tfidf(d).cache()
    for t in (0.0, 0.2, 0.6):
        plain = {(r.repo, r.seq): r.seed_seq
                 for r in cl.leader_themes(d, vec.similarity_join(post, t)).collect()}
        coll = {(r.repo, r.seq): r.seed_seq
                for r in cl.leader_themes_collapsed(d, post, t).collect()}
        assert coll == plain


def test_pair_dots_sparse_x2(spark):
    rng = random.Random(37)
    msgs = random_messages(rng, 30)
    d = docs_df(spark, msgs)
    post = vec.tfidf(d)
    pairs = spark.createDataFrame([("r", i, j) for i in range(30) for j in range(i + 1, 30) if (i + j) % 4 == 0],
                                  "repo string, seq_a long, seq_b long")
    got = {(r.seq_a, r.seq_b): r.sim for r in vec.pair_dots(post, pairs).collect()}
    maps = weight_maps(msgs)
    assert len(got) == pairs.count()
    assert all(abs(v - dot(maps[a], maps[b])) < CLOSE for (a, b), v in got.items())
