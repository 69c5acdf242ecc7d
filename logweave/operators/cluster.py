"""Theme clustering and keywords.

* ``greedy_themes`` (C1) is the reference's exact rule: one pass in log
  order, a row joins the most similar *moving* centroid when cosine >
  threshold, else seeds a new cluster.  The rule is sequential inside a
  repo, so a repo is one ``applyInPandas`` group; it has no row limit and is
  meant for small windows that the caller chooses.
* ``leader_themes`` (C2) is the corpus-scale form: seeds do not move.  Rows
  are visited in a fixed random order; a row is a seed iff no *seed* before
  it has cosine > threshold with it, and any other row joins its most similar
  seed.  It runs as rounds of joins over undecided edges, few because the
  order is random, with written tables between rounds.
  C1 and C2 give different clusters by design.
* ``rank_clusters`` (C3) drops clusters below ``min_size`` and numbers the
  rest by size desc, then seed order.
* ``top_keywords`` (C4) takes the k heaviest terms of the mean member vector.
"""

from __future__ import annotations

import functools
import logging
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.keyed import rank_within
from logweave.operators.packs import Packs
from logweave.operators.vectors import pack
from logweave.session import checkpoint_dir, drop_folder, drop_stored, stored

LOG = logging.getLogger(__name__)
TIE_DIGITS = 9


def _check_args(threshold: float, min_size: int) -> None:
    if not (0.0 <= float(threshold) <= 1.0):
        raise ValueError("threshold must be within 0.0-1.0")
    if int(min_size) != min_size or min_size < 1:
        raise ValueError("min_size must be a positive integer")


# ---------------------------------------------------------------------------
# Exact sequential rule, one repo per group
# ---------------------------------------------------------------------------

def _greedy_group(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    pdf = pdf.sort_values("seq", kind="stable")
    index: dict = {}      # term -> {cluster: running sum of weights}
    sq: list = []         # squared norm of each cluster's running sum
    seeds: list = []
    out = []
    for seq, terms, weights in zip(pdf["seq"], pdf["terms"], pdf["weights"]):
        terms = [] if terms is None else list(terms)
        weights = [] if weights is None else [float(w) for w in weights]
        vv = math.fsum(w * w for w in weights)
        dots: dict = {}
        for t, w in zip(terms, weights):
            m = index.get(t)
            if m:
                for c, s in m.items():
                    dots[c] = dots.get(c, 0.0) + w * s
        best, best_key = -1, None
        for c, d in dots.items():
            sim = d / math.sqrt(sq[c]) if sq[c] > 0 else 0.0
            if sim > threshold:
                key = (round(sim, TIE_DIGITS), -c)
                if best_key is None or key > best_key:
                    best, best_key = c, key
        if best < 0:
            c = len(sq)
            sq.append(vv)
            seeds.append(int(seq))
            for t, w in zip(terms, weights):
                index.setdefault(t, {})[c] = w
            out.append((int(seq), int(seq)))
        else:
            sq[best] += 2.0 * dots[best] + vv
            for t, w in zip(terms, weights):
                m = index.setdefault(t, {})
                m[best] = m.get(best, 0.0) + w
            out.append((int(seq), seeds[best]))
    res = pd.DataFrame(out, columns=["seq", "seed_seq"])
    res.insert(0, "repo", pdf["repo"].iloc[0] if len(pdf) else None)
    return res


def greedy_themes(docs: DataFrame, postings: DataFrame, threshold: float = 0.20) -> DataFrame:
    """``(repo, seq, seed_seq)`` for every document (seed_seq = first
    member of its cluster).  Rows without tokens become singletons.  A repo is
    one task; ``leader_themes`` is the form for whole corpora."""
    _check_args(threshold, 1)
    packed = docs.select("repo", "seq").join(pack(postings), ["repo", "seq"], "left")
    t = float(threshold)
    return packed.groupBy("repo").applyInPandas(
        lambda pdf: _greedy_group(pdf, t),
        schema="repo string, seq long, seed_seq long")


# ---------------------------------------------------------------------------
# Fixed seeds, distributed rounds
# ---------------------------------------------------------------------------

def priority(seq="seq") -> Column:
    """Place of a row in the visiting order of C2: 60 bits of ``md5(repo:seq)``."""
    text = F.concat_ws(":", F.col("repo"), F.col(seq).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def members_by_round(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(repo, seq)`` of the rows that are no seeds, and the number of rounds.

    An edge points from the row visited first to the other.  In a round the rows
    that no pending edge reaches are seeds, the rows they point at are members, and
    edges at a member are settled.  The visiting order is random, so chains break
    everywhere at once: rounds grow with the logarithm of the longest chain, and a
    round reads only edges between rows that are still undecided.
    """
    a, b = F.struct(priority("seq_a"), "seq_a"), F.struct(priority("seq_b"), "seq_b")
    pending = edges.select("repo", F.when(a < b, F.col("seq_a")).otherwise(F.col("seq_b")).alias("first"),
                           F.when(a < b, F.col("seq_b")).otherwise(F.col("seq_a")).alias("then"))
    found, rounds, written = [], 0, None
    while True:
        waiting = pending.select("repo", F.col("then").alias("first"))
        members = stored(pending.join(waiting, ["repo", "first"], "left_anti")
                         .select("repo", F.col("then").alias("seq")).distinct(), "members")
        left = (pending.join(members.withColumnRenamed("seq", "first"), ["repo", "first"], "left_anti")
                .join(members.withColumnRenamed("seq", "then"), ["repo", "then"], "left_anti")
                .select("repo", "first", "then"))
        left = stored(left, "pending")
        if written is not None:
            drop_stored(written)
        pending = written = left
        found.append(members)
        rounds += 1
        if pending.isEmpty():
            LOG.info("seeds settled after %d rounds", rounds)
            return functools.reduce(DataFrame.unionByName, found), rounds


def leader_themes(docs: DataFrame, edges: DataFrame, edges_materialized: bool = False) -> DataFrame:
    """``(repo, seq, seed_seq)`` for every document.

    ``edges`` are the similarity-join output (``seq_a < seq_b``, sim >
    threshold).  Rows are visited in the order of ``priority``; a row is a seed
    unless a seed before it is similar, and any other row joins its most similar
    seed (ties within 9 places: the first in the log).
    """
    checkpoint_dir(docs.sparkSession)
    nodes = docs.select("repo", "seq").distinct()
    e = edges.select("repo", "seq_a", "seq_b", "sim")
    if not edges_materialized:
        e = stored(e, "edges")
    members, _ = members_by_round(e)
    seeds = nodes.join(members, ["repo", "seq"], "left_anti")
    both = (e.select("repo", F.col("seq_a").alias("seed"), F.col("seq_b").alias("seq"), "sim")
            .unionByName(e.select("repo", F.col("seq_b").alias("seed"), F.col("seq_a").alias("seq"), "sim")))
    best = (both.join(seeds.withColumnRenamed("seq", "seed"), ["repo", "seed"], "left_semi")
            .groupBy("repo", "seq")
            .agg(F.max(F.struct(F.round("sim", TIE_DIGITS).alias("s"), (-F.col("seed")).alias("neg"))).alias("b")))
    return (seeds.select("repo", "seq", F.col("seq").alias("seed_seq"))
            .unionByName(best.select("repo", "seq", (-F.col("b.neg")).alias("seed_seq"))))


# ---------------------------------------------------------------------------
# C3, C4
# ---------------------------------------------------------------------------

def cluster_sizes(assignment: DataFrame, min_size: int = 2) -> DataFrame:
    """Kept clusters ``(repo, seed_seq, size, cluster_id)``; cluster_id
    is the 1-based rank by size desc, then seed order."""
    _check_args(0.0, min_size)
    sizes = (assignment.groupBy("repo", "seed_seq").agg(F.count(F.lit(1)).alias("size"))
             .filter(F.col("size") >= int(min_size)))
    ranked = rank_within(sizes, "repo", [F.desc("size"), F.asc("seed_seq")], "cluster_id")
    return ranked.withColumn("cluster_id", F.col("cluster_id").cast("int"))


def rank_clusters(assignment: DataFrame, min_size: int = 2, kept: DataFrame | None = None) -> DataFrame:
    """Assignment with ``cluster_id`` (NULL = unclustered) and ``size``;
    ``kept``: the ``cluster_sizes`` of the assignment where they are at hand."""
    kept = cluster_sizes(assignment, min_size) if kept is None else kept
    return assignment.join(kept, ["repo", "seed_seq"], "left").select(
        "repo", "seq", "seed_seq", "cluster_id", "size")


def top_keywords(ranked: DataFrame, postings: DataFrame | Packs, k: int = 5) -> DataFrame:
    """C4: ``(repo, cluster_id, rank, term, weight)``: the k heaviest terms of
    each cluster's mean member vector, weights > 0 only.  Ties: weight
    (rounded to 9 places) desc, then term.  ``postings`` may be ``packs.Packs``."""
    members = ranked.filter(F.col("cluster_id").isNotNull()).select("repo", "seq", "cluster_id", "size")
    rows = (postings.cluster_sums(members) if isinstance(postings, Packs) else
            postings.select("repo", "seq", "term", "weight").join(members, ["repo", "seq"]))
    mean = (rows.groupBy("repo", "cluster_id", "term")
            .agg((F.sum("weight") / F.first("size")).alias("weight"))
            .filter(F.col("weight") > 0))
    w = Window.partitionBy("repo", "cluster_id").orderBy(
        F.desc(F.round("weight", TIE_DIGITS)), F.asc("term"))
    return (mean.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= int(k))
            .select("repo", "cluster_id", "rank", "term", "weight"))


def keyword_lists(keywords: DataFrame) -> DataFrame:
    """``(repo, cluster_id, keywords array<string>)`` in rank order (<= k)."""
    return (keywords.groupBy("repo", "cluster_id")
            .agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("kw"))
            .select("repo", "cluster_id", F.col("kw.term").alias("keywords")))


# ---------------------------------------------------------------------------
# C2 without all-pairs inside groups of exact copies
# ---------------------------------------------------------------------------

def later_copies(postings: DataFrame) -> DataFrame:
    """``(repo, seq, rep)`` for every document that is an exact copy (same
    token multiset, hence the same TF-IDF vector) of another; ``rep``
    is the copy visited first (see ``priority``).

    Each document's term bag is hashed by aggregates that combine before the
    shuffle; only documents whose hash is shared are compared
    on the full bag, so hash collisions cannot merge different documents and
    only real copies travel through the exact grouping.  Hot groups go
    through partial aggregation and skew-split joins, never one task.
    """
    bag = F.sort_array(F.collect_list(F.struct("term", "cnt")))
    sig = (postings.groupBy("repo", "seq")
           .agg(F.bit_xor(F.xxhash64("term", "cnt")).alias("x"), F.count(F.lit(1)).alias("n_terms"))
           .select("repo", "seq", F.xxhash64("x", "n_terms").alias("h")))
    shared = (sig.groupBy("repo", "h").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1).select("repo", "h"))
    cand = sig.join(shared, ["repo", "h"], "left_semi")
    bags = (postings.join(cand.select("repo", "seq"), ["repo", "seq"], "left_semi")
            .groupBy("repo", "seq").agg(bag.alias("bag")))
    first = (bags.groupBy("repo", "bag").agg(F.min(F.struct(priority().alias("p"), "seq")).alias("f"))
             .select("repo", "bag", F.col("f.seq").alias("rep")))
    return (bags.join(first, ["repo", "bag"]).filter(F.col("seq") != F.col("rep"))
            .select("repo", "seq", "rep"))


FIRST_ROWS = 1024    # rows of the largest repo that the first level of C2 holds
LEVEL_BITS = 2       # each level holds 2 ** LEVEL_BITS times the rows before it


def _levels(most: int) -> tuple[int, Column]:
    """Number of the last level and the level of a row, by its place in the visiting order."""
    last = 0
    while FIRST_ROWS << (LEVEL_BITS * last) < most:
        last += 1
    bounds = [1 << (60 - LEVEL_BITS * (last - j)) for j in range(last)]    # of ``priority``, 60 bits
    return last, functools.reduce(lambda a, b: a + (priority() >= F.lit(b)).cast("int"), bounds, F.lit(0))


def leader_themes_by_levels(nodes: DataFrame, placed, last: int, threshold: float) -> DataFrame:
    """C2, as ``leader_themes``, from vectors in files (``blocks.Placed``, of rows of ``nodes``,
    with their ``_levels``) without a table of all links.

    The visiting order is cut into levels that grow by a constant factor.  A row of a
    level that is near a seed of the levels before it is a member; only rows that are not
    are linked among themselves and settled in rounds.  After a share of a random order
    has been visited, a row that is left has few links to others that are left, so these
    links grow about as the rows.  Every member is compared with every seed once, and of
    that only its nearest seeds become rows.
    """
    from logweave.operators import blocks

    t = float(threshold)
    key = ["repo", "seq"]
    rows = placed.rows
    seeds, near = [], []
    for j in range(last + 1):
        left = rows.filter(F.col("level") == j)
        if seeds:
            known = placed.where(functools.reduce(DataFrame.unionByName, seeds))
            near.append(stored(blocks.nearest(placed.where(left), known, t), "near"))
            left = stored(left.join(near[-1].select(*key).distinct(), key, "left_anti"), "left")
        edges = stored(blocks.links(placed.where(left), t), "edges")
        members, _ = members_by_round(edges)
        seeds.append(stored(left.join(members, key, "left_anti"), "seeds"))
        drop_stored(edges)
        known = functools.reduce(DataFrame.unionByName, [s.select(*key) for s in seeds])
        others = rows.filter(F.col("level") <= j).join(known, key, "left_anti")
        near.append(stored(blocks.nearest(placed.where(others), placed.where(seeds[-1]), t), "near"))
    best = (functools.reduce(DataFrame.unionByName, near).groupBy(*key)
            .agg(F.max(F.struct(F.round("sim", TIE_DIGITS).alias("s"), (-F.col("seed")).alias("neg"))).alias("b")))
    return (nodes.select(*key).distinct().join(best, key, "left")
            .select("repo", "seq", F.coalesce(-F.col("b.neg"), F.col("seq")).alias("seed_seq")))


def leader_themes_packed(docs: DataFrame, packs, threshold: float = 0.20) -> DataFrame:
    """C2 from ``packs.Packs``; same result as ``leader_themes_collapsed`` with the postings of
    ``docs``.  Copies are found by digests of their words and counts, and no posting is a row."""
    from logweave.operators import blocks

    t = float(threshold)
    if not 0 < t < 1 - 1e-9:
        raise ValueError("threshold must be within 0.0-1.0, both excluded")
    key = ["repo", "seq"]
    # vectors are written with their levels, so these are set from all documents of a repo
    most = packs.sizes.agg(F.max("n_docs")).first()[0] or 0
    last, level = _levels(most)
    vectors = blocks.placed(packs.vectors(level))
    rows = vectors.rows
    first = (rows.groupBy("repo", "digest").agg(F.min(F.struct(priority().alias("p"), "seq")).alias("f"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1").select("repo", "digest", F.col("f.seq").alias("rep")))
    later = stored(rows.join(first, ["repo", "digest"]).filter(F.col("seq") != F.col("rep")).select("repo", "seq", "rep"), "copies")
    single = vectors.where(stored(rows.join(later, key, "left_anti"), "singles"))
    nodes = docs.select(*key).join(later, key, "left_anti")
    assign = stored(leader_themes_by_levels(nodes, single, last, t), "assigned")
    drop_folder(docs.sparkSession, vectors.folder)
    copies = later.join(assign.withColumnRenamed("seq", "rep"), ["repo", "rep"]).select("repo", "seq", "seed_seq")
    return assign.unionByName(copies)


def leader_themes_collapsed(docs: DataFrame, postings: DataFrame, threshold: float = 0.20,
                            method: str = "blocks") -> DataFrame:
    """C2 with exact copies collapsed; same result as
    ``leader_themes(docs, similarity_join(postings, threshold))``.

    A later copy (in visiting order) always has a similar row before it (the
    first copy, or the seed that copy joined), so it is never a seed, and members
    never influence who becomes a seed.  Seeds are therefore found on one
    representative per copy group, with edges only among representatives, and
    copies go where their representative goes: its similarities are theirs, and
    where it is a seed itself no seed is nearer.  A group of m copies costs O(m)
    rows instead of m^2 / 2 edges.

    ``method="blocks"`` (default) goes by levels (``leader_themes_by_levels``) and keeps no
    table of all links; "prefix" and "plain" write the edges of ``similarity_join``.
    """
    from logweave.operators import blocks
    from logweave.operators.vectors import similarity_join

    pairs = "prefix" if method == "blocks" else method

    t = float(threshold)
    _check_args(t, 1)
    if t >= 1.0 - 1e-9:  # identical vectors are not "similar" at t = 1
        return leader_themes(docs, similarity_join(postings, t, pairs))
    checkpoint_dir(docs.sparkSession)
    later = stored(later_copies(postings), "copies")
    rep_postings = postings.join(later.select("repo", "seq"), ["repo", "seq"], "left_anti")
    nodes = docs.select("repo", "seq").join(later.select("repo", "seq"), ["repo", "seq"], "left_anti")
    if method == "blocks" and t > 0:
        coded = blocks.coded(rep_postings)
        most = coded.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        last, level = _levels(most)
        vectors = coded.withColumn("level", level.cast("int")).sortWithinPartitions("repo", "level")
        assign = leader_themes_by_levels(nodes, blocks.placed(vectors), last, t)
    else:
        edges = stored(similarity_join(rep_postings, t, pairs), "edges")
        assign = leader_themes(nodes, edges, edges_materialized=True)
    copies = later.join(assign.withColumnRenamed("seq", "rep"), ["repo", "rep"]).select("repo", "seq", "seed_seq")
    return assign.unionByName(copies)


def link_counts(docs: DataFrame, postings: DataFrame, threshold: float = 0.20) -> DataFrame:
    """X3 as one row per document, ``(repo, seq, class_id, n_links)``: the least ``seq`` of
    the documents with the same tokens (its own where it has none), and the number of other
    documents of the repo with cosine > threshold.

    Links are counted between classes and weighted by their copies, so no pair becomes a
    row; every pair of classes is compared.
    """
    from logweave.operators import blocks

    t = float(threshold)
    if not 0 < t < 1 - 1e-9:
        raise ValueError("threshold must be within 0.0-1.0, both excluded")
    key = ["repo", "seq"]
    later = stored(later_copies(postings), "copies")
    classes = (later.groupBy("repo", "rep").agg((F.count(F.lit(1)) + 1).alias("copies"), F.min("seq").alias("m"))
               .select("repo", F.col("rep").alias("seq"), "copies", F.least("m", "rep").alias("class_id")))
    firsts = blocks.coded(postings.join(later.select(*key), key, "left_anti"))
    sized = stored(firsts.join(classes.select(*key, "copies"), key, "left")
                   .withColumn("copies", F.coalesce("copies", F.lit(1))), "classes")
    n = blocks.degrees(sized, t).groupBy(*key).agg(F.sum("n").alias("n"))
    place = later.select("repo", "seq", "rep")
    rows = docs.select(*key).distinct().join(place, key, "left").withColumn("rep", F.coalesce("rep", "seq"))
    of_class = (classes.join(n, key, "full").withColumnRenamed("seq", "rep"))
    return rows.join(of_class, ["repo", "rep"], "left").select(
        "repo", "seq", F.coalesce("class_id", "seq").alias("class_id"),
        (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"))
