"""Sparse TF-IDF vectors and cosine similarity.

Text stays in long form ``(repo, seq, term, weight)``; the dense n x V matrix
is never built.  Everything is plain DataFrame work: explode, hash
aggregations, equi-joins on ``(repo, term)`` and per-document windows.

Deviations from the reference (documented): weights are DOUBLE, not float32;
ties are broken on values rounded to 9 places so summation order cannot flip
them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions.text import tokenize
from logweave.operators import blocks
from logweave.operators.keyed import join_per_repo, rank_within
from logweave.operators.packs import Packs
from logweave.session import checkpoint_dir, stored

PREFIX_SLACK = 1e-9


def token_rows(docs: DataFrame, text_col: str = "message") -> DataFrame:
    """P9 exploded: ``(repo, seq, pos, term)``; pos is the token's index.

    Texts are dealt by document before they are split, so whatever groups tokens by
    document and term afterwards does so where they lie and no token is shuffled."""
    sc = docs.sparkSession.sparkContext
    parts = max(sc.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.select("repo", "seq", text_col).repartition(parts, "repo", "seq").select(
        "repo", "seq", F.posexplode(tokenize(text_col)).alias("pos", "term"))


def vocab_stats(tokens: DataFrame) -> DataFrame:
    """``(repo, term, df, term_id)``; ``term_id`` is first-seen order
    (by ``seq`` then token position), 0-based per repo.

    Tokens are first reduced to one row per document and term, and all aggregates are
    plain numbers (a least struct would sort every token)."""
    per_doc = tokens.groupBy("repo", "seq", "term").agg(F.min("pos").alias("pos"))
    least = per_doc.groupBy("repo", "term").agg(
        F.count("seq").alias("df"), F.min("seq").alias("_seq"), F.min_by("pos", "seq").alias("_pos"),
        F.min(F.when(F.col("seq").isNull(), F.col("pos"))).alias("_null"))   # no seq comes first
    agg = stored(least.select("repo", "term", "df",
                              F.when(F.col("_null").isNull(), F.col("_seq")).alias("first_seq"),
                              F.coalesce("_null", "_pos").alias("_pos")), "vocabulary")
    ranked = rank_within(agg, "repo", [F.col("first_seq"), F.col("_pos")], "_rk")
    return ranked.select("repo", "term", "df", (F.col("_rk") - 1).alias("term_id"), "first_seq")


def tfidf(docs: DataFrame, text_col: str = "message", term_ids: bool = False) -> DataFrame:
    """Smooth TF-IDF, L2-normalised -> postings ``(repo, seq, term, cnt,
    df, weight)``; with ``term_ids`` also ``term_id``, a number of each (repo, term).

    ``idf = ln((1 + n) / (1 + df)) + 1`` where n counts every document of the
    repo, including those without tokens (they get no postings).  TF is
    ``cnt / total``; the L2 norm cancels ``total``, so
    ``weight = cnt * idf / ||cnt * idf||``.
    """
    # ``counts`` feeds the df aggregation and the join; writing it once to
    # the shared checkpoint folder keeps the regex work to one pass
    checkpoint_dir(docs.sparkSession)
    counts = stored(token_rows(docs, text_col).groupBy("repo", "seq", "term")
                    .agg(F.count(F.lit(1)).alias("cnt")), "counts")
    n_docs = docs.groupBy("repo").agg(F.count(F.lit(1)).alias("n_docs"))
    df = counts.groupBy("repo", "term").agg(F.count(F.lit(1)).alias("df"))
    if term_ids:
        df = stored(df.withColumn("term_id", F.monotonically_increasing_id()), "terms")
    idf = (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    # the terms of a partition are hashed: neither side is sorted by its words
    raw = join_per_repo(counts.join(df.hint("shuffle_hash"), ["repo", "term"]), n_docs,
                        salt_cols=("seq", "term")).withColumn("raw", F.col("cnt") * idf)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("repo", "seq")))
    return raw.select("repo", "seq", "term", "cnt", "df", (F.col("raw") / norm).alias("weight"),
                      *(["term_id"] if term_ids else []))


def pack(postings: DataFrame) -> DataFrame:
    """Per document ``(repo, seq, terms, weights)`` (terms sorted)."""
    return (postings.groupBy("repo", "seq")
            .agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("tw"))
            .select("repo", "seq", F.col("tw.term").alias("terms"),
                    F.col("tw.weight").alias("weights")))


# ---------------------------------------------------------------------------
# Similarity
# ---------------------------------------------------------------------------

def _pair_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    a = left.select("repo", "term", F.col("seq").alias("seq_a"), F.col("weight").alias("wa"))
    b = right.select("repo", "term", F.col("seq").alias("seq_b"), F.col("weight").alias("wb"))
    return a.join(b, ["repo", "term"]).filter(F.col("seq_a") < F.col("seq_b"))


def _plain_join(postings: DataFrame) -> DataFrame:
    return (_pair_rows(postings, postings)
            .groupBy("repo", "seq_a", "seq_b")
            .agg(F.sum(F.col("wa") * F.col("wb")).alias("sim")))


def pair_dots(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """X2 for a pair list: exact dot of the two documents' unit vectors.

    The pair list drives the join: each pair is expanded by the postings of
    its shorter document, which are then looked up in the other document
    on ``(repo, seq, term)``.  Pairs without a shared term get 0.
    """
    sizes = postings.groupBy("repo", "seq").agg(F.count(F.lit(1)).alias("n_terms"))
    p = (pairs.select("repo", "seq_a", "seq_b")
         .join(sizes.withColumnRenamed("seq", "seq_a").withColumnRenamed("n_terms", "na"),
               ["repo", "seq_a"], "left")
         .join(sizes.withColumnRenamed("seq", "seq_b").withColumnRenamed("n_terms", "nb"),
               ["repo", "seq_b"], "left"))
    a_short = F.coalesce(F.col("na"), F.lit(0)) <= F.coalesce(F.col("nb"), F.lit(0))
    oriented = p.select("repo", "seq_a", "seq_b",
                        F.when(a_short, F.col("seq_a")).otherwise(F.col("seq_b")).alias("probe"),
                        F.when(a_short, F.col("seq_b")).otherwise(F.col("seq_a")).alias("other"))
    probe = postings.select("repo", F.col("seq").alias("probe"), "term", F.col("weight").alias("wp"))
    other = postings.select("repo", F.col("seq").alias("other"), "term", F.col("weight").alias("wo"))
    dots = (oriented.join(probe, ["repo", "probe"])
            .join(other, ["repo", "other", "term"])
            .groupBy("repo", "seq_a", "seq_b")
            .agg(F.sum(F.col("wp") * F.col("wo")).alias("sim")))
    return (pairs.select("repo", "seq_a", "seq_b")
            .join(dots, ["repo", "seq_a", "seq_b"], "left")
            .select("repo", "seq_a", "seq_b", F.coalesce("sim", F.lit(0.0)).alias("sim")))


def _split_postings(postings: DataFrame, budget: float) -> DataFrame:
    """Mark each posting as prefix or suffix and attach the document's
    suffix norm.  Terms are ordered rare -> common (``df, term``); the suffix
    is the longest common-term tail whose L2 norm is <= budget."""
    w = (Window.partitionBy("repo", "seq")
         .orderBy(F.desc("df"), F.desc("term"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tail = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w))
    marked = (postings.select("repo", "seq", "term", "df", "weight")
              .withColumn("tail", tail)
              .withColumn("in_prefix", F.col("tail") > F.lit(budget - PREFIX_SLACK)))
    s_norm = F.max(F.when(~F.col("in_prefix"), F.col("tail"))).over(Window.partitionBy("repo", "seq"))
    return marked.withColumn("s_norm", F.coalesce(s_norm, F.lit(0.0))).drop("tail")


def similarity_join(postings: DataFrame | Packs, threshold: float = 0.2,
                    method: str = "prefix", suffix_budget: float | None = None,
                    block: int = 2048) -> DataFrame:
    """Every pair in a repo with cosine > threshold (strict), as edges
    ``(repo, seq_a, seq_b, sim)`` with ``seq_a < seq_b``.

    ``method="prefix"`` (default) never joins the common-term tails of two
    documents against each other:

    1. each document's terms are split into a prefix (rare terms) and a
       suffix (the common-term tail, L2 norm <= ``suffix_budget``, default
       and at most the threshold, so words common to all stay out);
    2. ``A(a, b)`` = dot over a's *prefix* terms, from joining prefix
       postings with all postings on (repo, term).  Any pair with cosine >
       threshold shares its rarest common term in a's prefix, so it has
       ``A > 0`` and appears here;
    3. the rest of the dot is at most ``||suffix(a)||`` (Cauchy-Schwarz), so
       pairs with ``A + ||suffix(a)|| <= threshold`` are dropped exactly;
    4. for the remaining pairs ``B(a, b)`` = dot over a's suffix terms is
       looked up, and ``sim = A + B``.

    The postings of a term that stands in more than ``block`` documents are
    dealt into blocks by document, and each pair of blocks is its own join key,
    so one key yields at most about ``block`` squared pairs.  Nothing is dropped.

    ``method="plain"`` joins all postings on (repo, term).  Both return the
    same edges.

    ``postings`` may be ``packs.Packs``: then the edges come from products of blocks of
    vectors in files (``blocks.links``), and neither postings nor partial sums are rows.
    """
    if method not in ("prefix", "plain"):
        raise ValueError("method must be 'prefix' or 'plain'")
    t = float(threshold)
    if isinstance(postings, Packs):
        if t > 0:
            return blocks.links(blocks.placed(postings.vectors(F.lit(0))), t)
        postings = postings.postings()
    if method == "plain" or t <= 0:
        return _plain_join(postings).filter(F.col("sim") > F.lit(t))
    budget = t if suffix_budget is None else min(float(suffix_budget), t)
    # marked postings are read three times below: materialise them once in
    # the shared checkpoint folder (cuts lineage, no recomputed TF-IDF)
    checkpoint_dir(postings.sparkSession)
    marked = _split_postings(postings, budget).checkpoint()
    n_blocks = F.ceil(F.col("df") / F.lit(block))
    own = F.pmod(F.xxhash64("seq"), n_blocks)
    other = F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1))
    pre = marked.filter("in_prefix").select(
        "repo", "term", F.col("seq").alias("seq_a"), F.col("weight").alias("wa"),
        F.col("s_norm").alias("sa"), own.alias("block_a"), other.alias("block_b"))
    full = marked.select("repo", "term", F.col("seq").alias("seq_b"), F.col("weight").alias("wb"))
    dealt = marked.select("repo", "term", F.col("seq").alias("seq_b"), F.col("weight").alias("wb"),
                          own.alias("block_b"), other.alias("block_a"))
    part = (pre.join(dealt, ["repo", "term", "block_a", "block_b"]).filter(F.col("seq_a") < F.col("seq_b"))
            .groupBy("repo", "seq_a", "seq_b")
            .agg(F.sum(F.col("wa") * F.col("wb")).alias("a_dot"), F.max("sa").alias("sa")))
    kept = part.filter(F.col("a_dot") + F.col("sa") > F.lit(t - PREFIX_SLACK))
    suf = marked.filter(~F.col("in_prefix")).select(
        "repo", "term", F.col("seq").alias("seq_a"), F.col("weight").alias("wa"))
    rest = (kept.select("repo", "seq_a", "seq_b").join(suf, ["repo", "seq_a"])
            .join(full, ["repo", "seq_b", "term"])
            .groupBy("repo", "seq_a", "seq_b")
            .agg(F.sum(F.col("wa") * F.col("wb")).alias("b_dot")))
    sims = (kept.join(rest, ["repo", "seq_a", "seq_b"], "left")
            .select("repo", "seq_a", "seq_b",
                    (F.col("a_dot") + F.coalesce("b_dot", F.lit(0.0))).alias("sim")))
    return sims.filter(F.col("sim") > F.lit(t))


def pairwise_similarity(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """The sparse symmetric similarity matrix ``(repo, seq_i, seq_j, sim)``:
    both orientations of every pair sharing a term, plus the diagonal (1.0,
    or 0.0 for a document without tokens).  Zero entries are omitted.

    Output size is the number of term-sharing pairs; meant for small groups.
    """
    sims = _plain_join(postings)
    mirror = sims.select("repo", F.col("seq_b").alias("seq_a"), F.col("seq_a").alias("seq_b"), "sim")
    has_terms = postings.select("repo", "seq").distinct().withColumn("has", F.lit(True))
    diag = (docs.select("repo", "seq").join(has_terms, ["repo", "seq"], "left")
            .select("repo", F.col("seq").alias("seq_a"), F.col("seq").alias("seq_b"),
                    F.when(F.col("has"), F.lit(1.0)).otherwise(F.lit(0.0)).alias("sim")))
    return (sims.unionByName(mirror).unionByName(diag)
            .withColumnRenamed("seq_a", "seq_i").withColumnRenamed("seq_b", "seq_j"))


def array_dot(a, b) -> Column:
    """X2 for ``array<float|double>`` columns: dot product (the cosine of two
    unit vectors), computed in double."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def successor_pairs(vectors: DataFrame, id_col: str, group_col: str) -> DataFrame:
    """``(id_a, id_b)``: every id with the next one of its group in id order, whatever
    gaps lie between; rows without a group are a group of their own."""
    rows = vectors.select(F.col(id_col).alias("id"), F.coalesce(F.col(group_col).cast("string"), F.lit("")).alias("g"))
    placed = stored(rank_within(rows, "g", [F.asc("id")], "k"), "successors")
    return (placed.select("g", "k", F.col("id").alias("id_a"))
            .join(placed.select("g", (F.col("k") - 1).alias("k"), F.col("id").alias("id_b")), ["g", "k"])
            .select("id_a", "id_b"))


def array_normalize(a) -> Column:
    """L2-normalise an array column (zero vector stays zero)."""
    a = F.col(a) if isinstance(a, str) else a
    norm = F.sqrt(array_dot(a, a))
    safe = F.when(norm == 0, F.lit(1.0)).otherwise(norm)
    return F.transform(a, lambda x: x.cast("double") / safe)
