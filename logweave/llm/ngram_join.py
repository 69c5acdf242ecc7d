"""N-gram Jaccard join: MinHash LSH forest and exact verification.

A document is the set of its five-word shingles.  Equal sets form one class.  Each of
``TREES`` trees gives a class a label of ``MAX_DEPTH`` hash values of 16 bits; the
sorted labels of a tree are a prefix trie, and the common prefix of sorted neighbours
is the longest that a class shares with any other.  Matching starts at whole labels
and shortens them one value in one tree at a time (all trees to 7 values, then to 6,
and so on) until a pair is met in some tree with probability ``RECALL``.  How far a
class goes depends on the lowest similarity of at least the threshold that sets of its
size can have: at 0.8, six shingles stop at 0.83 and keep longer prefixes, up to three
shingles have no partner but their copies, large sets go on to the threshold itself.
Two classes are candidates where a common prefix has the length that both ask for.
Recall by the formula is at least ``RECALL`` for every pair, because a linked pair is at
least as similar as the lowest value of either size, and all classes shorten in one order.
Inside the nodes of the shortest prefixes, sketches drop pairs that are far below the
threshold (five standard deviations) and what remains forms candidate families; there
every pair is verified on the whole shingle sets.

Labels are range-sorted with the class as the last key, so a label that stands in a
third of all classes is dealt over tasks; the first and last row of a task always stay.

Defined results: null text, or text without words, has no shingles and links with
nothing; text of fewer than five words is one shingle; equal sets are linked,
repeated rows too; null ids take part and are never the smallest; an empty table
gives no rows.  Input columns other than id and text are ignored by ``join`` and
kept by ``stage``.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import blocks, buffers, cut, sheltered, table, tidy, window_hashes, words
from logweave.llm.graph import components, linked_rows, on_cells, pairs_of, results, to_cells

TREES, MAX_DEPTH = 24, 8
#: probability that the forest meets a pair whose similarity is the lowest that its class may have
RECALL = 0.9999
#: sets of more shingles are taken to reach the threshold itself
SMALL_SET = 64
#: bytes of whole texts whose shingles are formed at once, in arrays of 64-bit hashes
SIGN_BYTES = 1 << 18


def depths(steps: int) -> list[int]:
    """Length of the prefix in each tree after so many single shortenings."""
    return [MAX_DEPTH - (steps + TREES - 1 - t) // TREES for t in range(TREES)]


def ascent(similarity: float, recall: float = RECALL) -> int:
    """Shortenings after which a pair of that similarity is met with the wanted probability
    (or all prefixes are of one value)."""
    for steps in range(TREES * (MAX_DEPTH - 1)):
        if 1 - math.prod(1 - similarity ** d for d in depths(steps)) >= recall:
            return steps
    return TREES * (MAX_DEPTH - 1)


def prefix_depth(threshold: float) -> int:
    """Shortest prefix that any class asks for."""
    return min(depths(ascent(threshold)))


def lowest_similarity(n: int, threshold: Fraction) -> Fraction | None:
    """Lowest Jaccard similarity of at least the threshold that a set of ``n`` can have with
    another set; None where it has none."""
    found = []
    for m in range(math.ceil(n * threshold), math.floor(n / threshold) + 1):
        shared = math.ceil(threshold * (n + m) / (1 + threshold))  # least that reaches the threshold
        if shared <= min(n, m) and 2 * shared < n + m:
            found.append(Fraction(shared, n + m - shared))
    return min(found, default=None)


def shingles(b: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, and the index of each row's first."""
    _, _, h, first = words(b, offsets)
    win = window_hashes(h, size)
    out, start = [], [0]
    for lo, hi in zip(first[:-1], first[1:]):
        s = np.unique(win[lo:hi - size + 1]) if hi - lo >= size else (
            window_hashes(h[lo:hi], int(hi - lo)) if hi > lo else np.zeros(0, np.uint64))
        out.append(s)
        start.append(start[-1] + len(s))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(start, np.int64)


def _hash_params(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8)
    return rng.integers(0, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2 ** 63, n, dtype=np.uint64)


def minhash(s: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """Signatures (rows x n) of the rows that have shingles."""
    a, c = _hash_params(n)
    at = start[:-1]
    out = np.empty((len(at), n), np.uint64)
    for k in range(n):
        x = s * a[k] + c[k]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = np.minimum.reduceat(x, at)
    return out


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.md5(s.tobytes()).digest()


def _sign(size: int):
    @tidy
    def run(batches):
        for batch in batches:
            b, off = buffers(batch.column(1))
            node, count, labels = [], [], []
            for lo, hi in blocks(off, SIGN_BYTES):
                base = off[lo]
                s, start = shingles(b[base:off[hi]], off[lo:hi + 1] - base, size)
                has = start[1:] > start[:-1]
                some = np.concatenate([start[:-1][has], start[-1:]])
                sig = minhash(s, some, TREES * MAX_DEPTH) if has.any() else np.zeros((0, TREES * MAX_DEPTH), np.uint64)
                sig = (sig & np.uint64(0xFFFF)).astype(">u2")
                k = 0
                for r in range(hi - lo):
                    if has[r]:
                        node.append(set_digest(s[start[r]:start[r + 1]]))
                        labels.append(sig[k].tobytes())
                        k += 1
                    else:
                        node.append(None)
                        labels.append(None)
                count.extend((start[1:] - start[:-1]).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(node, pa.binary()), pa.array(count, pa.int64()), pa.array(labels, pa.binary())],
                ["id", "text_hash", "node", "n", "labels"])
    return run


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading values that the rows of both share."""
    return np.logical_and.accumulate(a == b, axis=1).sum(axis=1)


def _nodes(shortest: list[int]):
    """Rows (bucket, node) of the sorted labels that share a prefix of the wanted length with
    a neighbour; the bucket is the trie node of the tree's shortest prefix."""
    wanted = np.array([depths(k) for k in range(TREES * (MAX_DEPTH - 1) + 1)])

    def kept(tree, label, node, steps, before, behind):
        on = np.flatnonzero(np.maximum(before, behind) >= wanted[steps, tree])
        bucket = [bytes([t]) + label[k, :shortest[t]].tobytes() for k, t in zip(on.tolist(), tree[on].tolist())]
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.binary()), pa.array([node[k] for k in on], pa.binary())], ["bucket", "node"])

    @tidy
    def run(batches):
        last, before = None, MAX_DEPTH
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = batch.column(0).to_numpy()
            label = buffers(batch.column(1))[0].view(">u2").reshape(-1, MAX_DEPTH)
            node, steps = batch.column(2).to_pylist(), batch.column(3).to_numpy()
            if last is not None:
                tree, label, steps = (np.concatenate(x) for x in zip(last[:2] + last[3:], (tree, label, steps)))
                node = last[2] + node
            same = np.where(tree[1:] == tree[:-1], common_prefix(label[1:], label[:-1]), 0)
            front = np.concatenate([[before], same])
            yield kept(tree[:-1], label[:-1], node[:-1], steps[:-1], front[:-1], same)
            last, before = (tree[-1:].copy(), label[-1:].copy(), node[-1:], steps[-1:].copy()), int(front[-1])
        if last is not None:
            yield kept(*last, np.array([before]), np.array([MAX_DEPTH]))
    return run


def equal_bytes(sketches: np.ndarray) -> np.ndarray:
    """Number of equal places of every two rows."""
    n = len(sketches)
    if n <= 24:
        return (sketches[:, None, :] == sketches[None, :, :]).sum(axis=2)
    out = np.zeros((n, n), np.int16)
    for c in np.ascontiguousarray(sketches.T):
        out += c[:, None] == c[None, :]
    return out


def _family(least_equal: int):
    """Candidate pairs of a bucket: common prefix of the length both ask for, enough equal sketch bytes."""
    def work(c: dict):
        n = len(c["node"])
        label = np.frombuffer(b"".join(c["labels"]), ">u2").reshape(n, TREES * MAX_DEPTH)
        i, j = pairs_of(equal_bytes((label & 0xFF).astype(np.uint8)) >= least_equal, c["blk"])
        steps = np.array(c["steps"])
        if len(i) and steps.min() < steps.max():
            t = c["bucket"][0][0]
            own = label[:, t * MAX_DEPTH:(t + 1) * MAX_DEPTH]
            wanted = np.array([depths(k)[t] for k in c["steps"]])
            met = common_prefix(own[i], own[j]) >= np.maximum(wanted[i], wanted[j])
            i, j = i[met], j[met]
        return linked_rows(c["node"], i, j, [1] * n) if len(i) else None
    return work


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of bounded slices of the incidence matrix."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.float64)
    val, inv, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    on = cnt[inv] > 1
    col = (np.cumsum(cnt > 1) - 1)[inv[on]]
    row = row[on]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((n, n), np.float64)
    width = max(1, min(int(col[-1]) + 1 if len(col) else 1, (1 << 22) // n))
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        a = np.zeros((n, width), np.float32)
        a[row[lo:hi], col[lo:hi] - at] = 1
        out += a @ a.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verify(threshold: float):
    t_ = Fraction(threshold).limit_denominator(10_000)
    num, den = t_.numerator, t_.denominator

    def work(c: dict):
        once = list({x: k for k, x in enumerate(c["node"])}.values())  # a repeated row stands here once
        if len(once) < 2:
            return None
        c = {name: [v[k] for k in once] for name, v in c.items()}
        sets = [np.frombuffer(x, np.uint64) for x in c["set"]]
        size = np.array([len(s) for s in sets], np.float64)
        linked = intersections(sets) * (num + den) >= num * (size[:, None] + size[None, :])
        i, j = pairs_of(linked, c["blk"])
        return linked_rows(c["node"], i, j, c["copies"]) if len(i) else None
    return work


def _sets(size: int):
    """Shingle sets of the texts whose digest is the class they were joined to."""
    @tidy
    def run(batches):
        for batch in batches:
            b, off = buffers(batch.column(1))
            want = batch.column(0).to_pylist()
            keep, sets = [], []
            for lo, hi in blocks(off, SIGN_BYTES):
                base = off[lo]
                s, start = shingles(b[base:off[hi]], off[lo:hi + 1] - base, size)
                for r in range(hi - lo):
                    one = s[start[r]:start[r + 1]]
                    if set_digest(one) == want[lo + r]:
                        keep.append(lo + r)
                        sets.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([want[k] for k in keep], pa.binary()), pa.array(sets, pa.binary())], ["node", "set"])
    return run


def join(docs: DataFrame, threshold: float = 0.8, size: int = 5, block: int = 512, block_bytes: int = 16 << 20,
         id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_links and component (smallest id reached) of every document, and text_hash."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(src.dtypes)["id"]
    exact = Fraction(threshold).limit_denominator(10_000)
    signed = cut(src.select("id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        _sign(size), f"id {kind}, text_hash bigint, node binary, n bigint, labels binary"), "signed")
    rows = signed.select("id", "node", "text_hash")
    cls = cut(signed.filter("node is not null").groupBy("node").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"),
        F.first("labels").alias("labels"), F.min(F.struct("id", "text_hash")).alias("at")), "sets")
    # shortenings of each class; none for sets that no other set can be linked with
    low = [lowest_similarity(n, exact) for n in range(1, SMALL_SET + 1)]
    small = F.array(*[F.lit(None if x is None else ascent(float(x))).cast("int") for x in low])
    asked = cls.select("node", "labels", F.when(F.col("n") > SMALL_SET, ascent(threshold)).otherwise(
        F.get(small, F.col("n").cast("int") - 1)).alias("steps")).filter("steps is not null")
    # sorted labels of every tree, and the nodes of the tries that hold more than one class
    width = 2 * MAX_DEPTH
    label = asked.select("node", "steps", "labels", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(
        "tree", F.expr(f"substring(labels, tree * {width} + 1, {width})").alias("label"), "node", "steps")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    label = label.repartitionByRange(parts, "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    slim = cut(label.mapInArrow(_nodes(depths(ascent(threshold))), "bucket binary, node binary"), "trie")
    full = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = slim.join(full, "bucket").join(asked, "node")
    n_hash = TREES * MAX_DEPTH
    chance = threshold + (1 - threshold) / 256
    least = math.floor(n_hash * chance - 5 * math.sqrt(n_hash * chance * (1 - chance)))
    pairs = on_cells(to_cells(met, "bucket", "node", F.ceil(F.col("members") / block)).select("cell", "blk", "node", "labels", "steps", "bucket"),
                     _family(least))
    family = components(pairs.select(F.col("node").alias("a"), F.col("root").alias("b")))
    family = cut(family.join(cls.select("node", "n", "copies", "at"), "node"), "families")
    total = family.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") * 8 / block_bytes)).alias("n_blocks"))
    # whole texts of one row of each class in a family
    want = family.select("node", F.col("at.id").alias("id"), F.col("at.text_hash").alias("text_hash"))
    text = _texts(src, want)
    sets = text.mapInArrow(_sets(size), "node binary, set binary")
    ready = sets.join(family.select("node", "root", "copies"), "node").join(total, "root")
    found = on_cells(to_cells(ready, "root", "node", F.col("n_blocks")).select("cell", "blk", "node", "copies", "set"),
                     _verify(threshold))
    return results(rows, cls.select("node", "first", "copies"), found, "id").withColumnRenamed("id", id_col)


def _texts(src: DataFrame, want: DataFrame) -> DataFrame:
    """(node, text) of the wanted rows; a null id is found by its text hash."""
    w = want.select("node", F.coalesce(F.xxhash64("id", "text_hash"), F.lit(0)).alias("key"))
    s = src.select(F.xxhash64("id", F.xxhash64("text")).alias("key"), "text")
    return s.join(w.hint("merge"), "key").select("node", "text")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and class of every document."""
    out = join(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_links", F.col("component").alias("class_id"),
                      F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()).alias("kept"))


@sheltered
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies, the row with the smallest id stays.

    Where that id stands in several equal rows, one of them stays.
    """
    cols = docs.columns
    out = cut(join(docs), "joined")
    keep = out.filter(F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull()))
    keep = cut(keep.groupBy(F.xxhash64("doc_id", "text_hash").alias("_key")).agg(F.count(F.lit(1)).alias("n")), "kept")
    left = docs.withColumn("_key", F.xxhash64("doc_id", F.xxhash64("text")))
    left = left.join(keep.select("_key").hint("merge"), "_key", "left_semi")
    if not keep.filter("n > 1").isEmpty():
        left = left.dropDuplicates(["_key"])
    return left.select(*cols)
