"""Quality scores by Bradley-Terry pairwise ranking.

Preference pairs (a good document beats a bad one) are drawn from a bounded
labelled sample; a linear score is learnt by logistic loss on feature
differences, mapped to a probability, and a quantile of the scores marks the
documents to keep.

Defined results: null and empty texts have the features of an empty text and
are scored like any other; a null id is never held out and never trained on;
labels that are null or neither 0 nor 1 are ignored, documents with several
labels count once per label; without both labels every score is the share of
label 1 (0.5 without labels); repeated rows score alike.  Input columns other
than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import buffers, cut, held_out, table, tidy, words
from logweave.llm.features import collect_counts, gram_sums, matrix, per_class_sample

N_SHAPE = 11
_CUT = 1 << 20


def _line(line: bytes):
    """Key of a whole line; long ones have a digest that can also be built cut by cut."""
    return hash(line) if len(line) <= _CUT else hashlib.blake2b(line, digest_size=16).digest()


def shape(b: np.ndarray) -> np.ndarray:
    """Shape of a whole text: length, kinds of bytes, repeated lines; read in cuts of bounded size."""
    n, kinds, lines, seen, rest, long = len(b), np.zeros(256, np.int64), 0, set(), b"", None
    for at in range(0, n, _CUT):
        piece = b[at:at + _CUT]
        kinds += np.bincount(piece, minlength=256)
        parts = (rest + piece.tobytes()).split(b"\n")
        if long is not None:  # the pending line is in its digest
            long.update(parts[0])
            if len(parts) == 1:
                continue
            lines += 1
            seen.add(long.digest())
            long, parts = None, parts[1:]
        rest = parts.pop()
        lines += len(parts)
        seen.update(map(_line, parts))
        if len(rest) > _CUT:
            long, rest = hashlib.blake2b(rest, digest_size=16), b""
    if n:
        lines += 1
        seen.add(_line(rest) if long is None else long.digest())
    _, _, h, _ = words(b, np.array([0, n], np.int64))
    echo = [float((h[k:] == h[:-k]).mean()) if len(h) > k else 0.0 for k in (1, 2, 3)]  # words that repeat the one 1, 2, 3 before
    d = max(1, n)
    letters = kinds[97:123].sum() + kinds[65:91].sum() + kinds[128:].sum()
    spaces = kinds[32] + kinds[10] + kinds[9]
    return np.array([np.log1p(n), letters / d, spaces / d, kinds[48:58].sum() / d, kinds[65:91].sum() / d,
                     (n - letters - spaces - kinds[48:58].sum()) / d, kinds[128:].sum() / d, len(seen) / max(1, lines), *echo])


@dataclass
class QualityModel:
    table: np.ndarray     # (1 << bits) + 1 weights of relative frequencies, the last one zero
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    slope: float
    offset: float
    bits: int


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(labels: list, sparse: list, shapes: list, counts: dict, bits: int, steps: int = 1500, pairs: int = 64,
        rate: float = 0.3, l2: float = 1e-5, seed: int = 9) -> QualityModel:
    """Bradley-Terry on random pairs, then a logistic map to the share of label 1."""
    y = np.array(labels, int) if labels else np.zeros(0, int)
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    blank = QualityModel(np.zeros(((1 << bits) + 1, 1), np.float32), np.zeros(N_SHAPE), np.zeros(N_SHAPE), np.ones(N_SHAPE), 0.0,
                         float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))), bits)
    if len(pos) < 5 or len(neg) < 5:
        return blank
    rng = np.random.default_rng(seed)
    s = np.array(shapes)
    mean, scale = s.mean(axis=0), s.std(axis=0) + 1e-6
    s = np.clip((s - mean) / scale, -5, 5)
    hold = np.zeros(len(y), bool)
    hold[np.concatenate([rng.permutation(pos)[::4], rng.permutation(neg)[::4]])] = True
    tp, tn = pos[~hold[pos]], neg[~hold[neg]]
    gain = np.float32(30.0)
    w, v = np.zeros(1 << bits, np.float32), np.zeros(N_SHAPE)
    for k in range(steps):
        a, b = rng.choice(tp, pairs), rng.choice(tn, pairs)
        x = gain * (matrix(sparse, a, bits) - matrix(sparse, b, bits))
        d = s[a] - s[b]
        g = _sigmoid(-(x @ w + d @ v)) / pairs
        step = rate * (1 - k / steps)
        w += np.float32(step) * (x.T @ g.astype(np.float32) - np.float32(l2) * w)
        v += step * (d.T @ g - l2 * v)
    raw = np.concatenate([gain * (matrix(sparse, range(k, min(len(y), k + 256)), bits) @ w) for k in range(0, len(y), 256)]) + s @ v
    # the logistic map uses rows that the ranking has not seen, each class at its weight in the table
    r, t = raw[hold], y[hold].astype(float)
    weight = np.where(t == 1, share / max(1, (t == 1).sum()), (1 - share) / max(1, (t == 0).sum()))
    slope, offset = 1.0, 0.0
    for _ in range(100):  # Newton steps on two numbers, with a small prior on the slope
        p = _sigmoid(slope * r + offset)
        e, h = weight * (p - t), weight * p * (1 - p) + 1e-9
        g = np.array([(e * r).sum() + 1e-4 * slope, e.sum()])
        hess = np.array([[(h * r * r).sum() + 1e-4, (h * r).sum()], [(h * r).sum(), h.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(hess, g), -1, 1)
        slope, offset = slope - move[0], offset - move[1]
    full = np.zeros(((1 << bits) + 1, 1), np.float32)
    full[:-1, 0] = gain * w
    return QualityModel(full, v, mean, scale, float(slope), float(offset), bits)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1200, bits: int = 13) -> QualityModel:
    """Fit on at most about ``per_class`` rows of either label, never on held-out ids."""
    lab = labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
    lab = lab.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id"))
    sample, counts = per_class_sample(lab, "quality", per_class)
    sample = sample.limit(4 * per_class)  # the size bound of the broadcast side
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    y, sparse, shapes = collect_counts(rows, "quality", bits, 4 * per_class, shape)
    return fit(y, sparse, shapes, counts, bits)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id``, ``score`` of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (1 << bits) floats

    @tidy
    def run(batches):
        m = shared.value
        for batch in batches:
            b, off = buffers(batch.column(1))
            total, count = gram_sums(b, off, m.table, m.bits)
            s = np.array([shape(b[lo:hi]) for lo, hi in zip(off[:-1], off[1:])]).reshape(-1, N_SHAPE)
            raw = total[:, 0] / np.maximum(count, 1) + np.clip((s - m.mean) / m.scale, -5, 5) @ m.dense
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_sigmoid(m.slope * raw + m.offset))], ["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_best(scored: DataFrame, drop_share: float = 0.1) -> DataFrame:
    """Add ``kept``: false for scores below the ``drop_share`` quantile of all scores."""
    at = scored.agg(F.percentile_approx("score", drop_share, 10_000)).first()[0]
    return scored.withColumn("kept", F.col("score") >= F.lit(at if at is not None else 0.0))


def op9_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = keep_best(cut(score(docs, model), "quality"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"), "kept")
