"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

Training runs in numpy on a bounded sample (``per_class`` rows of each
language, each row at most 8 bytes per bucket), prediction in Arrow batches on
whole texts.

Defined results: null text, or text without a letter, is ``und`` with score 0
and rejected; a null id is never held out and never trained on; an empty table,
or one without a labelled row, gives ``und`` for every row; repeated rows are
predicted alike; ties go to the language that sorts first.  Input columns other
than id, text and label are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import buffers, held_out, lower_ascii, sheltered, table, tidy
from logweave.llm.features import collect_counts, gram_sums, matrix, per_class_sample


@dataclass
class LangModel:
    langs: list
    table: np.ndarray      # (1 << bits) + 1 rows: embedding times output weights, the last row zero
    bias: np.ndarray
    temperature: float
    reject_below: float
    bits: int


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(labels: list, sparse: list, bits: int, dim: int = 16, epochs: int = 12, batch: int = 64,
        rate: float = 0.5, lose: float = 0.002, seed: int = 5) -> LangModel | None:
    """SGD on mean embeddings; every fifth row calibrates temperature and rejection.

    ``reject_below``: the top probability that all but a share ``lose`` of the
    rightly predicted calibration rows reach, at most 0.5.
    """
    if not labels:
        return None
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    calib, train = (order[::5], np.setdiff1d(order, order[::5])) if len(y) >= 50 else (order, order)
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    gain = np.float32(20.0)  # mean embeddings are short vectors; this widens them
    for e in range(epochs):
        step = np.float32(rate * (1 - e / epochs))
        for at in range(0, len(train), batch):
            rows = train[rng.permutation(len(train))[:batch]]
            x = matrix(sparse, rows, bits)
            z = gain * (x @ emb)
            p = _softmax(z @ out + bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = gain * (p @ out.T)
            out -= step * (z.T @ p)
            bias -= step * p.sum(axis=0)
            touched = np.flatnonzero(x.any(axis=0))
            emb[touched] -= step * gain * (x[:, touched].T @ back)
    full = np.zeros(((1 << bits) + 1, len(langs)), np.float32)
    full[:-1] = gain * (emb @ out)
    z = np.concatenate([matrix(sparse, calib[k:k + 256], bits) @ full[:-1] for k in range(0, len(calib), 256)]) + bias
    heat = min(np.geomspace(0.25, 8, 60), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(calib)), y[calib]] + 1e-12).sum())
    p = _softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y[calib]]
    below = float(min(0.5, np.quantile(right, lose))) if len(right) else 0.0
    return LangModel(langs, full, bias, float(heat), below, bits)


def train(docs: DataFrame, per_class: int = 600, bits: int = 14, id_col="doc_id", text_col="text", label_col="lang") -> LangModel | None:
    """Fit on rows that are labelled, have text and an id, and are not held out."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("lang"))
    df = df.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    sample, counts = per_class_sample(df, "lang", per_class)
    labels, sparse, _ = collect_counts(sample, "lang", bits, 2 * per_class * max(1, len(counts)))
    return fit(labels, sparse, bits)


def _has_letter(b: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = lower_ascii(b)
    n = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    has = n[off[1:]] > n[off[:-1]]
    for r in np.flatnonzero(~has & (off[1:] > off[:-1])):
        has[r] = any(c.isalpha() for c in b[off[r]:off[r + 1]].tobytes().decode("utf-8", "replace"))
    return has


def predict(docs: DataFrame, model: LangModel | None, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` plus lang_pred, score (calibrated probability) and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (1 << bits) * languages floats

    @tidy
    def run(batches):
        m = shared.value
        for batch in batches:
            b, off = buffers(batch.column(0))
            has = _has_letter(b, off)
            rows = len(off) - 1
            if m is None:
                pred, score, rej = ["und"] * rows, np.zeros(rows), np.ones(rows, bool)
            else:
                total, count = gram_sums(b, off, m.table, m.bits)
                p = _softmax((total / np.maximum(count, 1)[:, None] + m.bias) / m.temperature)
                best = p.argmax(axis=1)
                score = np.where(has, p.max(axis=1), 0.0)
                pred = [m.langs[k] if h else "und" for k, h in zip(best, has)]
                rej = ~has | (score < m.reject_below)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rej, pa.bool_())],
                [*batch.schema.names[1:], "lang_pred", "score", "rejected"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    src = docs.select(F.col(text_col).alias("_scored_text"), *keep)
    schema = ", ".join([f"`{c}` {t}" for c, t in src.dtypes[1:]] + ["lang_pred string", "score double", "rejected boolean"])
    return src.mapInArrow(run, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    src = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return predict(src, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@sheltered
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is not rejected, columns as they are."""
    cols = docs.columns
    return predict(docs, train(docs)).filter(~F.col("rejected")).select(*cols)
