"""Hashed byte n-grams of whole texts, in numpy, and bounded labelled samples."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import BLOCK_BYTES, buffers, lower_ascii, reduced_rows, tidy

SIZES = (2, 3, 4)
#: n-grams whose weights are looked up at once
GRAM_ROWS = 1 << 16
_MULT = {2: 0x9E3779B1, 3: 0x85EBCA77, 4: 0xC2B2AE3D}


def gram_ids(low: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram at every position of ``low`` that has one."""
    m = len(low) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint32)
    key = low[:m].astype(np.uint32)
    for k in range(1, n):
        key |= low[k:k + m].astype(np.uint32) << np.uint32(8 * k)
    key *= np.uint32(_MULT[n])
    key ^= key >> np.uint32(15)
    key *= np.uint32(_MULT[n])
    return key >> np.uint32(32 - bits)


def gram_cuts(b: np.ndarray, offsets: np.ndarray, bits: int):
    """For cuts of bounded size: (first row, row starts inside the cut, ids per n-gram size).

    Positions whose n-gram would leave its row get the bucket ``1 << bits``.
    Rows of any length are covered, whole, by one or more cuts.
    """
    n, none = len(b), 1 << bits
    for at in range(0, n, BLOCK_BYTES):
        to = min(n, at + BLOCK_BYTES)
        low = lower_ascii(b[at:min(n, to + max(SIZES))])
        row = int(np.searchsorted(offsets, at, side="right")) - 1
        last = int(np.searchsorted(offsets, to, side="left"))
        starts = np.maximum(offsets[row:last], at) - at
        ends = offsets[row + 1:last + 1] - at
        out = []
        for size in SIZES:
            ids = np.full(to - at, none, np.uint32)
            got = gram_ids(low, size, bits)[:to - at]
            ids[:len(got)] = got
            for k in range(1, size):
                p = ends - k
                ids[p[(p >= 0) & (p < to - at)]] = none
            out.append(ids)
        yield row, starts, ends, out


def gram_sums(b: np.ndarray, offsets: np.ndarray, weight: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: sum of ``weight[bucket]`` (weight: (1 << bits) + 1 rows, the last one zero) and the number of n-grams."""
    rows = len(offsets) - 1
    total, count = np.zeros((rows, weight.shape[1])), np.zeros(rows)
    for row, starts, ends, all_ids in gram_cuts(b, offsets, bits):
        idx = row + np.arange(len(starts))
        length = len(all_ids[0])
        full = np.minimum(ends, length) > starts  # rows without bytes have nothing to sum
        if not full.any():
            continue
        s, i = starts[full], idx[full]
        # a few rows at a time: each n-gram takes a whole row of weights
        for a, z, begin, end in reduced_rows(s, length, GRAM_ROWS):
            for ids in all_ids:
                ids = ids[begin:end]
                total[i[a:z]] += np.add.reduceat(weight[ids], s[a:z] - begin, axis=0)
                count[i[a:z]] += np.add.reduceat((ids != (1 << bits)).astype(np.float64), s[a:z] - begin)
    return total, count


def sparse_counts(b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Non-zero buckets and counts of one whole text."""
    acc = np.zeros((1 << bits) + 1, np.int64)
    for _, _, _, all_ids in gram_cuts(b, np.array([0, len(b)], np.int64), bits):
        for ids in all_ids:
            acc += np.bincount(ids, minlength=len(acc))
    idx = np.flatnonzero(acc[:-1])
    return idx.astype(np.uint32), acc[idx].astype(np.float32)


def collect_counts(sample: DataFrame, label: str, bits: int, most_rows: int, more=None) -> tuple[list, list, list]:
    """(labels, sparse counts, extra features) of a bounded labelled sample.

    ``sample`` has ``doc_id``, ``text`` and the label column.  At most ``most_rows``
    rows reach the driver, each at most 8 bytes per bucket, whatever the text length.
    """
    @tidy
    def run(batches):
        for batch in batches:
            b, off = buffers(batch.column(1))
            idx, cnt, ext = [], [], []
            for lo, hi in zip(off[:-1], off[1:]):
                i, c = sparse_counts(b[lo:hi], bits)
                idx.append(i.tobytes())
                cnt.append(c.tobytes())
                ext.append(more(b[lo:hi]).astype(np.float64).tobytes() if more else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(idx, pa.binary()), pa.array(cnt, pa.binary()), pa.array(ext, pa.binary())],
                ["doc_id", "label", "idx", "cnt", "ext"])

    kind = dict(sample.dtypes)
    got = (sample.select("doc_id", "text", F.col(label).alias("label"))
           .mapInArrow(run, f"doc_id {kind['doc_id']}, label {kind[label]}, idx binary, cnt binary, ext binary")
           .limit(most_rows).collect())
    got.sort(key=lambda r: (r["doc_id"], r["idx"]))
    return ([r["label"] for r in got],
            [(np.frombuffer(r["idx"], np.uint32), np.frombuffer(r["cnt"], np.float32)) for r in got],
            [np.frombuffer(r["ext"], np.float64) for r in got])


def uniform(*cols):
    """A repeatable number in [0, 1) from a hash of the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def per_class_sample(df: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label value, chosen by a hash of ``doc_id``,
    and the number of rows of each value."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return df.limit(0), counts
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))]), F.col(label))
    return df.filter(uniform("doc_id", F.lit(17)) < share), counts


def matrix(sparse: list, rows, bits: int) -> np.ndarray:
    """Dense relative frequencies of the chosen rows."""
    x = np.zeros((len(rows), 1 << bits), np.float32)
    for k, r in enumerate(rows):
        i, c = sparse[r]
        if len(c):
            x[k, i] = c / c.sum()
    return x
