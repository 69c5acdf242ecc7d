"""Working memory of the text stages."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from logweave.llm import features, ngram_join, pieces, suffix_dedup
from logweave.llm.common import prepare


def peak_mb(fn):
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def some_text(n, seed=3):
    return np.random.default_rng(seed).choice(np.frombuffer(b"etaoinshrdlu  .", np.uint8), n)


def test_gram_sums_do_not_hold_the_weights_of_a_whole_cut():
    b, bits = some_text(1 << 20), 10
    off = np.array([0, 0, 5, 70000, 70001, 400000, 400000, len(b)], np.int64)
    weight = np.random.default_rng(1).normal(0, 1, ((1 << bits) + 1, 48)).astype(np.float32)
    weight[-1] = 0
    got = []
    assert peak_mb(lambda: got.append(features.gram_sums(b, off, weight, bits))) < 180  # the last row's weights are 118 MB
    total, count = got[0]
    for r, (lo, hi) in enumerate(zip(off[:-1], off[1:])):
        one = [features.gram_ids(b[lo:hi], n, bits) for n in features.SIZES]
        assert count[r] == sum(map(len, one))
        assert np.allclose(total[r], sum((weight[x].sum(axis=0, dtype=np.float64) for x in one), np.zeros(48)), atol=0.2)
    many = np.arange(0, len(b) + 1, 1 << 12)
    assert peak_mb(lambda: features.gram_sums(b, many, weight, bits)) < 60  # 201 MB for the weights of the whole cut


@pytest.mark.parametrize("step", [64, 1000, 1 << 18])
def test_anchors_do_not_depend_on_the_step(monkeypatch, step):
    b = some_text(20000)
    b[3000:4000] = 97  # periodic
    off = np.array([0, 10, 49, 5000, 5050, 12000, len(b)], np.int64)
    want = suffix_dedup.anchors(b, off, 50)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_BYTES", step)
    got = suffix_dedup.anchors(b, off, 50)
    assert len(want[0]) > 500 and all((x == y).all() for x, y in zip(want, got))


def test_steps_over_long_batches_stay_small(monkeypatch):
    b = some_text(2 << 20)
    off = np.arange(0, len(b) + 1, 1 << 12)
    assert peak_mb(lambda: suffix_dedup.anchors(b, off, 50)) < 60
    texts = pa.array([b[lo:hi].tobytes().decode() for lo, hi in zip(off[:-1], off[1:])])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts, pa.array(range(len(texts)))], ["id", "text", "text_hash"])
    out = []
    assert peak_mb(lambda: out.extend(ngram_join._sign(5)([batch]))) < 40
    monkeypatch.setattr(ngram_join, "SIGN_BYTES", 1 << 22)
    assert list(ngram_join._sign(5)([batch]))[0].equals(out[0])


def test_lattice_of_many_words_is_cut(monkeypatch):
    p, _ = pieces.pieces_of(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    text = " ".join("".join(chr(97 + x) for x in rng.integers(0, 26, 9)) for _ in range(90000))
    got = []
    assert peak_mb(lambda: got.extend(p.encode([text], {}))) < 80
    assert got[0].tolist() == p.sp.encode(text)


def test_batches_of_whole_texts_are_short(spark):
    prepare(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
