"""X3 as pairs: the registered query, edges from packs, links that leave a task in steps."""

import numpy as np
import pyarrow as pa
import pytest

from logweave.operators import blocks, packs
from logweave.operators import vectors as vec
from logweave.plans import catalog
from test_blocks import messages, small_blocks
from test_packs import odd_messages


def test_similarity_pairs_returns_every_pair(spark, monkeypatch):
    docs = messages(spark, 40, 7).unionByName(messages(spark, 40, 7).selectExpr("repo", "seq + 100 AS seq", "message"))
    monkeypatch.setattr(catalog, "_docs", lambda *_: docs)
    got = catalog.QUERIES["similarity_pairs"](spark, "")
    assert got.columns == ["repo", "seq_a", "seq_b", "sim"]
    want = sorted((r.repo, r.seq_a, r.seq_b, round(r.sim, 6)) for r in vec.similarity_join(vec.tfidf(docs), 0.2, "plain").collect())
    assert sorted(map(tuple, got.collect())) == want and any(b == a + 100 and s == 1 for _, a, b, s in want)


@pytest.mark.parametrize("threshold", [0.0, 0.2])
def test_edges_of_packs_equal_plain_join(spark, monkeypatch, threshold):
    small_blocks(monkeypatch)
    monkeypatch.setattr(packs, "PACK_TOKENS", 30)
    monkeypatch.setattr(packs, "SLICE_ROWS", 2)
    docs = odd_messages(spark)
    rows = lambda e: sorted((r.repo, r.seq_a, r.seq_b, round(r.sim, 9)) for r in e.collect())
    want = rows(vec.similarity_join(vec.tfidf(docs), threshold, "plain"))
    assert rows(vec.similarity_join(packs.pack_texts(docs), threshold)) == want and want


def test_links_leave_a_task_in_steps(monkeypatch):
    n = 60
    monkeypatch.setattr(blocks, "CELLS", 2 * n)
    monkeypatch.setattr(blocks, "LINK_ROWS", 100)
    monkeypatch.setattr(blocks, "_placed", lambda docs: docs)
    monkeypatch.setattr(blocks, "_meet", lambda left, right, fn, schema, same: fn)
    same = pa.table({"seq": pa.array(range(n)), "ids": pa.array([[4]] * n), "weights": pa.array([[1.0]] * n), "copies": pa.array([1] * n)})
    block = blocks._Block(same)
    sizes = [len(t) for t in blocks.links(None, 0.2)("r", True, block, block)]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) < 100 + 2 * n and np.count_nonzero(sizes) > 10
