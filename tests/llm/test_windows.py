"""The flat window table of decontamination: colliding hashes, shared windows, size."""

import tracemalloc

import numpy as np
import pyarrow as pa

from logweave.llm import decontam


def windows_of(items, size=10):
    return decontam.Windows(pa.table({"item": pa.array([i for i, _ in items], pa.string()), "text": pa.array([t for _, t in items], pa.string())}), size)


def hits(w, text):
    b = np.frombuffer(text.encode(), np.uint8)
    mask, items, _, _, _ = w.hits(b, np.array([0, len(b)], np.int64))
    return mask.astype(int).tolist(), sorted(items.get(0, ()))


def test_windows_shared_by_items_and_empty_items():
    w = windows_of([("a", "One two, three"), ("b", "?!"), ("c", "one  two three four"), ("d", ""), ("e", "x one two three")], 3)
    assert hits(w, "so ONE two (three) five") == ([0, 1, 1, 1, 0], ["a", "c", "e"])
    assert hits(w, "two three four") == ([1, 1, 1], ["c"])
    assert hits(w, "one two") == ([0, 0], []) and hits(w, "") == ([], [])
    assert hits(windows_of([]), "one two") == ([0, 0], [])


def test_colliding_hashes_are_told_apart(monkeypatch):
    real = decontam.window_hashes
    monkeypatch.setattr(decontam, "window_hashes", lambda h, m: real(h, m) % np.uint64(3) << np.uint64(60))
    items = [(str(k), f"w{k} v{k % 4} u{k % 2}") for k in range(40)] + [("s", "w1 v1 u1")]
    w = windows_of(items, 2)
    assert hits(w, "v1 u1 zz") == ([1, 1, 0], sorted([str(k) for k in range(40) if k % 4 == 1] + ["s"]))
    assert hits(w, "w1 v1") == ([1, 1], ["1", "s"]) and hits(w, "w1 v2 u1") == ([0, 0, 0], [])


def test_memory_grows_with_a_few_times_the_benchmark():
    rng = np.random.default_rng(5)
    items = [(str(k), " ".join(f"word{x}" for x in rng.integers(0, 100000, 400))) for k in range(1000)]
    size = sum(len(t) for _, t in items)
    windows_of(items)  # tables of the word hashes are kept by the process
    tracemalloc.start()
    w = windows_of(items)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 10 * size and peak < 25 * size
    assert hits(w, items[7][1])[1] == ["7"]
