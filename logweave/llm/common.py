"""Helpers shared by the training-data operators: tables, shared-folder cuts, Arrow text buffers."""

from __future__ import annotations

import ctypes
import functools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.session import checkpoint_dir, pin_utc, ship_package

#: bytes of text that one numpy step works on; longer rows are cut inside the step
BLOCK_BYTES = 2 << 20


def prepare(spark: SparkSession) -> None:
    """Settings, package and shared folder that the operators need."""
    pin_utc(spark)
    ship_package(spark)
    checkpoint_dir(spark, local_fallback=True)
    # whole texts travel in Arrow batches; both sides of the pipe hold one batch at a time,
    # the JVM in buffers of the next power of two, beside its heap
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id):
    """True where crc32 of the id as text leaves 0 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage once (``checkpoint()`` would run the last stage twice) and
    survives lost executors.  The folder goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark, local_fallback=True).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


#: columns that the pipeline's stages read or set; all others only travel along
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shelter(docs: DataFrame, used: tuple = DOCUMENT_COLUMNS):
    """``docs`` with generated names for the columns that are not ``used``, and a function
    that gives a result its names back; a made column replaces one of its name."""
    tag = uuid.uuid4().hex[:12]
    names = {c if c in used else f"kept_{k}_{tag}": c for k, c in enumerate(docs.columns)}

    def restore(out: DataFrame) -> DataFrame:
        made = {c.lower() for c in out.columns if c not in names}
        return out.select(*[F.col(c).alias(names.get(c, c)) for c in out.columns if c not in names or names[c].lower() not in made])
    return docs.toDF(*names), restore


def sheltered(stage):
    """A stage whose other columns cannot clash with the names it uses inside."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        hidden, restore = shelter(docs)
        return restore(stage(spark, hidden, sf_dir))
    return run


def tidy(fn):
    """Give freed memory back when a task ends: Spark reuses Python workers, and a
    worker that keeps the peak of an earlier task takes it from the executor."""
    @functools.wraps(fn)
    def run(*args):
        try:
            yield from fn(*args)
        finally:
            pa.default_memory_pool().release_unused()
            libc = ctypes.CDLL(None)
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)
    return run


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    arr = pa.chunked_array(col) if isinstance(col, list) else col
    arr = arr.combine_chunks() if isinstance(arr, pa.ChunkedArray) else arr
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """Runs of rows (lo, hi) whose bytes sum to at most ``most``, or a single longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def reduced_rows(starts: np.ndarray, length: int, most: int):
    """Runs (a, z, begin, end) of rows that begin at ``starts`` and fill ``length`` places:
    rows a .. z - 1 stand at begin .. end - 1, at most ``most`` places or a single longer row."""
    for a, z in blocks(np.append(starts, length), most):
        yield a, z, int(starts[a]), int(starts[z]) if z < len(starts) else length


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POW: dict = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    have = _POW.get("p")
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        p, q = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _POW["p"] = have = (np.multiply.accumulate(p), np.multiply.accumulate(q))
    return have


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def lower_ascii(b: np.ndarray) -> np.ndarray:
    return _LOWER[b]


def _words(b: np.ndarray, starts: np.ndarray, inside: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the words of ``b``, runs of the bytes ``inside``; a word ends where a row begins."""
    if len(b) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    low = _LOWER[b]
    w = inside[low]
    prev = np.empty(len(w), bool)
    prev[0], prev[1:] = False, w[:-1]
    prev[starts[starts < len(b)]] = False
    begin = np.flatnonzero(w & ~prev)
    nxt = np.empty(len(w), bool)
    nxt[-1], nxt[:-1] = True, ~w[1:]
    nxt[starts[(starts > 0) & (starts <= len(b))] - 1] = True
    end = np.flatnonzero(w & nxt) + 1
    p, q = powers(len(b) + 1)
    t = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * p[:len(b)], out=t[1:])
    return begin, end, mix64((t[end] - t[begin]) * q[begin])


def words(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[0-9a-z and all above ASCII]+` of lower-cased (A-Z) rows.

    Returns begin, end (byte positions in ``b``), 64-bit hash, and the index of
    each row's first word (length rows + 1).  Works in cuts of bounded size; a
    cut inside a long row falls on a byte that belongs to no word.
    """
    out, at, n = [], 0, len(b)
    while at < n:
        to = min(n, at + BLOCK_BYTES)
        while to < n:  # move the cut behind the next separator
            sep = np.flatnonzero(~_WORD[_LOWER[b[to - 1:to + 65535]]])
            if len(sep):
                to = to + int(sep[0])
                break
            to = min(n, to + 65536)
        lo, hi = np.searchsorted(offsets, [at, to])
        x = _words(b[at:to], offsets[lo:hi] - at)
        out.append((x[0] + at, x[1] + at, x[2]))
        at = to
    if out:
        begin, end, h = (np.concatenate(x) for x in zip(*out))
    else:
        begin, end, h = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return begin, end, h, np.searchsorted(begin, offsets)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    m = np.uint64(0xD6E8FEB86659FD93)
    for k in range(size):
        out = out * m + h[k:k + n]
    return mix64(out)


def first_window_of_row(first_word: np.ndarray, size: int, n_windows: int) -> np.ndarray:
    """Mask of windows that stay inside one row."""
    ok = np.zeros(n_windows, bool)
    for lo, hi in zip(first_word[:-1], first_word[1:]):
        if hi - lo >= size:
            ok[lo:hi - size + 1] = True
    return ok


def groups_of(batches, key: int = 0):
    """(key, rows as tuples) of batches whose rows are sorted by column ``key``."""
    held: list = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[key] != held[0][key]:
                yield held[0][key], held
                held = []
            held.append(row)
    if held:
        yield held[0][key], held
