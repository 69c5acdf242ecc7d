"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  A window is
``size`` consecutive words of an item; an item of fewer words, but not none, is
one window.  Documents are scanned by rolling hashes, every hit is verified on
the words themselves, and the hit words are removed or their document is.

The broadcast holds at most ``broadcast_bytes`` of benchmark text (one item at
least).  A larger benchmark is dealt into parts of that size, scanned one after
the other over a table in the shared folder; hits add up, so results are the
same at any size.

Defined results: null text has no words; a null item id counts as the text
``null``; repeated items count once; repeated documents are judged alike; an
empty benchmark hits nothing.  Input columns other than id and text are kept by
``decontaminate`` and ignored by ``scan``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import blocks, buffers, cut, lower_ascii, shelter, sheltered, table, tidy, window_hashes, words

STEP = 1 << 18  # hashes put into a bitmap at a time
SPANS = "array<struct<begin:bigint,end:bigint>>"


class Windows:
    """Hash set of item windows in flat arrays, some seven bytes per byte of benchmark.

    The lower-cased texts lie in one array, with begin and end of every word.  Per window
    length: the window hashes in ascending order, beside each the number of its first word,
    and a bitmap of the leading hash bits.  Equal hashes are neighbours; ``mixed`` holds
    the starts of runs whose windows are not all the same words.
    """

    def __init__(self, items: pa.Table, size: int):
        raw, off = buffers(items.column("text"))
        self.names, self.text = items.column("item").combine_chunks(), lower_ascii(raw)
        kind = np.uint32 if len(raw) < 1 << 32 else np.int64
        begin, end, first, keys, places, total = [], [], [], {}, {}, 0
        for lo, hi in blocks(off):
            b, e, h, f = words(self.text[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            begin.append((b + off[lo]).astype(kind))
            end.append((e + off[lo]).astype(kind))
            first.append(f[:-1] + total)
            n = np.diff(f)
            length, room = np.repeat(np.minimum(n, size), n), np.repeat(f[1:], n) - np.arange(len(h))
            for m in np.unique(length).tolist():
                at = np.flatnonzero((length == m) & (room >= m))
                keys.setdefault(m, []).append(window_hashes(h, m)[at])
                places.setdefault(m, []).append((at + total).astype(kind))
            total += len(h)
        join = lambda parts, dtype: np.concatenate(parts) if parts else np.zeros(0, dtype)
        self.begin, self.end, self.first = join(begin, kind), join(end, kind), join(first, np.int64)
        del begin, end, first
        self.tables = {}
        for m in sorted(keys):
            key, place = np.concatenate(keys.pop(m)), np.concatenate(places.pop(m))
            order = np.argsort(key, kind="stable")
            key, place = key[order], place[order]
            del order
            bits = max(12, math.ceil(math.log2(len(key) * 32)))
            shift, bitmap = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
            for k in range(0, len(key), STEP):
                byte, bit = self._slots(key[k:k + STEP], shift)
                np.bitwise_or.at(bitmap, byte, np.left_shift(np.uint8(1), bit))
            again = np.flatnonzero(key[1:] == key[:-1]) + 1
            odd = [i for i in again.tolist() if not self._equal(int(place[i - 1]), int(place[i]), m)]
            mixed = set(np.searchsorted(key, key[odd]).tolist())
            self.tables[m] = (key, place, bitmap, shift, mixed)

    @staticmethod
    def _slots(hashes: np.ndarray, shift: np.uint64):
        slot = hashes >> shift
        return (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)

    def _words(self, at: int, m: int) -> list[bytes]:
        return [self.text[x:y].tobytes() for x, y in zip(self.begin[at:at + m].tolist(), self.end[at:at + m].tolist())]

    def _equal(self, p: int, q: int, m: int) -> bool:
        whole = [self.text[self.begin[x]:self.end[x + m - 1]].tobytes() for x in (p, q)]
        return whole[0] == whole[1] or self._words(p, m) == self._words(q, m)

    def hits(self, b: np.ndarray, offsets: np.ndarray):
        """(row -> word mask, row -> item ids) for rows with a hit, first word of each row, word begins and ends."""
        begin, end, h, first = words(b, offsets)
        mask, items = np.zeros(len(h), bool), {}
        for m, (keys, places, bitmap, shift, mixed) in self.tables.items():
            win = window_hashes(h, m)
            byte, bit = self._slots(win, shift)
            at = np.flatnonzero((bitmap[byte] >> bit) & 1)
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + m <= first[row + 1]
            at, row = at[inside], row[inside]
            lo, hi = (np.searchsorted(keys, win[at], side=side) for side in ("left", "right"))
            for p, r, i, j in zip(at.tolist(), row.tolist(), lo.tolist(), hi.tolist()):
                if i == j:
                    continue
                own = [lower_ascii(b[x:y]).tobytes() for x, y in zip(begin[p:p + m].tolist(), end[p:p + m].tolist())]
                run = places[i:j]
                same = [self._words(q, m) == own for q in (run if i in mixed else run[:1]).tolist()]
                if not any(same):
                    continue
                mask[p:p + m] = True
                run = run[same] if i in mixed else run
                items.setdefault(r, set()).update((np.searchsorted(self.first, run, side="right") - 1).tolist())
        return mask, {r: {self.names[k].as_py() for k in found} for r, found in items.items()}, first, begin, end


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"),
                            F.col("text")).filter("text is not null").distinct()


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_bytes: int = 64 << 20,
         id_col="doc_id", text_col="text", keep: tuple = ()) -> DataFrame:
    """id, ``keep`` columns, n_words, word_spans (hit runs of words), byte_spans
    (their places in the UTF-8 text) and items (sorted ids) of every document."""
    spark = docs.sparkSession
    items = _items(benchmark)
    n, total = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text") + F.octet_length("item"))).first()
    parts = max(1, min(n, math.ceil((total or 0) / broadcast_bytes)))
    extra = [c for c in keep if c not in (id_col, text_col)]
    df = docs.select(F.col(text_col).alias("_text"), F.col(id_col).alias("_id"), *extra,
                     F.lit(None).cast("bigint").alias("n_words"), F.array().cast(SPANS).alias("word_spans"),
                     F.array().cast(SPANS).alias("byte_spans"), F.array().cast("array<string>").alias("items"))
    fixed = 2 + len(extra)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    scanned = False
    for part in range(parts):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow()  # bounded: see total
        if not rows.num_rows and (scanned or part + 1 < parts):
            continue
        if scanned:
            df = cut(df, "decontam")
        shared = spark.sparkContext.broadcast(Windows(rows, size))
        step = lambda it, shared=shared: _scan_batches(it, shared.value, fixed)
        df, scanned = df.mapInArrow(step, schema), True
    return df.withColumnsRenamed({"_id": id_col, "_text": text_col})


@tidy
def _scan_batches(it, windows: Windows, fixed: int):
    struct = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in it:
        b, off = buffers(batch.column(0))
        old_spans, old_items = batch.column(fixed + 1).to_pylist(), batch.column(fixed + 3).to_pylist()
        n_words, spans, places, items = [], [], [], []
        for lo, hi in blocks(off):
            base = off[lo]
            mask, found, first, begin, end = windows.hits(b[base:off[hi]], off[lo:hi + 1] - base)
            for r in range(hi - lo):
                f, t = first[r], first[r + 1]
                n_words.append(int(t - f))
                if r not in found and not old_spans[lo + r]:
                    spans.append([])
                    places.append([])
                    items.append(old_items[lo + r])
                    continue
                own = mask[f:t].copy()
                for s in old_spans[lo + r]:
                    own[s["begin"]:s["end"]] = True
                runs, start = _runs(own), off[lo + r] - base
                spans.append([{"begin": x, "end": y} for x, y in runs])
                places.append([{"begin": int(begin[f + x] - start), "end": int(end[f + y - 1] - start)} for x, y in runs])
                items.append(sorted({*old_items[lo + r], *found.get(r, ())}))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:fixed], pa.array(n_words, pa.int64()), pa.array(spans, struct), pa.array(places, struct),
             pa.array(items, pa.list_(pa.string()))], batch.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = 10) -> DataFrame:
    """``docs`` without contaminated documents, or (mode ``spans``) with the hit
    spans of their texts replaced by one space; columns as they were."""
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode {mode}")
    docs, restore = shelter(docs, ("doc_id", "text"))
    cols = docs.columns
    found = scan(docs, benchmark, size, keep=tuple(cols))
    if mode == "documents":
        return restore(found.filter(F.size("items") == 0).select(*cols))
    raw = F.encode("text", "UTF-8")
    # the kept stretches between the spans, decoded one by one: span ends are word ends, never inside a character
    edges = F.transform(F.sequence(F.lit(0), F.size("byte_spans")), lambda k: F.substring(
        raw, (F.when(k == 0, F.lit(0)).otherwise(F.col("byte_spans")[k - 1]["end"]) + 1).cast("int"),
        (F.when(k == F.size("byte_spans"), F.octet_length("text")).otherwise(F.col("byte_spans")[k]["begin"])
         - F.when(k == 0, F.lit(0)).otherwise(F.col("byte_spans")[k - 1]["end"])).cast("int")))
    text = F.when(F.size("byte_spans") > 0, F.array_join(F.transform(edges, lambda x: F.decode(x, "UTF-8")), " ")).otherwise(F.col("text"))
    return restore(found.withColumn("text", text).select(*cols))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    found = scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


@sheltered
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark window."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_W = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_W} AS w FROM documents),
b AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_W} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
        FROM b, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT rid, m, k, array_to_string(w[k:k + m - 1], ' ') AS g
       FROM d, sizes, unnest(range(1, greatest(0, len(w) - m + 1) + 1)) AS u(k)),
hit AS (SELECT rid, k, win.m, item FROM dw JOIN win ON dw.m = win.m AND dw.g = win.g),
words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM hit, unnest(range(k, k + m)) AS u(j) GROUP BY rid),
found AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""
