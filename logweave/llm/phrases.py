"""Phrase collocations: Misra-Gries summaries a hash partition, exact second count.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into
words ``[^\\x20\\x09]+``; everything is per lang (null: ``und``).  A phrase is 1 to
``max_words`` consecutive words of a piece.

First count, one round a phrase length: tasks hash the phrases of their texts, add up
equal ones and send them to hash partitions.  A partition first learns its mass (the
occurrences that reach it), then merges what it gets into a Misra-Gries summary of more
than mass / threshold counters: whatever is cut from a counter in all, ``D``, stays below
the threshold, so a phrase with ``threshold`` occurrences keeps a counter, and counter
+ D bounds its count from above.  Phrases with a bound below the threshold are dropped.
A phrase of k words is only sent if its first and last k - 1 words survived; survivors
travel as bits of one filter of ``2 ** filter_bits`` bits, a size that does not grow
with the data.  False positives of the filter cost time only.

Second count: the phrases in the filter of all rounds are counted as strings, exactly;
those below the threshold go.  Scores are integer arithmetic on DECIMAL(38,0).

Defined results: null and empty texts have no words; repeated rows count as often as
they stand there; ties in score and count go by phrase in byte order, ties between cuts
to the shorter first part; an empty table gives no rows.  Input columns other than text
and lang are ignored.  Long texts are read in cuts that overlap by max_words - 1 words.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import BLOCK_BYTES, _words, blocks, buffers, cut, lower_ascii, mix64, table, tidy

#: distinct phrases that a task adds up before it sends them on
HELD = 1 << 21
#: counters that a hash partition may need, by the bound on its mass
COUNTERS = 1 << 21
#: bits of the filter that travel as one row
SLICE_BITS = 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_BREAK
_INSIDE[[0x20, 0x09]] = False


class Segment:
    """Words of a stretch of text: begin, end, hash, piece, row; windows count if they end in a fresh word."""

    def __init__(self, b: np.ndarray, starts: np.ndarray, first_row: int, fresh: int):
        self.b = b
        self.begin, self.end, self.h = _words(b, starts, _INSIDE)
        self.row = np.searchsorted(starts, self.begin, side="right") - 1 + first_row
        self.piece = np.searchsorted(np.flatnonzero(_BREAK[b]), self.begin) + self.row
        self.fresh = int(np.searchsorted(self.begin, fresh))

    def inside(self, k: int) -> np.ndarray:
        """Mask of the windows of k words that lie in one piece."""
        n = max(0, len(self.h) - k + 1)
        return self.piece[:n] == self.piece[k - 1:k - 1 + n]

    def windows(self, k: int) -> np.ndarray:
        """The same without those that an earlier segment has counted."""
        out = self.inside(k)
        out[:max(0, self.fresh - k + 1)] = False
        return out

    def keys(self, at: np.ndarray, k: int, lang: np.ndarray) -> np.ndarray:
        """64-bit hash of lang and words of the windows that begin at ``at``."""
        out = lang[self.row[at]]
        for j in range(k):
            out = out * np.uint64(0xD6E8FEB86659FD93) + self.h[at + j]
        return mix64(out)


def segments(column, max_words: int):
    """The texts of an Arrow column as segments; a long text in overlapping cuts at blanks."""
    b, off = buffers(column)
    for lo, hi in blocks(off):
        if off[hi] - off[lo] <= BLOCK_BYTES:
            yield Segment(b[off[lo]:off[hi]], off[lo:hi] - off[lo], lo, 0)
            continue
        text, at, held = b[off[lo]:off[hi]], 0, 0
        while at < len(text):
            to = min(len(text), at + BLOCK_BYTES)
            while to < len(text):
                gap = np.flatnonzero(~_INSIDE[text[to:to + 65536]])
                if len(gap):
                    to += int(gap[0])
                    break
                to = min(len(text), to + 65536)
            seg = Segment(text[held:to], np.zeros(1, np.int64), lo, at - held)
            yield seg
            back = seg.begin[-(max_words - 1):] if max_words > 1 else seg.begin[:0]
            held, at = (held + int(back[0]) if len(back) else to), to


def _lang_hash(names: list[str | None]) -> np.ndarray:
    one = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(names)}
    return np.array([one[x] for x in names], np.uint64)


def _summed(held: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class MisraGries:
    """Summary of at most ``capacity`` counters; true count <= counter + cut."""

    def __init__(self, capacity: int):
        self.capacity, self.cut = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, held: list, cut: int = 0) -> None:
        """Add summaries (keys, counts) that have lost ``cut`` together."""
        self.cut += cut
        self.keys, self.counts = _summed([(self.keys, self.counts), *held])
        if len(self.keys) > self.capacity:
            least = int(np.partition(self.counts, len(self.counts) - self.capacity - 1)[len(self.counts) - self.capacity - 1])
            self.cut += least
            stay = self.counts > least
            self.keys, self.counts = self.keys[stay], self.counts[stay] - least

    def at_least(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.cut >= threshold]


def _count_round(k: int, max_words: int, shared, shift: int, parts: int, most: int):
    """Phrases of k words whose two parts of k - 1 words are in the filter, summed by hash."""
    @tidy
    def run(batches):
        bits = shared.value if shared is not None else None
        held, size = [], 0

        def sent():
            keys, counts = _summed(held)
            part = keys % np.uint64(parts)
            by = np.argsort(part, kind="stable")
            have, first = np.unique(part[by], return_index=True)
            spans = list(zip(have.tolist(), first.tolist(), [*first[1:].tolist(), len(by)]))
            rows = [(p, 0, int(counts[by[a:z]].sum()), None, None) for p, a, z in spans]
            rows += [(p, 1, 0, keys[by[a:z]].tobytes(), counts[by[a:z]].astype("<i8").tobytes()) for p, a, z in spans]
            for lo in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo:lo + 256]), _SENT)], ["part", "kind", "mass", "keys", "counts"])

        for batch in batches:
            lang = _lang_hash(batch.column(1).to_pylist())
            for seg in segments(batch.column(0), max_words):
                ok = seg.windows(k)
                if k > 1:
                    part = np.flatnonzero(seg.inside(k - 1))
                    known = np.zeros(max(0, len(seg.h) - k + 2), bool)
                    at = seg.keys(part, k - 1, lang) >> np.uint64(shift)
                    known[part] = bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
                    ok &= known[:-1] & known[1:]
                keys, counts = np.unique(seg.keys(np.flatnonzero(ok), k, lang), return_counts=True)
                held.append((keys, counts))
                size += len(keys)
                if size > most:
                    held = [_summed(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from sent()
                        held, size = [], 0
        if size:
            yield from sent()
    return run


_SENT = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _merge_round(threshold: int, shift: int):
    """One summary a hash partition; its survivors as places in the filter, by slice."""
    @tidy
    def run(batches):
        now, mass, summary, waiting, size = None, 0, None, [], 0

        def survivors():
            summary.merge(waiting)
            at = np.sort(summary.at_least(threshold) >> np.uint64(shift))
            cell = at >> np.uint64(SLICE_BITS)
            have, first = np.unique(cell, return_index=True)
            inner = (at & np.uint64((1 << SLICE_BITS) - 1)).astype("<u4")
            ends = [*first[1:].tolist(), len(at)]
            return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int64)), pa.array([inner[a:z].tobytes() for a, z in zip(first.tolist(), ends)], pa.binary())],
                                              ["slice", "places"])
        for batch in batches:
            for part, kind, m, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if summary is not None:
                        yield survivors()
                    now, mass, summary, waiting, size = part, 0, None, [], 0
                if kind == 0:  # all masses of a partition come before its counters
                    mass += m
                    continue
                if summary is None:
                    summary = MisraGries(mass // threshold + 1)
                waiting.append((np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<i8")))
                size += len(waiting[-1][0])
                if size > max(summary.capacity, 1 << 18):
                    summary.merge(waiting)
                    waiting, size = [], 0
        if summary is not None:
            yield survivors()
    return run


@tidy
def _fill_slices(batches):
    now, bits = None, None

    def full():
        return pa.RecordBatch.from_pydict({"slice": pa.array([now], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1)], pa.binary())})
    for batch in batches:
        for cell, places in zip(*(c.to_pylist() for c in batch.columns)):
            if cell != now:
                if now is not None:
                    yield full()
                now, bits = cell, np.zeros(1 << SLICE_BITS, bool)
            bits[np.frombuffer(places, "<u4")] = True
    if now is not None:
        yield full()


def _survivors(texts: DataFrame, k: int, max_words: int, shared, filter_bits: int, parts: int, threshold: int, held: int) -> np.ndarray | None:
    """The filter of the phrases of k words that may reach the threshold; None if there are none."""
    shift = 64 - filter_bits
    sent = texts.mapInArrow(_count_round(k, max_words, shared, shift, parts, held), "part bigint, kind bigint, mass bigint, keys binary, counts binary")
    tasks = min(parts, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = sent.repartition(tasks, "part").sortWithinPartitions("part", "kind")
    places = sent.mapInArrow(_merge_round(threshold, shift), "slice bigint, places binary")
    slices = places.repartition(min(tasks, 1 << (filter_bits - SLICE_BITS)), "slice").sortWithinPartitions("slice")
    found = slices.mapInArrow(_fill_slices, "slice bigint, bits binary").collect()  # 2 ** filter_bits bits at most
    if not found:
        return None
    out = np.zeros((1 << filter_bits) // 8, np.uint8)
    width = (1 << SLICE_BITS) // 8
    for row in found:
        out[row.slice * width:(row.slice + 1) * width] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return out


_TAB, _SPACE = 9, 32


def _phrases(seg: Segment, at: np.ndarray, k: int) -> pa.Array:
    """The words of the windows that begin at ``at``, joined by single spaces."""
    low = lower_ascii(seg.b)
    lo, hi = seg.begin[at], seg.end[at + k - 1]
    raw = pa.py_buffer(low)
    gaps = np.cumsum(np.concatenate([[0], seg.begin[1:] - seg.end[:-1] - 1 + (low[seg.begin[1:] - 1] == _TAB)])) if len(seg.h) else np.zeros(1, np.int64)
    plain = gaps[at + k - 1] == gaps[at]
    size = hi - lo
    starts = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(raw, np.uint8)[np.repeat(lo - starts[:-1], size) + np.arange(starts[-1])]
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(starts.astype(np.int64).tobytes()), pa.py_buffer(flat)])
    if plain.all():
        return out.cast(pa.binary())
    out = out.to_pylist()
    for i in np.flatnonzero(~plain).tolist():
        out[i] = b" ".join(out[i].replace(b"\t", b" ").split(b" "))
        while b"  " in out[i]:
            out[i] = out[i].replace(b"  ", b" ")
    return pa.array(out, pa.binary())


def _count_exactly(max_words: int, shared, shift: int):
    """lang, k, phrase, n of the phrases in the filter; k = 0: all word occurrences."""
    @tidy
    def run(batches):
        bits = shared.value
        for batch in batches:
            names = batch.column(1).to_pylist()
            lang = _lang_hash(names)
            totals: dict = {}
            for seg in segments(batch.column(0), max_words):
                rows, counts = np.unique(seg.row[seg.fresh:], return_counts=True)
                for r, c in zip(rows.tolist(), counts.tolist()):
                    totals[names[r]] = totals.get(names[r], 0) + c
                known = None
                for k in range(1, max_words + 1):
                    fit = seg.inside(k) if known is None else seg.inside(k) & known[:-1] & known[1:]
                    at = np.flatnonzero(fit)
                    keys = seg.keys(at, k, lang)
                    bit = keys >> np.uint64(shift)
                    on = (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    known = np.zeros(len(fit), bool)
                    known[at[on]] = True
                    on &= at + k - 1 >= seg.fresh
                    at, keys = at[on], keys[on]
                    if not len(at):
                        continue
                    _, first, counts = np.unique(keys, return_index=True, return_counts=True)
                    at = at[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[r] for r in seg.row[at].tolist()], pa.string()), pa.array(np.full(len(at), k, np.int32)),
                         _phrases(seg, at, k), pa.array(counts.astype(np.int64))], ["lang", "k", "phrase", "f"])
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array([0] * len(totals), pa.int32()),
                                              pa.array([b""] * len(totals), pa.binary()), pa.array(list(totals.values()), pa.int64())],
                                             ["lang", "k", "phrase", "f"])
    return run


def phrase_counts(docs: DataFrame, threshold: int = 100, max_words: int = 5, filter_bits: int = 27,
                  text_col="text", lang_col="lang", held: int = HELD) -> DataFrame:
    """lang, k, phrase, f: exact counts of all phrases of 1 to ``max_words`` words with at
    least ``threshold`` occurrences in their lang; k = 0: all word occurrences of the lang."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    most = (texts.agg(F.sum((F.octet_length("text") + 1) / 2)).first()[0] or 0)  # no text has more words than that
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(most / threshold / COUNTERS))
    whole, shared = np.zeros((1 << filter_bits) // 8, np.uint8), None
    for k in range(1, max_words + 1):
        found = _survivors(texts, k, max_words, shared, filter_bits, parts, threshold, held)
        if shared is not None:
            shared.unpersist()
        if found is None:
            break
        whole |= found
        shared = spark.sparkContext.broadcast(found)
    shared = spark.sparkContext.broadcast(whole)
    rows = texts.mapInArrow(_count_exactly(max_words, shared, 64 - filter_bits), "lang string, k int, phrase binary, f bigint")
    counts = rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).filter((F.col("f") >= threshold) | (F.col("k") == 0))
    return cut(counts.withColumn("phrase", F.col("phrase").cast("string")), "phrases")


def collocations(docs: DataFrame, threshold: int = 100, max_words: int = 5, top: int = 2000, filter_bits: int = 27,
                 text_col="text", lang_col="lang", held: int = HELD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's first ``top`` phrases of 2 to
    ``max_words`` words (see the module for words, pieces, and the order of ties)."""
    counts = phrase_counts(docs, threshold, max_words, filter_bits, text_col, lang_col, held)
    words = F.split("phrase", " ", -1)
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    known = counts.filter("k > 0").select("lang", "phrase", "f")
    # a phrase inside a longer one that is as frequent is inside one that is longer by one word and as frequent
    longer = counts.filter("k > 2").select("lang", "f", F.explode(F.array(
        F.array_join(F.slice(words, F.lit(1), F.col("k") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("k") - 1), " "))).alias("phrase"))
    own = counts.filter("k > 1").join(longer, ["lang", "phrase", "f"], "left_anti")
    cuts = own.select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("at")), " ")) \
        .withColumn("rest", F.array_join(F.slice(words, F.col("at") + 1, F.col("k") - F.col("at")), " "))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(total, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * big("a")).cast("decimal(19,0)") * big("n")).withColumn("down", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.col("b.score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "b.l", "b.r", "n", "b.score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of every lang."""
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f
      FROM w, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(i) GROUP BY ALL HAVING count(*) >= 100),
own AS (SELECT * FROM f c WHERE k > 1 AND NOT EXISTS (
          SELECT 1 FROM f d, unnest(range(1, d.k - c.k + 2)) AS u(i)
          WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.f >= 100 * c.f AND d.g[i:i + c.k - 1] = c.g)),
cuts AS (SELECT own.lang, own.k, own.g, own.f AS a, n, x.f AS l, y.f AS r, j,
                CAST(1000::HUGEINT * own.f * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
         FROM own, unnest(range(1, own.k)) AS u(j)
         JOIN f x ON x.lang = own.lang AND x.k = j AND x.g = own.g[1:j]
         JOIN f y ON y.lang = own.lang AND y.k = own.k - j AND y.g = own.g[j + 1:own.k]
         JOIN total ON total.lang = own.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM best)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, CAST(a AS BIGINT) AS a,
       CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score
FROM ranked QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
