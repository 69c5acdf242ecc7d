"""Removal of passages that stand in an earlier document, by a column-wise collection BWT.

Every byte covered by a ``window``-byte string that also starts in a document with a
smaller id is removed; overlaps count and strings are judged on the input.

1. Anchors: the positions of minimal 16-byte hashes in every window (winnowing).  Equal
   windows hold an anchor of equal hash, so only hashes that occur in two documents
   matter.  They are found per chunk of text, then by packed hash buckets in which a
   chunk names a hash once, however often the chunk holds it.
2. The surroundings of shared anchors (all windows that can hold them) are the segments.
   Equal segments are settled where they stand; one of each goes on, dealt by anchor
   hash.  Anchors of over ``hot_docs`` documents are cut into single windows first, so
   no group grows with the corpus.
3. Segments of a group form collections.  Their BWT and common prefixes are built column
   by column: each round inserts the suffix that is one symbol longer of every segment.
   Collections above ``spool_rows`` suffixes keep the arrays in files that are read and
   written in order.  Suffixes whose common prefix reaches the window are equal windows.

Defined results: null text is empty; texts shorter than the window lose nothing; rows
with a null id lose nothing and remove nothing; rows of one id are the same document
(none removes from the other); an empty table gives no rows.  Ids are integers.
Input columns other than id and text are ignored, and kept by ``stage``.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import buffers, cut, groups_of, mix64, sheltered, table, tidy

GRAM = 16
#: anchors of one chunk, segments of one collection
CHUNK_ANCHORS, COLLECTION = 1 << 20, 10_000
#: bytes of text that one step of the winnowing works on, in a dozen arrays of 64-bit hashes
ANCHOR_BYTES = 1 << 18
_ROW = "key bigint, kind int, chunk bigint, data binary"


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes at every position that has them."""
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = b.astype(np.uint64)
    x = x[:-1] | x[1:] << np.uint64(8)
    x = x[:-2] | x[2:] << np.uint64(16)
    x = x[:-4] | x[4:] << np.uint64(32)
    return mix64(x[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(x[8:8 + n]))


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    done = 1
    while done < w:
        step = min(done, w - done)
        x = op(x[:-step], x[step:])
        done += step
    return x


def anchors(b: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``b``, hash): every window of a row holds an anchor with the smallest hash of its grams."""
    w = window - GRAM + 1
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    pos, val = [], []
    for at in range(0, len(b), ANCHOR_BYTES):
        piece = b[at:at + ANCHOR_BYTES + window - 1]
        h = gram_hashes(piece)
        if len(h) < w:
            break
        ends = offsets[(offsets > at) & (offsets < at + len(piece))] - at
        for k in range(1, GRAM):  # grams that leave their row
            p = ends - k
            h[p[(p >= 0) & (p < len(h))]] = none
        low = _slide(h, w, np.minimum)
        pad = np.zeros(w - 1, np.uint64)
        top = _slide(np.concatenate([pad, low, pad]), w, np.maximum)
        p = np.flatnonzero((top == h) & (h != none))
        pos.append(p + at)
        val.append(h[p])
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, first = np.unique(np.concatenate(pos), return_index=True)
    h = np.concatenate(val)[first]
    # runs of equal minima (periodic text): one anchor in every w positions is enough
    tied = np.flatnonzero((h[1:] == h[:-1]) & (p[1:] - p[:-1] < w))
    if len(tied):
        keep = np.ones(len(p), bool)
        for lo, hi in _stretches(tied):
            k, end = lo, hi + 1  # anchors lo .. end are tied
            keep[lo + 1:end + 1] = False
            while k < end:
                k = min(end, max(k + 1, int(np.searchsorted(p[:end + 1], p[k] + w, side="right")) - 1))
                keep[k] = True
        p, h = p[keep], h[keep]
    return p, h


def _stretches(idx: np.ndarray) -> list[tuple[int, int]]:
    """First and last of the runs of consecutive numbers."""
    edge = np.flatnonzero(np.diff(idx) != 1)
    return list(zip(idx[np.concatenate([[0], edge + 1])].tolist(), idx[np.concatenate([edge, [len(idx) - 1]])].tolist()))


_ENTRY = np.dtype([("h", "<u8"), ("doc", "<u4"), ("pos", "<u4"), ("docs", "<u4")])


def _planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that the shuffle compresses the empty ones."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    n = len(data) // _ENTRY.itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(_ENTRY.itemsize, n).T).view(_ENTRY).reshape(n)


def _chunk_rows(chunk: int, keys: list, parts: list, n_buckets: int):
    """Rows of one chunk.  A hash of several documents is settled here and named once;
    a hash of one document is sent with its places, and answered if others have it too.
    ``parts``: row, position and hash of every anchor; emptied, as they are sorted here."""
    order = np.argsort(parts[2], kind="stable")
    h, pos, doc = (parts.pop()[order] for _ in range(3))
    del order
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(h))
    docs = np.where(doc[start] != doc[end - 1], end - start, 1).astype(np.uint32)  # documents are in order inside a hash
    per = np.repeat(docs, end - start)
    del docs, end
    local = np.zeros(int((per > 1).sum()), _ENTRY)
    for name, x in (("h", h), ("doc", doc), ("pos", pos)):
        local[name] = x[per > 1]
    first = np.zeros(len(h), bool)
    first[start] = True
    sent = first | (per == 1)
    e = np.zeros(int(sent.sum()), _ENTRY)
    for name, x in (("h", h), ("doc", doc), ("pos", pos), ("docs", per)):
        e[name] = x[sent]
    del h, doc, pos, per, first, sent, start, x
    bucket = (e["h"] >> np.uint64(40)) % np.uint64(n_buckets)
    # forty bits and the bucket are enough to find shared hashes; what they let in too much is judged on bytes later
    e["h"] &= np.uint64((1 << 40) - 1)
    order = np.argsort(bucket, kind="stable")
    bucket, e = bucket[order], e[order]
    del order
    edge = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
    rows = [(int(k), 0, chunk, _planes(e[a:z])) for k, (a, z) in enumerate(zip(edge[:-1], edge[1:])) if z > a]
    del bucket, e
    local["docs"] = ((local["h"] >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.uint32)
    local["h"] &= np.uint64((1 << 40) - 1)
    rows.append((-1 - chunk, 1, chunk, np.array(keys, np.int64).tobytes()))
    if len(local):
        rows.append((-1 - chunk, 2, chunk, _planes(local)))
    return rows


def _batch(rows: list) -> pa.RecordBatch:
    c = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64()),
                                       pa.array(c[3], pa.binary())], ["key", "kind", "chunk", "data"])


def _find_anchors(window: int, n_buckets: int):
    @tidy
    def run(batches):
        part, flushed = TaskContext.get().partitionId(), 0
        keys, doc, pos, val, held = [], [], [], [], 0

        def flush():
            parts = [np.concatenate(x) for x in (doc, pos, val)]
            for x in (doc, pos, val):
                x.clear()
            return _batch(_chunk_rows((part << 24) + flushed, keys, parts, n_buckets))

        for batch in batches:
            b, off = buffers(batch.column(1))
            row_keys = batch.column(0).to_pylist()
            lo = 0
            while lo < len(row_keys):  # rows of about one chunk
                hi = min(len(row_keys), max(lo + 1, int(np.searchsorted(off, off[lo] + (CHUNK_ANCHORS << 3), side="right")) - 1))
                p, h = anchors(b[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], window)
                r = np.searchsorted(off[lo:hi + 1] - off[lo], p, side="right") - 1
                doc.append((r + len(keys)).astype(np.uint32))
                pos.append((p - (off[lo + r] - off[lo])).astype(np.uint32))
                val.append(h)
                keys.extend(row_keys[lo:hi])
                held += len(p)
                lo = hi
                if held >= CHUNK_ANCHORS:
                    yield flush()
                    flushed += 1
                    keys, doc, pos, val, held = [], [], [], [], 0
        if keys:
            yield flush()
    return run


def _match_buckets(hot_docs: int, n_buckets: int):
    """Answer every chunk: places whose hash another document has, and hashes of very many documents."""
    @tidy
    def run(batches):
        for key, rows in groups_of(batches):
            if key < 0:
                yield _batch(rows)
                continue
            part = [_unplanes(r[3]) for r in rows]
            chunk = np.repeat(np.array([r[2] for r in rows], np.int64), [len(x) for x in part])
            e = np.concatenate(part)
            order = np.argsort(e["h"], kind="stable")
            e, chunk = e[order], chunk[order]
            start = np.flatnonzero(np.concatenate([[True], e["h"][1:] != e["h"][:-1]]))
            size = np.diff(np.append(start, len(e)))
            same = np.concatenate([[False], (e["h"][1:] == e["h"][:-1]) & (e["doc"][1:] == e["doc"][:-1]) & (chunk[1:] == chunk[:-1])])
            total = np.add.reduceat(np.where(same, 0, e["docs"]).astype(np.int64), start)
            shared, hot = np.repeat(total > 1, size), np.repeat(total > hot_docs, size)
            places = shared & (e["docs"] == 1)
            named = hot & (e["docs"] > 1)
            out = []
            for kind, on in ((3, places), (4, named)):
                a, c = e[on].copy(), chunk[on]
                a["docs"] = hot[on] if kind == 3 else key
                by = np.argsort(c, kind="stable")
                a, c = a[by], c[by]
                edge = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else []
                if kind == 3:
                    a["h"] = 0
                out += [(-1 - int(c[x]), kind, int(c[x]), _planes(a[x:y])) for x, y in zip(edge, [*edge[1:], len(c)])]
            yield _batch(out)
    return run


@tidy
def _places(batches):
    """Per document: places of its shared anchors, the hot ones with the top bit set."""
    for _, rows in groups_of(batches):
        keys = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows if r[1] == 1])
        got = {k: [_unplanes(r[3]) for r in rows if r[1] == k] for k in (2, 3, 4)}
        local = np.concatenate([np.zeros(0, _ENTRY), *got[2]])
        hot = np.concatenate([np.zeros(0, _ENTRY), *got[4]])
        named = lambda x: x["h"] ^ (x["docs"].astype(np.uint64) << np.uint64(40))
        local["docs"] = np.isin(named(local), named(hot))
        all_ = np.concatenate([local, *got[3]])
        all_ = all_[np.lexsort((all_["pos"], all_["doc"]))]
        code = all_["pos"] | (all_["docs"].astype(np.uint32) << np.uint32(31))
        edge = np.searchsorted(all_["doc"], np.arange(len(keys) + 1))
        on = np.flatnonzero(np.diff(edge))
        yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array([code[edge[k]:edge[k + 1]].tobytes() for k in on], pa.binary())],
                                         ["key", "places"])


def merge(spans: np.ndarray) -> np.ndarray:
    """Union of (begin, end) rows, touching ones joined."""
    if not len(spans):
        return spans.reshape(0, 2)
    s = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(s[:, 1])
    new = np.concatenate([[True], s[1:, 0] > end[:-1]])
    at = np.flatnonzero(new)
    return np.stack([s[at, 0], end[np.append(at[1:], len(s)) - 1]], axis=1)


def merged(key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each key."""
    if not len(key):
        return key, begin, end
    by = np.lexsort((begin, key))
    key, begin, end = key[by], begin[by], end[by]
    start = np.concatenate([[True], key[1:] != key[:-1]])
    lift = np.cumsum(start) * (int(end.max()) + 2)  # keys apart, so that one pass joins all of them
    spans = merge(np.stack([begin + lift, end + lift], axis=1))
    at = np.searchsorted(begin + lift, spans[:, 0])
    return key[at], spans[:, 0] - lift[at], spans[:, 1] - lift[at]


#: at: place of the anchor in the segment; rows without a segment are spans of ``at`` bytes
_SEG = "g bigint, seg binary, doc bigint, key bigint, pos bigint, at int"


def _owned(pos: np.ndarray, h: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the windows in which no other anchor has a smaller hash.

    ``pos``: ascending, with gaps wider than a window between rows; ``end``: end of the row.
    """
    w = window - GRAM + 1
    first, last = pos - w + 1, np.minimum(pos, end - window)
    for k in range(1, w):
        near = np.flatnonzero(pos[k:] - pos[:-k] < w)
        if not len(near):
            break
        a, z = near, near + k
        over = h[a] < h[z]
        first[z[over]] = np.maximum(first[z[over]], pos[a[over]] + 1)
        over = h[z] < h[a]
        last[a[over]] = np.minimum(last[a[over]], pos[z[over]] - w)
    return first, last


def _segments(window: int, flush_rows: int = 200_000):
    """Segments of shared anchors: all windows that an anchor owns.  Of equal segments
    in one flush only those of the smallest document go on; the others are wholly
    covered (merged spans, as rows without a segment)."""
    def settle(names: dict, cols: list):
        sid, doc, key, pos, at = (np.array(c, np.int64) for c in cols)
        segs = list(names)
        size = np.array([len(x[1]) for x in segs], np.int64)
        least = np.full(len(segs), np.iinfo(np.int64).max)
        np.minimum.at(least, sid, doc)
        go = doc == least[sid]
        key_, begin, end = merged(key[~go], pos[~go], pos[~go] + size[sid[~go]])
        live, n = sid[go].tolist(), len(key_)
        none = np.zeros(n, np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([segs[k][0] for k in live] + key_.tolist(), pa.int64()), pa.array([segs[k][1] for k in live] + [None] * n, pa.binary()),
             *(pa.array(np.concatenate(x)) for x in ((doc[go], none), (key[go], key_), (pos[go], begin))),
             pa.array(np.concatenate([at[go], end - begin]).astype(np.int32))], ["g", "seg", "doc", "key", "pos", "at"])

    @tidy
    def run(batches):
        names: dict = {}
        cols: list = [[], [], [], [], []]

        def add(name, doc, key, pos, at):
            for c, v in zip(cols, (names.setdefault(name, len(names)), doc, key, pos, at)):
                c.append(v)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bodies = _unpacked(part.column(0))
                docs, keys = part.column(1).to_pylist(), part.column(2).to_pylist()
                code = [np.frombuffer(x, np.uint32) for x in part.column(3).to_pylist()]
                row = np.repeat(np.arange(len(code)), [len(x) for x in code])
                code = np.concatenate(code)
                size = np.array([len(x) for x in bodies])
                pos = (code & np.uint32(0x7FFFFFFF)).astype(np.int64)
                ok = pos + GRAM <= size[row]
                row, pos, hot = row[ok], pos[ok], (code >> np.uint32(31))[ok]
                start = np.concatenate([[0], np.cumsum(size)])[:-1]
                b = np.frombuffer(b"".join(bodies), np.uint8)
                x = b[(start[row] + pos)[:, None] + np.arange(GRAM)].view(np.uint64).reshape(-1, 2)
                h = mix64(x[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ mix64(x[:, 1]))
                wide = start + np.arange(len(size)) * 2 * window  # rows apart, so that none is near another
                first, last = _owned(wide[row] + pos, h, (wide + size)[row], window)
                first, last = np.maximum(first - wide[row], 0), last - wide[row]
                on = first <= last
                for r, g, a, z, p, many in zip(row[on].tolist(), h[on].view(np.int64).tolist(), first[on].tolist(),
                                               (last[on] + window).tolist(), pos[on].tolist(), hot[on].tolist()):
                    if not many:
                        add((g, bodies[r][a:z]), docs[r], keys[r], a, p - a)
                        continue
                    for k in range(a, z - window + 1):
                        one = bodies[r][k:k + window]
                        name = int.from_bytes(hashlib.blake2b(one, digest_size=8).digest(), "little", signed=True)
                        add((name, one), docs[r], keys[r], k, p - k)
                if len(cols[0]) >= flush_rows:
                    yield settle(names, cols)
                    names.clear()
                    for c in cols:
                        c.clear()
        if cols[0]:
            yield settle(names, cols)
    return run


@tidy
def _packed(batches):
    """First column (text) as zstd frames, null as null: texts travel compressed."""
    from zstandard import ZstdCompressor

    z = ZstdCompressor(level=3)
    for batch in batches:
        data = [z.compress(x.as_buffer()) if x.is_valid else None for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), *batch.columns[1:]], batch.schema.names)


def _unpacked(col) -> list:
    from zstandard import ZstdDecompressor

    z = ZstdDecompressor()
    return [z.decompress(x.as_buffer()) if x.is_valid else None for x in col]


class Collection:
    """BWT and common prefixes of a growing collection of strings."""

    def __init__(self, strings: list[bytes], spool_rows: int):
        m = len(strings)
        size = np.array([len(s) for s in strings], np.int64)
        self.longest = int(size.max())
        flat = np.frombuffer(b"".join(strings), np.uint8)
        used = np.unique(flat)
        code = np.zeros(256, np.uint16)
        code[used] = np.arange(1, len(used) + 1)
        kind = np.uint8 if len(used) < 256 else np.uint16
        # column j holds the symbol that stands j places before the end; 0 where there is none
        self.columns = np.zeros((self.longest + 1, m), kind)
        row = np.repeat(np.arange(m), size)
        back = np.repeat(np.cumsum(size), size) - 1 - np.arange(len(flat))
        self.columns[back, row] = code[flat]
        self.m, self.spool_rows, self.folder = m, spool_rows, None
        # the empty suffixes, in the order of the strings
        self.bwt, self.lcp = self.columns[0].copy(), np.zeros(m, np.uint8 if self.longest < 255 else np.uint32)
        self.at = np.arange(m)  # place of the longest suffix so far of each string
        self.size = size

    def _new(self, n: int, kind) -> np.ndarray:
        """Room for a column's result: in memory, or in a file that is filled in order."""
        if n <= self.spool_rows:
            return np.empty(n, kind)
        if self.folder is None:
            self.folder = tempfile.TemporaryDirectory()
        f = tempfile.TemporaryFile(dir=self.folder.name)
        return np.memmap(f, kind, "w+", shape=n)

    def insert_column(self, j: int) -> None:
        """Insert the suffixes of length ``j``: one symbol before those of length j - 1."""
        symbol = self.columns[j - 1]
        act = np.flatnonzero(symbol)
        order = np.argsort(self.bwt, kind="stable")
        count = np.bincount(self.bwt, minlength=int(symbol.max()) + 1)
        start = np.concatenate([[0], np.cumsum(count)])
        r = self.at[act]
        q = np.empty(len(act), np.int64)
        by = np.argsort(symbol[act], kind="stable")
        cuts = np.searchsorted(symbol[act][by], np.arange(1, len(count) + 1))
        for c in range(1, len(count)):  # place of each new suffix among those with its first symbol
            mine = by[cuts[c - 1]:cuts[c]]
            if len(mine):
                q[mine] = start[c] + np.searchsorted(order[start[c]:start[c + 1]], r[mine])
        x = symbol[act]
        to = self.m + q - count[0]
        before, after = q > start[x], q + 1 < start[x.astype(np.int64) + 1]
        lcp = np.append(self.lcp, self.lcp[:1])

        def least(lo, hi):
            """Smallest common prefix in lo .. hi; from the right, so that reduceat skips what lies between."""
            by = np.argsort(-lo)
            out = np.empty(len(lo), lcp.dtype)
            if len(lo):
                out[by] = np.minimum.reduceat(lcp, np.stack([lo[by], hi[by] + 1], axis=1).ravel())[::2]
            return out

        own = np.zeros(len(act), lcp.dtype)
        own[before] = 1 + least(order[q[before] - 1] + 1, r[before])
        behind = 1 + least(r[after] + 1, order[q[after] + 1])
        old, n = np.ones(len(self.bwt) + len(act), bool), len(self.bwt) + len(act)
        old[to] = False
        for field, new in (("bwt", self.columns[j][act]), ("lcp", own)):
            have = getattr(self, field)
            out = self._new(n, have.dtype)
            out[old] = have
            out[to] = new
            setattr(self, field, out)
        self.lcp[to[after] + 1] = behind
        self.at[act] = to

    def equal_windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, length of suffix, class) of the suffixes that hold a window; equal windows share a class."""
        for j in range(1, self.longest + 1):
            self.insert_column(j)
        cls = np.cumsum(np.asarray(self.lcp) < window, dtype=np.int32 if len(self.lcp) < 1 << 31 else np.int64)
        # from each empty suffix, step by step to the suffix that is one symbol longer
        order = np.argsort(self.bwt, kind="stable")
        longer = np.empty(len(order), np.int64)
        longer[order] = np.arange(len(order)) + self.m - int((self.bwt == 0).sum())
        at, out = np.arange(self.m), []
        for j in range(1, self.longest + 1):
            on = np.flatnonzero(self.size >= j)
            at[on] = longer[at[on]]
            if j >= window:
                out.append((on.astype(np.int32), np.full(len(on), j, np.int32), cls[at[on]]))
        self.bwt = self.lcp = None
        if self.folder is not None:
            self.folder.cleanup()
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def covered(strings: list[bytes], docs: np.ndarray, window: int, spool_rows: int) -> list[np.ndarray]:
    """Per string: spans of its windows that also stand in a string of a smaller document."""
    name, size, cls = Collection(strings, spool_rows).equal_windows(window)
    if not len(name):
        return [np.zeros((0, 2), np.int64)] * len(strings)
    smallest = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, cls, docs[name])
    least = smallest[cls]
    on = least < docs[name]
    name, begin = name[on], np.array([len(s) for s in strings])[name[on]] - size[on]
    by = np.lexsort((begin, name))
    name, begin = name[by], begin[by]
    cuts = np.searchsorted(name, np.arange(len(strings) + 1))
    return [merge(np.stack([begin[a:z], begin[a:z] + window], axis=1)) for a, z in zip(cuts[:-1], cuts[1:])]


def _may_share(g: np.ndarray, strings: list[bytes], at: np.ndarray, window: int) -> np.ndarray:
    """Segments of which another one of the group has the same bytes before or behind the
    anchor, as many as every common window must hold on one side.  Where the anchor's gram
    stands twice in a segment, texts may have kept different anchors of a run (see
    ``anchors``) and so of one window: two such segments of a group always may share."""
    side = -(-(window - GRAM) // 2)
    out = np.zeros(len(strings), bool)
    for pick in (lambda s, p: s[p - side:p] if p >= side else None, lambda s, p: s[p + GRAM:p + GRAM + side] if len(s) - p - GRAM >= side else None):
        seen: dict = {}
        name = np.array([-1 if (x := pick(s, p)) is None else seen.setdefault((k, x), len(seen))
                         for k, s, p in zip(g.tolist(), strings, at.tolist())], np.int64)
        many = np.bincount(name[name >= 0], minlength=len(seen)) > 1
        out[name >= 0] |= many[name[name >= 0]]
    twice = np.flatnonzero([s.find(s[p:p + GRAM]) != p or s.find(s[p:p + GRAM], p + 1) >= 0 for s, p in zip(strings, at.tolist())])
    _, group, size = np.unique(g[twice], return_inverse=True, return_counts=True)
    out[twice[size[group] > 1]] = True
    return out


def _collections(window: int, spool_rows: int):
    def solve(g, seg, doc, key, pos, at):
        """Spans of rows whose groups are whole."""
        names: dict = {}
        sid = np.array([names.setdefault(x, len(names)) for x in zip(g.tolist(), seg)], np.int64)
        strings = [x[1] for x in names]
        first = np.unique(sid, return_index=True)[1]
        size = np.array([len(x) for x in strings], np.int64)
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, sid, doc)
        # a row of a single window stands for itself; its anchor may lie anywhere
        ask = np.flatnonzero(_may_share(g[first], strings, at[first], window))
        spans: list = [None] * len(strings)
        for k, s in zip(ask.tolist(), covered([strings[k] for k in ask], least[ask], window, spool_rows) if len(ask) else ()):
            spans[k] = s
        whole = doc > least[sid]
        out = [(key[whole], pos[whole], pos[whole] + size[sid[whole]])]
        some = [k for k in np.flatnonzero(~whole).tolist() if spans[sid[k]] is not None and len(spans[sid[k]])]
        if some:
            n = [len(spans[sid[k]]) for k in some]
            s = np.concatenate([spans[sid[k]] for k in some]) + np.repeat(pos[some], n)[:, None]
            out.append((np.repeat(key[some], n), s[:, 0], s[:, 1]))
        return batch(*merged(*(np.concatenate(x) for x in zip(*out))))

    def batch(key, begin, end):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, begin, end)], ["key", "begin", "end"])

    @tidy
    def run(batches):
        held: list = []

        def take():
            num = [np.concatenate([h[k] for h in held]) for k in range(5)]
            return solve(num[0], [x for h in held for x in h[5]], *num[1:])

        n = 0
        for b in batches:
            g, doc, key, pos, at = (np.array(b.column(k)) for k in (0, 2, 3, 4, 5))
            seg = b.column(1)
            bare = np.array(seg.is_null())
            if bare.any():
                yield batch(key[bare], pos[bare], pos[bare] + at[bare])
            live = np.flatnonzero(~bare)
            if not len(live):
                continue
            rows = [x[live] for x in (g, doc, key, pos, at)] + [seg.take(pa.array(live)).to_pylist()]
            edge = np.flatnonzero(np.diff(rows[0])) + 1
            if held and held[-1][0][-1] != rows[0][0]:
                edge = np.concatenate([[0], edge])
            if n + len(live) >= 3 * COLLECTION and len(edge):  # up to the last whole group
                held.append([x[:edge[-1]] for x in rows])
                yield take()
                held, n = [], 0
                rows = [x[edge[-1]:] for x in rows]
            held.append(rows)
            n += len(rows[5])
        if held:
            yield take()
    return run


def _finish(window: int, with_text: bool):
    empty = hashlib.sha256(b"").hexdigest()

    @tidy
    def run(batches):
        for batch in batches:
            c = batch.column
            n_bytes, n_removed, n_spans, sha, kept = [], [], [], [], []
            for text, copy, spans in zip(_unpacked(c(1)), c(2).to_pylist(), c(3).to_pylist()):
                raw = text or b""
                n_bytes.append(len(raw))
                if copy and len(raw) >= window:
                    s = np.array([[0, len(raw)]], np.int64)
                else:
                    s = merge(np.array([(x["begin"], x["end"]) for x in spans or ()], np.int64).reshape(-1, 2))
                left = raw
                if len(s):
                    edge = [0, *s.ravel().tolist(), len(raw)]
                    left = b"".join(raw[a:z] for a, z in zip(edge[::2], edge[1::2]))
                n_removed.append(len(raw) - len(left))
                n_spans.append(len(s))
                sha.append(hashlib.sha256(left).hexdigest() if left else empty)
                kept.append(left.decode("utf-8", "ignore") if with_text and text is not None else None)
            yield pa.RecordBatch.from_arrays(
                [c(0), *batch.columns[4:], pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                [batch.schema.names[0], *batch.schema.names[4:], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def repeated_passages(docs: DataFrame, window: int = 50, hot_docs: int = 1 << 17, spool_rows: int = 1 << 24,
                      id_col="doc_id", text_col="text", keep: tuple = (), with_text: bool = False) -> DataFrame:
    """id, ``keep`` columns, n_bytes, n_removed, n_spans, kept_sha256 and, with
    ``with_text``, kept (the remaining text, without the rest of a character that a span
    cuts) of every document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    extra = [c for c in keep if c not in (id_col, text_col)]
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *extra)
    src = src.withColumn("_key", F.xxhash64("_id", F.xxhash64("_text")))
    usable = src.filter(F.col("_id").isNotNull() & (F.octet_length("_text") >= window))
    # exact copies: only the smallest id of a text is compared, the others lose everything
    ids = usable.select("_key", F.col("_id").cast("bigint").alias("doc"), F.unhex(F.md5("_text")).alias("digest"))
    first = ids.groupBy("digest").agg(F.min("doc").alias("first"))
    ids = ids.join(first, "digest").groupBy("_key", (F.col("doc") > F.col("first")).alias("copy")).agg(F.count(F.lit(1)).alias("rows"))
    ids = cut(ids, "copies")
    if not ids.filter("rows > 1 AND NOT copy").isEmpty():  # rows that repeat id and text are compared once
        usable = cut(usable.dropDuplicates(["_key"]), "usable")
    ids = ids.drop("rows")

    deal = lambda df: df.repartition(parts, "key").sortWithinPartitions("key")
    found = usable.select("_key", "_text").mapInArrow(_find_anchors(window, 4 * parts), _ROW)
    answers = deal(found).mapInArrow(_match_buckets(hot_docs, 4 * parts), _ROW)
    places = deal(answers).mapInArrow(_places, "key bigint, places binary")
    places = cut(places.join(ids.filter(~F.col("copy")), F.col("key") == F.col("_key"), "left_semi"), "places")

    segs = (usable.select("_text", F.col("_id").cast("bigint").alias("doc"), "_key")
            .mapInArrow(_packed, "_text binary, doc bigint, _key bigint")
            .join(places.hint("merge"), F.col("_key") == F.col("key")).select("_text", "doc", "key", "places")
            .mapInArrow(_segments(window), _SEG))
    segs = segs.repartition(parts, "g").sortWithinPartitions("g")
    spans = segs.mapInArrow(_collections(window, spool_rows), "key bigint, begin bigint, end bigint")
    spans = spans.groupBy("key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    info = ids.join(spans, F.col("_key") == F.col("key"), "left").filter("copy OR spans IS NOT NULL").select("_key", "copy", "spans")
    info = cut(info, "spans")
    kinds = dict(src.dtypes)
    cols = ["_text", "_id", "_key", *extra]
    out = src.select(*cols).mapInArrow(_packed, ", ".join(f"`{c}` {'binary' if c == '_text' else kinds[c]}" for c in cols))
    out = out.join(info.hint("merge"), "_key", "left").select("_id", "_text", "copy", "spans", *extra)
    head = [f"`{c}` {kinds[c]}" for c in ("_id", *extra)]
    out = out.mapInArrow(_finish(window, with_text), ", ".join(
        [*head, "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string", "kept string"]))
    return out.withColumnRenamed("_id", id_col)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that stand in a passage of an earlier one."""
    out = repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@sheltered
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages leave the texts; a text that loses all its
    bytes goes.  A character cut by a span goes with it, n_chars follows the text."""
    cols = docs.columns
    out = repeated_passages(docs, keep=tuple(cols), with_text=True)
    gone = (F.col("n_removed") > 0) & (F.col("n_removed") == F.col("n_bytes"))
    out = out.filter(~gone).withColumnRenamed("kept", "text")
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*cols)
