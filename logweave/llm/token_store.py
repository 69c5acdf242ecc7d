"""Token ids in binary files whose document boundaries are Elias-Fano encoded.

A shard file holds the concatenated ids of consecutive documents (little-endian,
16 or 32 bits each), then two Elias-Fano sequences, the end of every document and
the document ids, and a footer of fixed size that says where each section lies.
An Elias-Fano sequence keeps the low bits of its values packed and the high bits
in unary; the bit position of every ``STEP``-th one is sampled in 32 bits, so
``select`` reads one sample and at most a few hundred bits behind it.  No table of
64-bit offsets exists, in the file or in memory.

Documents are range-sorted by (id, hash of text, row); each task writes its range
as one or more shards under names of its own, and the manifest lists the shards of
the attempts that Spark committed, so a lost task leaves at most an unlisted file.
Places in the whole corpus are a running sum over the manifest, one row per shard.
The folder must be shared and reachable by ``pyarrow.fs`` (file, hdfs, s3, gs).

Defined results: a null text is empty and holds the end id alone; null ids come
first; rows that share an id are documents of their own, in an order that does not
depend on partitions for different texts and does not matter for equal ones; an
empty table gives an empty manifest and no documents.  Input columns other than id
and text are ignored.  The id column must be integral.
"""

from __future__ import annotations

import math
import re
import struct
import uuid
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import table, tidy
from logweave.llm.token_counts import tokenizer
from logweave.session import checkpoint_dir

#: every STEP-th one of the high bits has its position sampled
STEP = 256
#: a shard ends with the document that reaches this many ids; places inside a shard fit 32 bits
SHARD_IDS = 1 << 27
#: documents that one read task row covers
READ_DOCS = 1 << 14
#: distinct stretches that each of the two parts of a worker's memo holds
MEMO_WORDS = 600_000
_ENCODERS: dict = {}
#: a token of a byte-level BPE with a word pattern never crosses from a visible character to a blank behind it
_CUT = re.compile(r"(?<=[\w!-~]) (?![\n\x01])")
#: a blank or line break that is no such cut, or the mark of stretches without a blank
_UNSAFE = re.compile(r" (?<![\w!-~] )|\n(?<![\w!-~]\n)|\n(?![\w!-~])| (?=\n)|\x01")
#: a stretch that may stand on a line with others
_PLAIN = re.compile(r"[\n\x01]?[\w!-~](?:[^\n]*[\w!-~])?").fullmatch
#: a mark behind a letter or digit and before a blank is a token of its own
_MARKS, _AS_IS = ".,;:!?", "\x01"
#: a mark before a blank that stands behind something else
_RUN = re.compile(r"[.,;:!?] (?<![0-9A-Za-zÀ-ÖØ-öø-ɏ][.,;:!?] )")
_MAGIC = b"EFIDS001"
_FOOTER = struct.Struct("<8sIIQQQq" + 2 * "QBQQQ")


class EliasFano:
    """Non-decreasing values below ``universe``: packed low bits, unary high bits, sampled select."""

    def __init__(self, n: int, bits: int, low, high, samples):
        self.n, self.bits, self.low, self.high, self.samples = n, bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        v, n = np.asarray(values, np.uint64), len(values)
        bits = max(0, int(math.log2(universe // n))) if n and universe > n else 0
        low = np.zeros((n * bits + 7) // 8, np.uint8)
        for at in range(0, n, 1 << 16):  # 65,536 values fill whole bytes at any width
            part = v[at:at + (1 << 16), None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)
            packed = np.packbits(part.astype(np.uint8).ravel(), bitorder="little")
            low[at * bits // 8:at * bits // 8 + len(packed)] = packed
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) + 8) // 8 if n else 0, np.uint8)
        np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
        return cls(n, bits, low, high, ones[::STEP].astype(np.uint32))

    def slice(self, i: int, j: int) -> np.ndarray:
        """Values i .. j - 1; select finds where their high bits begin."""
        if i >= j:
            return np.zeros(0, np.uint64)
        first, last = i // STEP, (j - 1) // STEP + 1
        begin = int(self.samples[first:first + 1][0])
        behind = self.samples[last:last + 1]
        end = int(behind[0]) if len(behind) else len(self.high) * 8
        raw = np.unpackbits(self.high[begin // 8:(end + 7) // 8], bitorder="little")
        ones = np.flatnonzero(raw[begin % 8:]) + begin
        ones = ones[i - first * STEP:j - first * STEP]
        upper = (ones - np.arange(i, j)).astype(np.uint64)
        if not self.bits:
            return upper
        a, b = i * self.bits, j * self.bits
        raw = np.unpackbits(self.low[a // 8:(b + 7) // 8], bitorder="little")[a % 8:a % 8 + b - a]
        weight = np.uint64(1) << np.arange(self.bits, dtype=np.uint64)
        return (upper << np.uint64(self.bits)) | raw.reshape(-1, self.bits).astype(np.uint64) @ weight

    def select(self, i: int) -> int:
        """Value i."""
        return int(self.slice(i, i + 1)[0])


class _Section:
    """Bytes of an open file as an array that is read where it is sliced."""

    def __init__(self, f, at: int, n: int, kind):
        self.f, self.at, self.n, self.kind = f, at, n, np.dtype(kind)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, s: slice) -> np.ndarray:
        lo, hi, _ = s.indices(self.n)
        size = self.kind.itemsize
        self.f.seek(self.at + lo * size)
        return np.frombuffer(self.f.read(max(0, hi - lo) * size), self.kind)


class ShardWriter:
    """One shard: ids are streamed to the file, boundaries follow when it is closed."""

    def __init__(self, out, width: int):
        self.out, self.kind = out, np.dtype("<u2" if width == 2 else "<u4")
        self.sizes, self.keys, self.n_ids, self.nulls = [], [], 0, 0

    def add(self, key, ids: bytes) -> None:
        """The next document; ``ids`` in the width of the shard."""
        if key is None:
            self.nulls += 1
        else:
            self.keys.append(key)
        self.sizes.append(len(ids) // self.kind.itemsize)
        self.n_ids += self.sizes[-1]
        self.out.write(ids)

    def close(self) -> tuple[int, int]:
        """(documents, ids) of the finished file."""
        base = self.keys[0] if self.keys else 0
        keys = np.array([k - base for k in self.keys], np.uint64)
        at, places = self.n_ids * self.kind.itemsize, []
        for values, most in ((np.cumsum(np.array(self.sizes, np.uint64)), self.n_ids), (keys, int(keys[-1]) if len(keys) else 0)):
            ef = EliasFano.encode(values, most + 1)
            for part in (ef.low, ef.high, ef.samples.astype("<u4")):
                self.out.write(part.tobytes())
            places += [at, ef.bits, len(ef.low), len(ef.high), len(ef.samples)]
            at += len(ef.low) + len(ef.high) + 4 * len(ef.samples)
        self.out.write(_FOOTER.pack(_MAGIC, self.kind.itemsize, 0, len(self.sizes), self.n_ids, self.nulls, base, *places))
        self.out.close()
        return len(self.sizes), self.n_ids


class Shard:
    """A shard file open for reading; only the parts asked for are read."""

    def __init__(self, f):
        f.seek(0, 2)
        f.seek(f.tell() - _FOOTER.size)
        magic, width, _, self.n, self.n_ids, self.nulls, self.base, *places = _FOOTER.unpack(f.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError("not a shard of token ids")
        self.ids = _Section(f, 0, self.n_ids, "<u2" if width == 2 else "<u4")
        self.ends, self.keys = (self._sequence(f, n, *p) for n, p in ((self.n, places[:5]), (self.n - self.nulls, places[5:])))

    @staticmethod
    def _sequence(f, n, at, bits, low, high, samples) -> EliasFano:
        return EliasFano(n, bits, _Section(f, at, low, np.uint8), _Section(f, at + low, high, np.uint8),
                         _Section(f, at + low + high, samples, "<u4"))

    def offsets(self, i: int, j: int) -> np.ndarray:
        """Begins of the documents i .. j - 1 and the end of the last."""
        begin = self.ends.select(i - 1) if i else 0
        return np.concatenate([[begin], self.ends.slice(i, j).astype(np.int64)])

    def document_ids(self, i: int, j: int) -> list:
        lo, hi = max(i, self.nulls), max(j, self.nulls)
        keys = self.keys.slice(lo - self.nulls, hi - self.nulls)
        return [None] * (lo - i if i < lo else 0) + [int(k) + self.base for k in keys.tolist()] if i < self.nulls else \
            [int(k) + self.base for k in keys.tolist()]

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, by two selects."""
        begin, end = self.offsets(i, i + 1)
        return self.ids[begin:end]


class WordEncoder:
    """Ids of whole texts as bytes.

    A text is cut before blanks and single line breaks that follow a visible character,
    and before marks between a letter or digit and a blank; a stretch between cuts is
    encoded once while the memo holds it.  Stretches are known by their text behind the
    blank; line breaks and marks begin one that has none.  New ones go to the library many at a time, one a line: the
    break is a token of its own, and the ids are cut there again.

    When the memo is full it is set aside and a new one begins; what is met again comes
    over from the one set aside, so frequent stretches stay known."""

    def __init__(self, path: str, kind: str):
        self.tok, self.kind, self.width = tokenizer(path), kind, np.dtype(kind).itemsize
        self.line = self.tok.encode("\n", add_special_tokens=False).ids
        self.known: dict = {}
        self.aside: dict = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if _PLAIN(w)]
        rest = [w for w in new if not _PLAIN(w)] if len(plain) < len(new) else []
        for lo in range(0, len(plain), 4096):
            part = plain[lo:lo + 4096]
            text = "".join([w if w[0] == "\n" else "\n" + w[1:] if w[0] == _AS_IS else "\n " + w for w in part])
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(ids == self.line[0]) if len(self.line) == 1 else []
            if len(at) != len(part):
                rest += part
                continue
            raw, n = ids.tobytes(), self.width
            at = [*(at * n).tolist(), len(raw)]
            self.known.update(zip(part, [raw[x:y] if w[0] == "\n" else raw[x + n:y] for w, x, y in zip(part, at, at[1:])]))
        for lo in range(0, len(rest), 4096):
            part = rest[lo:lo + 4096]
            self.known.update(zip(part, self._ids([w if w[:1] == "\n" else w[1:] if w[:1] == _AS_IS else " " + w for w in part])))

    @staticmethod
    def _stretches(text: str) -> list[str]:
        if not _RUN.search(text):
            for mark in _MARKS:
                text = text.replace(mark + " ", " " + _AS_IS + mark + " ")
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [_CUT.split(x) if _UNSAFE.search(x) else self._stretches(x) for x in texts]
        heads = self._ids([x.pop(0) for x in split])
        words = list(chain.from_iterable(split))
        got = list(map(self.known.get, words))
        unknown = [k for k, ids in enumerate(got) if ids is None]
        new = {words[k] for k in unknown}
        if self.known and len(self.known) + len(new) > MEMO_WORDS:
            self.known, self.aside = {}, self.known
        if self.aside:
            again = new & self.aside.keys()
            self.known.update(zip(again, map(self.aside.__getitem__, again)))
            new -= again
        self._learn(list(new))
        for k in unknown:
            got[k] = self.known[words[k]]
        out, at = [], 0
        for head, x in zip(heads, split):
            out.append(head + b"".join(got[at:at + len(x)]))
            at += len(x)
        if len(self.known) > MEMO_WORDS:  # a batch of more stretches than the memo may hold
            self.known = {}
        return out


def encoder(path: str, kind: str, run: str) -> WordEncoder:
    """The encoder of ``path``, once per worker and run: the run's next task finds what this
    one learned, another run begins anew."""
    if (path, kind, run) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, kind, run] = WordEncoder(path, kind)
    return _ENCODERS[path, kind, run]


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store, path


def _write(folder: str, path: str, end_id: int, shard_ids: int):
    @tidy
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, root = _open(folder)
        width = 2 if tokenizer(path).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        kind = "<u2" if width == 2 else "<u4"
        end, memo, writer, name, count = np.array([end_id], kind).tobytes(), encoder(path, kind, folder), None, None, 0

        def listed():
            n, ids = writer.close()
            return pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "part": pa.array([count], pa.int64()), "file": [name],
                                               "n_docs": pa.array([n], pa.int64()), "n_ids": pa.array([ids], pa.int64())})
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                for key, ids in zip(part.column(0).to_pylist(), memo.encode(texts)):
                    if writer is None:
                        name = f"ids-{task:06d}-{count:04d}-{uuid.uuid4().hex}"
                        writer = ShardWriter(store.open_output_stream(f"{root}/{name}"), width)
                    writer.add(key, ids + end)
                    if writer.n_ids >= shard_ids:
                        yield listed()
                        writer, count = None, count + 1
        if writer is not None:
            yield listed()
    return run


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int = 0, shard_ids: int = SHARD_IDS,
              id_col="doc_id", text_col="text") -> DataFrame:
    """Encode all texts, write the shards under ``folder`` and return the manifest:
    task, part, file, n_docs, n_ids and start (ids of all shards before it).

    ``path``: the file of a byte-level BPE (tokenizers) whose pattern lets no token
    cross from a visible character to a blank behind it; other kinds are refused.
    """
    import json

    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    pre = made.get("pre_tokenizer") or {}
    if made["model"]["type"] != "BPE" or made.get("normalizer") or (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) != ("ByteLevel", False, True) \
            or any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in made["added_tokens"]):
        raise ValueError(f"{path}: cuts before blanks are proven for plain byte-level BPE files only")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text")).withColumn("r", F.monotonically_increasing_id())
    keyed = keyed.repartitionByRange(n, "id", "h", "r").sortWithinPartitions("id", "h", "r").select("id", "text")
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    shards = keyed.mapInArrow(_write(folder, path, end_id, shard_ids), "task bigint, part bigint, file string, n_docs bigint, n_ids bigint")
    shards.write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The committed shards and the place of each in the whole; one row per shard, so one window holds them."""
    shards = spark.read.schema("task bigint, part bigint, file string, n_docs bigint, n_ids bigint").parquet(f"{folder}/manifest")
    before = Window.orderBy("task", "part").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(folder: str):
    @tidy
    def run(batches):
        store, root = _open(folder)
        for batch in batches:
            for name, start, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(f"{root}/{name}") as f:
                    shard = Shard(f)
                    off = shard.offsets(lo, hi)
                    a = 0
                    while a < hi - lo:  # at most 1 M ids, or one longer document, at a time
                        b = max(a + 1, int(np.searchsorted(off, off[a] + (1 << 20), side="right")) - 1)
                        b = min(b, hi - lo)
                        ids = shard.ids[int(off[a]):int(off[b])].astype("<u4").tobytes()
                        cuts = (off[a:b + 1] - off[a]) * 4
                        values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), pa.py_buffer(ids)])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(shard.document_ids(lo + a, lo + b), pa.int64()), pa.array(off[a:b] + start, pa.int64()),
                             pa.array(np.diff(off[a:b + 1]), pa.int64()), values.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
                        a = b
    return run


def read_ids(spark: SparkSession, folder: str, read_docs: int = READ_DOCS, id_col="doc_id") -> DataFrame:
    """id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document, from the files.

    A task row covers ``read_docs`` documents of one shard: select finds its first byte."""
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(read_docs).cast("bigint")))
    parts = read_manifest(spark, folder).select("file", "start", first.alias("lo"), "n_docs")
    parts = parts.select("file", "start", "lo", F.least(F.col("lo") + read_docs, "n_docs").alias("hi"))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "lo")
    out = parts.mapInArrow(_read(folder), "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    return out.withColumnRenamed("doc_id", id_col)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the shared checkpoint folder that goes when the application ends."""
    folder = f"{checkpoint_dir(spark, local_fallback=True).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return system.makeQualified(path).toString()


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from the files."""
    import public_tokenizers

    folder = shared_folder(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
