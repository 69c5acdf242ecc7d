"""Token counts of whole texts, with overlap resynchronisation of huge ones.

Texts of at most ``chunk`` bytes are counted word by word: ASCII blanks always
end a word of the tokenizer, so the counts of distinct words (kept in a bounded
memo) add up to the count of the text.  Longer texts are cut into overlapping
chunks that are dealt over the cluster and encoded with offsets.  Neighbours are
spliced at a common boundary inside their overlap that is proven stable: both
encodings start a token there, right after an ASCII blank or digit, which no
token, special token or normalisation step crosses.  Where an overlap has no
such place, the document goes round again with overlaps eight times as wide and
chunks of at least eight overlaps, at last as one chunk, so a text without any
such place is encoded a few times, not once a chunk.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted one by one; special strings inside texts are handled as the library
does by default; an empty table gives no rows.  Input columns other than id and
text are ignored.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut, table, tidy

#: distinct words that one task remembers
MEMO_WORDS = 300_000
_BLANK = re.compile("[ \t\n\r]+")
_STABLE = re.compile("(?<=[ \t\n\r0-9])(?=[^ \t\n\r])")
_LOADED: dict = {}


def tokenizer(path: str):
    """The tokenizer of ``path``, once per worker, single-threaded."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


#: what the proof of the boundaries holds for: white space ends a word, a digit is one of its own
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"})
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def check_file(path: str) -> None:
    """Refuse a tokenizer for which words and boundaries are not proven."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal = made.get("normalizer") or {"type": "Sequence", "normalizers": []}
    pre = (made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = pre[0]
    proven = (made["model"]["type"] == "BPE" and normal["type"] == "Sequence" and all(x in _NORMALIZERS for x in normal["normalizers"])
              and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"] == {"Regex": _PATTERN}
              and [(x["type"], x.get("add_prefix_space"), x.get("use_regex")) for x in pre[1:]] == [("ByteLevel", False, False)]
              and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"[\s\d]", t["content"]) for t in made["added_tokens"]))
    if not proven:
        raise ValueError(f"{path}: boundaries at blanks and digits are not proven for this tokenizer")


def count_words(texts: list[str], path: str, memo: dict) -> list[int]:
    """Token counts of short texts from the counts of their words."""
    tok = tokenizer(path)
    split = [_BLANK.split(x) for x in texts]
    new = list(set().union(*split) - memo.keys()) if split else []
    if len(memo) + len(new) > MEMO_WORDS:
        memo.clear()
        new = list(set().union(*split))
    if new:
        memo.update(zip(new, map(len, tok.encode_batch_fast(new, add_special_tokens=False))))
    return [sum(map(memo.__getitem__, x)) for x in split]


def _first_pass(path: str, chunk: int):
    @tidy
    def run(batches):
        memo: dict = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                size = [len(x.encode()) for x in texts]
                short = [k for k, n in enumerate(size) if n <= chunk]
                count = dict(zip(short, count_words([texts[k] for k in short], path, memo)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(size, pa.int64()), pa.array([count.get(k) for k in range(len(size))], pa.int64()),
                     pa.array([None if k in count else texts[k] for k in range(len(size))], pa.string())],
                    ["doc_id", "n_bytes", "n_tokens", "text"])
    return run


def _cut_up(chunk: int, overlap: int):
    """Chunk k covers code points [k * chunk - overlap, (k + 1) * chunk + overlap)."""
    @tidy
    def run(batches):
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = 1 if overlap >= len(text) else max(1, -(-len(text) // chunk))
                for k in range(n):
                    lo = max(0, k * chunk - overlap) if k else 0
                    hi = min(len(text), (k + 1) * chunk + overlap) if k + 1 < n else len(text)
                    yield pa.RecordBatch.from_pydict({"rid": pa.array([rid], pa.int64()), "k": pa.array([k], pa.int64()),
                                                      "n": pa.array([n], pa.int64()), "at": pa.array([lo], pa.int64()),
                                                      "piece": pa.array([text[lo:hi]], pa.string())})
    return run


def _encode(path: str, chunk: int, overlap: int):
    place = pa.list_(pa.struct([("p", pa.int64()), ("before", pa.int64())]))

    @tidy
    def run(batches):
        tok = tokenizer(path)
        for batch in batches:
            c = batch.to_pydict()
            lefts, rights, totals = [], [], []
            for k, n, at, piece in zip(c["k"], c["n"], c["at"], c["piece"]):
                enc = tok.encode(piece, add_special_tokens=False)
                starts = np.array([o[0] for o in enc.offsets], np.int64)
                zones = []
                for lo, hi, on in ((k * chunk - overlap, k * chunk + overlap, k > 0),
                                   ((k + 1) * chunk - overlap, (k + 1) * chunk + overlap, k + 1 < n)):
                    zone = []
                    if on:
                        lo, hi = max(0, lo - at), min(len(piece), hi - at)
                        for m in _STABLE.finditer(piece, lo + 1, hi):
                            i = int(np.searchsorted(starts, m.start()))
                            if i < len(starts) and starts[i] == m.start():
                                zone.append({"p": at + m.start(), "before": i})
                    zones.append(zone)
                lefts.append(zones[0])
                rights.append(zones[1])
                totals.append(len(starts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(totals, pa.int64()),
                                              pa.array(lefts, place), pa.array(rights, place)],
                                             ["rid", "k", "n", "total", "left_zone", "right_zone"])
    return run


_ZONE = "array<struct<p:bigint,before:bigint>>"


def _resynchronised(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(rid, n_tokens) of texts, n_tokens null where an overlap has no common boundary."""
    pieces = long.select("rid", "text").mapInArrow(_cut_up(chunk, overlap), "rid bigint, k bigint, n bigint, at bigint, piece string")
    pieces = pieces.repartition(int(long.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid", "k")
    enc = pieces.mapInArrow(_encode(path, chunk, overlap),
                            f"rid bigint, k bigint, n bigint, total bigint, left_zone {_ZONE}, right_zone {_ZONE}")
    w = Window.partitionBy("rid").orderBy("k")
    enc = enc.withColumn("prev", F.lag("right_zone").over(w)).withColumn("next", F.lead("left_zone").over(w))
    common = lambda a, b: F.array_min(F.array_intersect(F.transform(a, lambda z: z["p"]), F.transform(b, lambda z: z["p"])))
    before = lambda zone, p: F.get(F.filter(zone, lambda z: z["p"] == p), F.lit(0))["before"]
    enc = enc.withColumn("p0", common(F.col("prev"), F.col("left_zone"))).withColumn("p1", common(F.col("right_zone"), F.col("next")))
    lo = F.when(F.col("k") == 0, F.lit(0)).otherwise(before(F.col("left_zone"), F.col("p0")))
    hi = F.when(F.col("k") + 1 == F.col("n"), F.col("total")).otherwise(before(F.col("right_zone"), F.col("p1")))
    enc = enc.select("rid", (hi - lo).alias("own"))
    return enc.groupBy("rid").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"))


def count_tokens(docs: DataFrame, path: str, chunk: int = 32_768, overlap: int = 512,
                 id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_bytes, n_tokens of every whole text.  ``path``: a tokenizers .json file
    at the same place on every executor; files for which the boundaries are not proven are refused."""
    check_file(path)
    kind = dict(docs.dtypes)[id_col]
    first = (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
             .mapInArrow(_first_pass(path, chunk), f"doc_id {kind}, n_bytes bigint, n_tokens bigint, text string")
             .withColumn("rid", F.monotonically_increasing_id()))
    first = cut(first, "tokens")  # ids of rows are fixed from here on
    done = first.filter("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens")
    waiting, wide = first.filter("n_tokens is null"), overlap
    while True:
        got = cut(_resynchronised(waiting, path, max(chunk, 8 * wide), wide), "splice")
        ok = got.filter("n_tokens is not null")
        done = done.unionByName(first.drop("n_tokens").join(ok, "rid").select("doc_id", "n_bytes", "n_tokens"))
        if got.filter("n_tokens is null").isEmpty():
            break
        waiting = waiting.join(got.filter("n_tokens is null").select("rid"), "rid", "left_semi")
        wide *= 8
    return done.withColumnRenamed("doc_id", id_col)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document under word_bpe_49k.json."""
    import public_tokenizers

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
