"""SentencePiece encoding and decoding over a lattice of pieces.

The text, with a leading blank and blanks as U+2581, falls into words that begin
with blank marks; no piece of the model crosses a word's start (checked when the
model is read).  Substrings of bounded length are joined to the piece table by
equality, the hits are the edges of each word's lattice, and a fold picks the path.

Two folds:

* ``viterbi_words``: Spark's ``aggregate`` over the edges of every word, the best sum
  of scores (unigram models), on a table of distinct words;
* ``encode``: the merge order of BPE models, in which the best-scored edge that joins
  two neighbours is taken first, the leftmost of equals.  The best sum of BPE scores
  is another segmentation than the model's (see README), so this is the fold for the
  BPE file.  It runs on distinct words of Arrow batches, column by column in numpy.

Characters outside the table become byte pieces.  Words of over ``LONG`` characters
are given to the library, which does the same in less than quadratic time.

Defined results: null and empty texts have no pieces and decode to the empty text;
U+2581 in a text counts as a blank, as the model has it; repeated rows are encoded one
by one; an empty table gives no rows.  Other input columns are kept by ``encode``.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import mix64, sheltered, table, tidy

MARK = "▁"
LONG = 400
MEMO_WORDS = 300_000
#: characters of one part of a long text
PART_CHARS = 1 << 20
#: characters of the words that one lattice holds; each takes a row of the longest piece's length
LATTICE_CHARS = 1 << 17
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")
_LOADED: dict = {}
_M = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """Piece table of a model file: id by hash of the piece, score rank by id, bytes by id."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        name = [self.sp.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not (self.sp.is_control(k) or self.sp.is_unknown(k) or self.sp.is_byte(k) or self.sp.is_unused(k))]
        if any(re.search(f"[^{MARK}]{MARK}", name[k]) for k in plain):
            raise ValueError("a piece holds a blank mark behind another character; words are not independent")
        self.longest = max(len(name[k]) for k in plain)
        score = np.array([self.sp.get_score(k) for k in range(n)])
        order = np.lexsort((np.arange(n), -score))
        self.none = n  # stands for no piece; its rank is the last
        self.rank = np.full(n + 1, n + 1, np.int32)
        self.rank[order] = np.unique(-score[order], return_inverse=True)[1]
        self.bytes_of = [x.encode() for x in name]
        self.byte_id = np.zeros(256, np.int32)
        for k in range(n):
            if self.sp.is_byte(k):
                value = int(name[k][3:5], 16)
                self.byte_id[value], self.bytes_of[k] = k, bytes([value])
            elif self.sp.is_control(k) or self.sp.is_unknown(k):
                self.bytes_of[k] = b""
        size = np.array([len(name[k]) for k in plain])
        points = np.frombuffer("".join(name[k].ljust(self.longest) for k in plain).encode("utf-32-le"), np.uint32).reshape(-1, self.longest)
        h = np.zeros(len(plain), np.uint64)
        for k in range(self.longest):
            on = size > k
            h[on] = mix64(h[on] * _M + points[on, k].astype(np.uint64) + np.uint64(1))
        by = np.argsort(h)
        self.keys, self.ids = h[by], np.array(plain, np.int32)[by]
        self.table = [(name[k], k, float(score[k])) for k in plain]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[h >> np.uint64(42)] = True

    def lattice(self, points: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Ids of the pieces at (start, length - 1) of all characters, ``none`` where there is none.
        ``end``: end of the word of each character."""
        out = np.full((len(points), self.longest), self.none, np.int32)
        h, at = np.zeros(len(points), np.uint64), np.arange(len(points))
        for k in range(self.longest):
            at = at[at + k < end[at]]
            if not len(at):
                break
            h[at] = mix64(h[at] * _M + points[at + k].astype(np.uint64) + np.uint64(1))
            maybe = at[self.filter[h[at] >> np.uint64(42)]]
            i = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[i] == h[maybe]
            out[maybe[hit], k] = self.ids[i[hit]]
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of each word, by the model's merge order."""
        size = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        stop = np.cumsum(size)
        end_of = np.repeat(stop, size)
        ids = self.lattice(points, end_of)
        last_rank = self.rank[self.none]
        flat, wide = ids.ravel(), self.longest
        live = np.ones(len(points), bool)  # characters that begin a symbol
        at, word = np.arange(len(points), dtype=np.int32), np.repeat(np.arange(len(words), dtype=np.int32), size)
        end_of = end_of.astype(np.int32)
        while len(at):
            # symbols of the words that still change, in order; each may join its right neighbour
            inner = np.flatnonzero(word[1:] == word[:-1])
            if not len(inner):
                break
            after = np.append(at[1:], 0)
            over = np.append(word[2:] != word[:-2], True)[inner]  # the neighbour is the word's last symbol
            after = np.where(over, end_of[at[inner]], np.append(after[1:], 0)[inner])
            length = after - at[inner]
            fits = length <= wide
            inner, length = inner[fits], length[fits]
            c = self.rank[flat[at[inner] * wide + length - 1]]
            can = c < last_rank
            inner, c = inner[can], c[can]
            if not len(inner):
                break
            of = word[inner]
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            best = np.repeat(np.minimum.reduceat(c, first), np.diff(np.append(first, len(c))))
            hit = np.flatnonzero(c == best)
            hit = hit[np.concatenate([[True], of[hit][1:] != of[hit][:-1]])]  # leftmost of each word
            gone = inner[hit] + 1
            live[at[gone]] = False
            keep = np.zeros(len(words), bool)
            keep[of[first]] = True
            keep = keep[word]
            keep[gone] = False
            at, word = at[keep], word[keep]
        s = np.flatnonzero(live)
        e = np.append(s[1:], len(points))
        got = ids[s, np.minimum(e - s, self.longest) - 1]
        out, cuts = [], np.searchsorted(s, np.concatenate([[0], stop]))
        strange = np.flatnonzero(got == self.none)
        if not len(strange):
            return [got[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:])]
        bad = set(np.searchsorted(cuts, strange, side="right") - 1)
        for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
            if k not in bad:
                out.append(got[a:z].tobytes())
                continue
            parts = [self.byte_id[list(chr(points[s[x]]).encode("utf-8", "surrogatepass"))] if got[x] == self.none else got[x:x + 1] for x in range(a, z)]
            out.append(np.concatenate(parts).astype(np.int32).tobytes())
        return out

    def _encode_marked(self, marked: list[str], memo: dict) -> list[bytes]:
        split = [_WORDS.findall(t) for t in marked]
        new = list(set().union(*split) - memo.keys()) if split else []
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = list(set().union(*split))
        part, chars = [], 0
        for w in new:
            if len(w) > LONG:
                memo[w] = np.array(self.sp.encode(w[1:].replace(MARK, " ")), np.int32).tobytes()
                continue
            part.append(w)
            chars += len(w)
            if chars >= LATTICE_CHARS:  # the lattice of one part is bounded
                memo.update(zip(part, self.merge(part)))
                part, chars = [], 0
        if part:
            memo.update(zip(part, self.merge(part)))
        return [b"".join(map(memo.__getitem__, x)) for x in split]

    def encode(self, texts: list, memo: dict) -> list[np.ndarray]:
        """Ids of whole texts; long ones go in parts that begin at a blank."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        out: list = [None] * len(marked)
        short = [k for k, t in enumerate(marked) if len(t) <= PART_CHARS]
        for k, ids in zip(short, self._encode_marked([marked[k] for k in short], memo)):
            out[k] = ids
        for k, t in enumerate(marked):
            if out[k] is None:
                ids, at = [], 0
                while at < len(t):
                    to = t.find(MARK, at + PART_CHARS)
                    while to > 0 and t[to - 1] == MARK:  # a run of blanks stays in one part
                        to = t.find(MARK, to + 1)
                    to = len(t) if to < 0 else to
                    ids += self._encode_marked([t[at:to]], memo)
                    at = to
                out[k] = b"".join(ids)
        return [np.frombuffer(x, np.int32) for x in out]

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


def pieces_of(path: str) -> tuple[Pieces, dict]:
    """The piece table of ``path``, kept by the worker, and a memo for one task."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path], {}


def encode(df: DataFrame, path: str, text_col: str = "text", digest: bool = False) -> DataFrame:
    """``df`` without its text, plus ids (array<int>) and round_trip (the decoded ids are
    the text); with ``digest``, n_pieces and ids_sha256 (of the ids, comma-joined) instead of ids."""
    keep = [c for c in df.columns if c not in (text_col, "ids", "round_trip", "n_pieces", "ids_sha256")]
    src = df.select(F.col(text_col).alias("_text"), *keep)
    made = "n_pieces bigint, ids_sha256 string" if digest else "ids array<int>"

    @tidy
    def run(batches):
        p, memo = pieces_of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(0).to_pylist()]
                ids = p.encode(texts, memo)
                back = [p.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts)]
                if digest:
                    cols = [pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in ids])]
                    names = ["n_pieces", "ids_sha256"]
                else:
                    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                    off = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                    cols, names = [pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int32()))], ["ids"]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *cols, pa.array(back, pa.bool_())], [*part.schema.names[1:], *names, "round_trip"])

    head = [f"`{c}` {t}" for c, t in src.dtypes[1:]]
    return src.mapInArrow(run, ", ".join([*head, made, "round_trip boolean"]))


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``df`` plus ``text``, decoded from the ids (null ids: null)."""
    @tidy
    def run(batches):
        p, _ = pieces_of(path)
        for batch in batches:
            text = [None if x is None else p.decode(np.array(x, np.int32)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    cols = [ids_col, *(c for c in df.columns if c not in (ids_col, "text"))]
    src = df.select(*cols)
    return src.mapInArrow(run, ", ".join([f"`{c}` {t}" for c, t in src.dtypes] + ["text string"]))


def viterbi_words(words: DataFrame, pieces: DataFrame, longest: int, unknown: float = -100.0) -> DataFrame:
    """(word, ids, score) of distinct words: the path with the best sum of scores.

    ``pieces``: (piece, id, score); the substrings of up to ``longest`` characters are
    exploded, joined to it by equality and grouped by word; Spark's ``aggregate`` folds
    over the ends.  A single character outside the table costs ``unknown`` and gives id -1.
    Of equal sums the last piece that starts first wins.
    """
    w = words.select("word").distinct()
    at = F.explode(F.sequence(F.lit(0), F.length("word") - 1))
    sub = w.filter(F.length("word") > 0).select("word", at.alias("a"))
    sub = sub.select("word", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("a")))).alias("n"))
    sub = sub.select("word", "a", "n", F.expr("substring(word, a + 1, n)").alias("piece"))
    edge = sub.join(F.broadcast(pieces), "piece", "left").filter("id IS NOT NULL OR n = 1")  # the table is fixed by the model
    edge = edge.select("word", F.struct((F.col("a") + F.col("n")).alias("z"), "a", F.coalesce("id", F.lit(-1)).alias("id"),
                                        F.coalesce("score", F.lit(unknown)).alias("s")).alias("e"))
    g = edge.groupBy("word").agg(F.collect_list("e").alias("edges"))
    step = F.aggregate(
        F.sequence(F.lit(1), F.length("word")), F.expr("array(named_struct('s', 0D, 'a', 0, 'id', -1))"),
        lambda acc, z: F.concat(acc, F.array(F.array_max(F.transform(
            F.filter("edges", lambda e: e["z"] == z),
            lambda e: F.struct((acc[e["a"]]["s"] + e["s"]).alias("s"), (-e["a"]).alias("a"), e["id"].alias("id")))))))
    g = g.withColumn("best", step)
    walk = F.aggregate(
        F.sequence(F.lit(1), F.length("word")), F.struct(F.length("word").alias("z"), F.expr("cast(array() as array<int>)").alias("ids")),
        lambda acc, _: F.when(acc["z"] == 0, acc).otherwise(F.struct(
            (-F.element_at("best", acc["z"] + 1)["a"]).alias("z"),
            F.concat(F.array(F.element_at("best", acc["z"] + 1)["id"]), acc["ids"]).alias("ids"))),
        lambda acc: acc["ids"])
    return g.select("word", walk.alias("ids"), F.element_at("best", -1)["s"].alias("score"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under piece_bpe_32k.model, and whether they decode to the text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digest=True).select("doc_id", "n_pieces", "ids_sha256", "round_trip")


@sheltered
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the documents' ids in place of their texts."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
