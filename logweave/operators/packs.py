"""TF-IDF vectors of a corpus as packs: small numbers per document, words once per pack.

Postings in long form, ``(repo, seq, term, weight)``, are shuffled by word, by document
and by word again, and each time every posting is a row.  Here the documents of a repo
that lie in one partition form packs of about ``PACK_TOKENS`` tokens.  A document holds
the places of its words in the word list of its pack, and their counts; only word lists
are shuffled to find document frequencies.  Weights are formed where they are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import tokenize
from logweave.operators.keyed import join_per_repo
from logweave.session import checkpoint_dir, stored

PACK_TOKENS = 1 << 20
SLICE_ROWS = 256

_PACKED = pa.schema([("repo", pa.string()), ("pack", pa.int64()), ("seq", pa.int64()), ("codes", pa.list_(pa.int32())),
                     ("counts", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("n", pa.list_(pa.int32()))])
_SUMS = pa.schema([("repo", pa.string()), ("cluster_id", pa.int32()), ("size", pa.int64()), ("term", pa.string()), ("weight", pa.float64())])
_POSTINGS = pa.schema([("repo", pa.string()), ("seq", pa.int64()), ("term", pa.string()), ("cnt", pa.int64()),
                       ("df", pa.int64()), ("weight", pa.float64())])
_VECTORS = pa.schema([("repo", pa.string()), ("pack", pa.int64()), ("level", pa.int32()), ("seq", pa.int64()), ("digest", pa.binary()),
                      ("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("idfs", pa.list_(pa.float64())), ("norm", pa.float64())])
_SQL = {"int32": "int", "int64": "long", "double": "double", "string": "string", "binary": "binary"}


def sql_schema(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} " + (f"array<{_SQL[str(f.type.value_type)]}>" if pa.types.is_list(f.type) else _SQL[str(f.type)])
                     for f in schema)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


@dataclass
class Packs:
    docs: DataFrame    # (repo, pack, seq, codes, counts): documents with words, codes ascending
    words: DataFrame   # (repo, pack, term_ids, dfs): one row per pack, in order of code
    terms: DataFrame   # (repo, pack, terms): one row per pack, in order of code
    sizes: DataFrame   # (repo, n_docs): all documents of a repo

    def each(self, docs: DataFrame, fn, schema: pa.Schema, col: str) -> DataFrame:
        """``fn(rows, doc, code, count, idf, norm, words)`` for every pack: ``docs`` are rows of
        ``self.docs`` with more columns, then per posting the place of its document, its
        code, count and idf, and the norm of every document; ``words``: ``df`` and ``col``
        ("term" or "term_id") by code."""
        rows = join_per_repo(docs, self.sizes)
        words = self.words if col == "term_id" else self.words.select("repo", "pack", "dfs").join(self.terms, ["repo", "pack"])
        words = words.select(F.col("repo").alias("repo_w"), F.col("pack").alias("pack_w"), "dfs", F.col(f"{col}s").alias("values"))

        def pack(a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a):
                return schema.empty_table()
            a, b = a.combine_chunks(), b.combine_chunks()
            b = pa.table({"df": b["dfs"].combine_chunks().flatten(), col: b["values"].combine_chunks().flatten()})
            codes = a["codes"].combine_chunks()
            code = codes.flatten().to_numpy()
            doc = np.repeat(np.arange(len(a)), codes.value_lengths().to_numpy())
            count = a["counts"].combine_chunks().flatten().to_numpy()
            idf = np.log((1.0 + a["n_docs"].to_numpy()[0]) / (1.0 + b["df"].to_numpy())) + 1.0
            idf = idf[code]
            raw = count * idf
            norm = np.sqrt(np.bincount(doc, raw * raw, len(a)))
            return pa.table(fn(a, doc, code, count, idf, norm, b), schema=schema)

        return rows.groupBy("repo", "pack").cogroup(words.groupBy("repo_w", "pack_w")).applyInArrow(pack, sql_schema(schema))

    def postings(self) -> DataFrame:
        """X1 in long form, as ``vectors.tfidf`` returns it."""
        def rows(a, doc, code, count, idf, norm, words):
            return {"repo": a["repo"].combine_chunks().take(pa.array(doc)), "seq": a["seq"].combine_chunks().take(pa.array(doc)),
                    "term": words["term"].combine_chunks().take(pa.array(code)), "cnt": pa.array(count.astype(np.int64)),
                    "df": pa.array(words["df"].to_numpy()[code]), "weight": pa.array(count * idf / norm[doc])}
        return self.each(self.docs, rows, _POSTINGS, "term")

    def cluster_sums(self, members: DataFrame) -> DataFrame:
        """``(repo, cluster_id, size, term, weight)``: sums of weights over ``members``
        (repo, seq, cluster_id, size), one row per pack, cluster and word."""
        def sums(a, doc, code, count, idf, norm, words):
            weight = count * idf / norm[doc]
            cluster, place = np.unique(a["cluster_id"].to_numpy(), return_inverse=True)
            key, at = np.unique(place[doc].astype(np.int64) * len(words) + code, return_inverse=True)
            first = np.zeros(len(cluster), np.int64)
            first[place] = np.arange(len(a))
            c = key // len(words)
            return {"repo": pa.repeat(a["repo"][0], len(key)), "cluster_id": pa.array(cluster[c], pa.int32()),
                    "size": pa.array(a["size"].to_numpy()[first[c]], pa.int64()),
                    "term": words["term"].combine_chunks().take(pa.array(key % len(words))),
                    "weight": pa.array(np.bincount(at, weight, len(key)))}
        return self.each(self.docs.join(members, ["repo", "seq"]), sums, _SUMS, "term")

    def vectors(self, level) -> DataFrame:
        """``(repo, pack, level, seq, digest, ids, counts, idfs, norm)`` per document that has a
        place, for weights of ``count * idf / norm``: words of a single document link nothing
        and are left out of ``ids``; equal digests mean equal words and counts.  Rows of a
        pack stand in order of ``level``."""
        docs = self.docs.filter(F.col("seq").isNotNull()).withColumn("level", level.cast("int"))

        def rows(a, doc, code, count, idf, norm, words):
            ids = words["term_id"].to_numpy()[code]
            order = np.lexsort((ids, doc))
            ids, idf, count, shared = ids[order], idf[order], count[order].astype(np.int64), words["df"].to_numpy()[code[order]] > 1
            at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(a)))])
            digest = [hashlib.sha256(ids[x:y].tobytes() + count[x:y].tobytes()).digest() for x, y in zip(at, at[1:])]
            sizes = np.bincount(doc[shared], minlength=len(a))
            made = pa.table({**{c: a[c] for c in ("repo", "pack", "level", "seq")}, "digest": pa.array(digest, pa.binary()),
                             "ids": lists(ids[shared], sizes), "counts": lists(count[shared].astype(np.int32), sizes),
                             "idfs": lists(idf[shared], sizes), "norm": pa.array(norm)}, schema=_VECTORS)
            return dict(zip(_VECTORS.names, made.sort_by("level").columns))
        return self.each(docs, rows, _VECTORS, "term_id")


def _pack(batches):
    """Sorted rows ``(repo, seq, tokens)`` to packs, each with one row that is its word list;
    rows of one (repo, seq) are one document."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32

    def packs(table: pa.Table):
        nonlocal number
        repos, seqs = table["repo"].combine_chunks(), table["seq"].combine_chunks()
        tokens = table["tokens"].combine_chunks()
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, ends = tokens.flatten(), np.concatenate([[0], np.cumsum(sizes)])
        repo = repos.dictionary_encode().indices.to_numpy()
        seq, empty = seqs.fill_null(0).to_numpy(zero_copy_only=False), seqs.is_null().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(np.diff(repo)) + 1
        for lo, hi in zip([0, *turns.tolist()], [*turns.tolist(), len(repo)]):
            if ends[lo] == ends[hi]:
                continue
            s, e = seq[lo:hi], empty[lo:hi]
            doc = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]) | (e[1:] != e[:-1])]))
            coded = flat.slice(ends[lo], ends[hi] - ends[lo]).dictionary_encode()
            words = len(coded.dictionary)
            key, count = np.unique(np.repeat(doc, sizes[lo:hi]) * words + coded.indices.to_numpy(), return_counts=True)
            code, held = (key % words).astype(np.int32), key // words
            docs, per = np.unique(held, return_counts=True)
            first = lo + np.searchsorted(doc, docs)
            n, k = len(docs), repos[lo]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(k, n), pa.repeat(pa.scalar(number, pa.int64()), n), seqs.take(pa.array(first)), lists(code, per),
                 lists(count.astype(np.int32), per), pa.nulls(n, _PACKED.field("terms").type), pa.nulls(n, _PACKED.field("n").type)], schema=_PACKED)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(k, 1), pa.array([number], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, _PACKED.field("codes").type),
                 pa.nulls(1, _PACKED.field("counts").type), pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), coded.dictionary),
                 lists(np.bincount(code, minlength=words).astype(np.int32), np.array([words]))], schema=_PACKED)
            number += 1

    held, size, last = [], 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            if size >= PACK_TOKENS and (part["repo"][0], part["seq"][0]) != last:
                yield from packs(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(part)
            size += len(part["tokens"].flatten())
            last = (part["repo"][part.num_rows - 1], part["seq"][part.num_rows - 1])
    if held:
        yield from packs(pa.Table.from_batches(held))


def pack_texts(docs: DataFrame, text_col: str = "message") -> Packs:
    """X1 of ``docs`` as packs.  Document frequencies count every document of a repo, also
    those without a place; rows without a repo have no vector."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by ranges a repo lies in few partitions, so its packs are full and its words stand in few lists
    rows = (docs.filter(F.col("repo").isNotNull()).select("repo", "seq", text_col)
            .repartitionByRange(parts, "repo", F.xxhash64("seq"), "seq")
            .sortWithinPartitions("repo", "seq").select("repo", "seq", tokenize(text_col).alias("tokens")))
    packed = stored(rows.mapInArrow(_pack, sql_schema(_PACKED)), "packs")
    lists_of = packed.filter(F.col("terms").isNotNull())
    said = lists_of.select("repo", "pack", F.posexplode(F.arrays_zip("terms", "n")).alias("code", "w")).select(
        "repo", F.col("w.terms").alias("term"), F.struct("pack", "code", F.col("w.n").alias("n")).alias("at"))
    # words go to their packs as numbers; sorted, so that a repeated task gives the same numbers
    terms = (said.groupBy("repo", "term").agg(F.collect_list("at").alias("at"))
             .sortWithinPartitions("repo", "term").select("repo", "at", F.monotonically_increasing_id().alias("term_id"),
                                                          F.aggregate("at.n", F.lit(0).cast("long"), lambda x, y: x + y).alias("df")))
    words = (terms.select("repo", F.explode("at").alias("at"), "term_id", "df")
             .groupBy("repo", F.col("at.pack").alias("pack")).agg(F.sort_array(F.collect_list(F.struct("at.code", "term_id", "df"))).alias("w"))
             .select("repo", "pack", F.col("w.term_id").alias("term_ids"), F.col("w.df").alias("dfs")))
    sizes = docs.filter(F.col("repo").isNotNull()).groupBy("repo").agg(F.count(F.lit(1)).alias("n_docs"))
    return Packs(packed.filter(F.col("codes").isNotNull()).select("repo", "pack", "seq", "codes", "counts"),
                 stored(words, "words"), lists_of.select("repo", "pack", "terms"), stored(sizes, "sizes"))
