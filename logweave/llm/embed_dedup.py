"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation learnt on a bounded sample, with thresholds at the medians, gives
balanced bits.  Several rotations yield a code that is cut into substrings; each
substring is one hash table.  Vectors that share a bucket of a table are compared
by cosine on the original vectors.  Substring length follows the number of
vectors, and tables are added until pairs that lie exactly at the threshold
(sample vectors, turned by that angle) meet with probability ``recall``; where the
most tables allowed do not reach it, substrings are shortened until they do.

Defined results: a null label, and a vector that is null, empty, zero, or holds
null or non-finite parts, links with nothing and is its own component; a null id
takes part, is never the smallest, and its component is null where it reaches no
other; equal vectors of a label are linked, repeated rows too; vectors of
different lengths never link; an empty table gives no rows.  Input columns other
than id, vector and label are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.common import cut, table, tidy
from logweave.llm.features import uniform
from logweave.llm.graph import classes, linked_rows, on_cells, pairs_of, results, to_cells


@dataclass
class Itq:
    """Rotations and thresholds by vector length; lengths outside the sample get random rotations."""
    bits: int
    tables: int
    fitted: dict = field(default_factory=dict)

    def rotations(self, dim: int) -> list:
        need = -(-self.bits * self.tables // dim)
        have = self.fitted.setdefault(dim, [])
        while len(have) < need:
            rng = np.random.default_rng(1000 * dim + len(have))
            have.append((np.linalg.qr(rng.normal(size=(dim, dim)))[0], np.zeros(dim)))
        return have[:need]

    def keys(self, u: np.ndarray) -> np.ndarray:
        """Table keys (rows x tables) of unit vectors."""
        bit = np.concatenate([u @ r > m for r, m in self.rotations(u.shape[1])], axis=1)[:, :self.bits * self.tables]
        w = (1 << np.arange(self.bits)).astype(np.int64)
        return bit.reshape(len(u), self.tables, self.bits) @ w


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, safe for very large and small parts."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn_rotation(u: np.ndarray, seed: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Iterative quantisation: alternate signs and the best rotation onto them."""
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(u.shape[1],) * 2))[0]
    for _ in range(rounds):
        p = u @ r
        b = np.where(p > np.median(p, axis=0), 1.0, -1.0)
        left, _, right = np.linalg.svd(u.T @ b)
        r = left @ right
    return r, np.median(u @ r, axis=0)


def learn(sample: np.ndarray, largest: int, cosine: float, recall: float, most_tables: int = 64) -> Itq:
    """Codes for groups of up to ``largest`` vectors; substrings get shorter where ``most_tables`` tables do not reach the recall."""
    bits = min(24, max(8, math.ceil(math.log2(max(2, largest)))))
    if len(sample) < 2:
        return Itq(bits, math.ceil(math.log(1 - recall) / math.log(1 - (1 - math.acos(cosine) / math.pi) ** bits)))
    dim = sample.shape[1]
    u = unit(sample)
    rng = np.random.default_rng(11)
    probe = u[rng.permutation(len(u))[:2000]]
    side = rng.normal(size=probe.shape)
    side -= (side * probe).sum(axis=1, keepdims=True) * probe
    # vectors of one part cannot be turned
    turned = cosine * probe + math.sqrt(1 - cosine * cosine) * unit(side) if dim > 1 else probe
    itq = Itq(bits, most_tables, {dim: [learn_rotation(u, k) for k in range(-(-bits * most_tables // dim))]})
    for itq.bits in range(bits, 0, -1):
        reached = np.maximum.accumulate(itq.keys(probe) == itq.keys(turned), axis=1).mean(axis=0)
        if reached[-1] >= recall:
            break
    else:
        raise ValueError(f"{most_tables} tables reach a recall of {reached[-1]:.4f}, not {recall}")
    itq.tables = int(np.searchsorted(reached, recall)) + 1
    itq.fitted = {dim: itq.rotations(dim)}
    return itq


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, vector as doubles or null, label, node): node identifies equal vectors of one label."""
    v = F.col(vector_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & F.col(label_col).isNotNull() & ~bad & F.exists(v, lambda x: x != 0)
    vec = F.when(F.coalesce(ok, F.lit(False)), F.transform(v, lambda x: x + 0.0))
    node = F.when(vec.isNotNull(), F.unhex(F.md5(F.concat_ws(",", F.col(label_col).cast("string"), vec.cast("array<string>")))))
    return vectors.select(F.col(id_col).alias("id"), vec.alias("vec"), F.col(label_col).alias("label"), node.alias("node"))


def _compare(cosine: float):
    def work(c: dict):
        n = len(c["node"])
        u = np.frombuffer(b"".join(c["unit"])).reshape(n, -1)
        i, j = pairs_of(u @ u.T >= cosine, c["blk"])
        if not len(i):
            return None
        # a pair counts in the first table where it meets
        keys = np.frombuffer(b"".join(c["keys"]), np.int32).reshape(n, -1)[:, :c["k"][0]]
        return linked_rows(c["node"], i, j, c["copies"], ~(keys[i] == keys[j]).any(axis=1))
    return work


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, recall: float = 0.995, sample_rows: int = 4_000, block: int = 256,
                    id_col="vec_id", vector_col="embedding", label_col="label") -> DataFrame:
    """id, n_links and component of every vector.  The rotation is learnt on about
    ``sample_rows`` vectors (at most twice as many); every vector is indexed."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, label_col)
    cls = cut(classes(rows.select("node", "id"), "node", "id").join(
        rows.filter("node is not null").select("node", "vec", "label").dropDuplicates(["node"]), "node"), "vectors")
    size = cls.groupBy("label", F.size("vec").alias("dim")).count().agg(F.max("count"), F.sum("count")).first()
    largest, total = size[0] or 0, size[1] or 0
    got = cls.filter(uniform("node") < min(1.0, sample_rows / max(1, total))).select("vec").limit(2 * sample_rows).collect()
    dims = [len(r["vec"]) for r in got]
    dim = max(set(dims), key=dims.count) if dims else 1
    sample = np.array(sorted(r["vec"] for r in got if len(r["vec"]) == dim)).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(learn(sample, largest, cosine, recall))

    @tidy
    def index(batches):
        itq = shared.value
        for batch in batches:
            vec = batch.column(1).to_pylist()
            units, keys, by = [b""] * len(vec), [b""] * len(vec), {}
            for k, v in enumerate(vec):
                by.setdefault(len(v), []).append(k)
            for at in by.values():
                u = unit(np.array([vec[x] for x in at]))
                for k, one, row in zip(at, u, itq.keys(u).astype(np.int32)):
                    units[k], keys[k] = one.tobytes(), row.tobytes()
            cells = [np.frombuffer(x, np.int32) for x in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(units, pa.binary()), pa.array(keys, pa.binary()),
                 pa.array(cells, pa.list_(pa.int32()))], ["node", "label", "copies", "unit", "keys", "key"])

    kind = dict(cls.dtypes)["label"]
    keyed = cut(cls.select("node", "vec", "label", "copies").mapInArrow(
        index, f"node binary, label {kind}, copies bigint, unit binary, keys binary, key array<int>"), "codes")
    slim = keyed.select("node", "label", F.octet_length("unit").alias("dim"), F.posexplode("key").alias("k", "key"))
    slim = slim.select("node", "k", F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), "dim", "k", "key"))).alias("bucket"))
    full = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shares = slim.join(full, "bucket").join(keyed.select("node", "copies", "unit", "keys"), "node")
    cells = to_cells(shares, "bucket", "node", F.ceil(F.col("members") / block))
    found = on_cells(cells.select("cell", "blk", "k", "node", "copies", "keys", "unit"), _compare(cosine))
    return results(rows.select("id", "node"), cls.select("node", "first", "copies"), found, "id").withColumnRenamed("id", id_col)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    out = near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"),
                      F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings),
u AS (SELECT rid, vec_id, label, e FROM v WHERE ok),
p AS (SELECT a.rid AS x, b.rid AS y FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.rid <> b.rid
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT rid, rid FROM v UNION SELECT reach.x, p.y FROM reach JOIN p ON reach.y = p.x),
c AS (SELECT x, min(v.vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.y GROUP BY x),
n AS (SELECT x, count(*) AS k FROM p GROUP BY x)
SELECT vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept
FROM v JOIN c ON c.x = v.rid LEFT JOIN n ON n.x = v.rid
"""
