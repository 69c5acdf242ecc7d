"""Merkle manifest of a dataset: one tree a source, one tree over the sources' roots.

A leaf is the digest of a row's fields.  The leaves of a source ascend by id (ties by
digest); every ``FAN`` consecutive nodes become the digest of their hex digests until
one is left, the subroot, and the subroots, ordered by source, likewise give the root.

A superblock is ``FAN ** height`` consecutive nodes of a tree, the rows of one group.
On the way up each superblock is reduced to one node, and the nodes of all superblocks
are the next stage, until every tree has one.  On the way down the nodes of a stage
and the outer proof of their superblock (the siblings from its node to the root) are
cogrouped by superblock in ``applyInPandas``, which finishes the local reduction, joins
local and outer proof, and at the leaves folds leaf or claim up to the root.  A group
holds digests only and never more than a superblock, however large a source is.  Places
come from a range sort and per-partition counts, so no task ranks a whole source.

Defined results: null fields count as ``-``; a null source is a source of its own, the
first; null ids come first; rows that share an id are leaves of their own, ordered by
digest, equal ones are interchangeable; a lone leaf is its subroot and a lone subroot
the root, with no siblings; an empty table has no rows and no root.  Input columns other
than those named are ignored.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.llm.common import cut, table

FAN = 16
#: rounds of reduction inside a superblock
HEIGHT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(*fields: Column) -> Column:
    """Hex digest of fields: ``-`` for null, else byte count, ``:`` and value."""
    def framed(c):
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields)), 256)


def _digest(hexes) -> str:
    return hashlib.sha256("".join(hexes).encode()).hexdigest()


def _rounds(n: int, height: int) -> int:
    """Rounds until ``n`` nodes of a tree are one, at most ``height``."""
    k = 0
    while n > 1 and k < height:
        n, k = -(-n // FAN), k + 1
    return k


def _levels(digests: list[str], rounds: int) -> list[list[str]]:
    levels = [digests]
    for _ in range(rounds):
        last = levels[-1]
        levels.append([_digest(last[k:k + FAN]) for k in range(0, len(last), FAN)])
    return levels


def _siblings(levels: list[list[str]], at: int) -> list[tuple[int, list[str]]]:
    """(place in its run, the run's others) of node ``at`` and its parents."""
    out = []
    for level in levels[:-1]:
        lo = at - at % FAN
        out.append((at - lo, level[lo:at] + level[at + 1:lo + FAN]))
        at //= FAN
    return out


def fold(digest: str, proof: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, others in proof:
        digest = _digest(others[:at] + [digest] + others[at:])
    return digest


def pack_proof(proof: list[tuple[int, list[str]]]) -> bytes:
    """Per round: place, number of others, their digests."""
    return b"".join(bytes([at, len(others)]) + bytes.fromhex("".join(others)) for at, others in proof)


def unpack_proof(raw: bytes) -> list[tuple[int, list[str]]]:
    out, k = [], 0
    while k < len(raw):
        at, n = raw[k], raw[k + 1]
        text = raw[k + 2:k + 2 + 32 * n].hex()
        out.append((at, [text[64 * i:64 * i + 64] for i in range(n)]))
        k += 2 + 32 * n
    return out


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with pos (place in its tree by ``order``) and n (nodes of the tree)."""
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = leaves.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order)
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()), "merkle-order")
    rows = rows.withColumn("part", F.shiftright("row", 33))
    runs = rows.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("c"))
    tree = Window.partitionBy("tree")  # one row per partition of the tree
    runs = runs.withColumn("n", F.sum("c").over(tree)).withColumn("base", F.sum("c").over(tree.orderBy("part")) - F.col("c"))
    return rows.join(runs, ["tree", "part"]).withColumn("pos", F.col("base") + F.col("row") - F.col("first")).drop("part", "row", "first", "c", "base")


def _block(height: int) -> Column:
    return F.expr(f"pos div {FAN ** height}").alias("block")


def _reduce(height: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        n = int(pdf.n.iloc[0])
        size = FAN ** height
        top = _levels(pdf.digest.tolist(), _rounds(n, height))[-1]
        return pd.DataFrame({"tree": [pdf.tree.iloc[0]], "pos": [int(pdf.pos.iloc[0]) // size], "n": [-(-n // size)], "digest": top})
    return run


NODES = "tree string, pos bigint, n bigint, digest string"


def stages(nodes: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """The given nodes, the nodes of their superblocks, and so on until each tree has one node."""
    out = [nodes]
    while not out[-1].filter("n > 1").isEmpty():
        up = out[-1].select("tree", "pos", "n", "digest").groupBy("tree", _block(height)).applyInPandas(_reduce(height), NODES)
        out.append(cut(up, "merkle-stage"))
    return out


def _expand(height: int):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        """The outer proof of every node of a superblock."""
        nodes = nodes.sort_values("pos")
        levels = _levels(nodes.digest.tolist(), _rounds(int(nodes.n.iloc[0]), height))
        behind = bytes(outer.proof.iloc[0])
        return pd.DataFrame({"tree": nodes.tree, "pos": nodes.pos, "digest": nodes.digest,
                             "proof": [pack_proof(_siblings(levels, k)) + behind for k in range(len(nodes))],
                             "subroot": outer.subroot.iloc[0], "root": outer.root.iloc[0]})
    return run


def _finish(height: int, with_proofs: bool):
    def run(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("pos")
        leaves, claims = nodes.digest.tolist(), nodes.claim.tolist()
        levels = _levels(leaves, _rounds(int(nodes.n.iloc[0]), height))
        behind = unpack_proof(bytes(outer.proof.iloc[0]))
        hashed, folded, packed = [], [], []
        for k, (leaf, claim) in enumerate(zip(leaves, claims)):
            proof = _siblings(levels, k) + behind
            hashed.append(_digest(x for _, others in proof for x in others))
            folded.append(fold(claim or leaf, proof))
            if with_proofs:
                packed.append(pack_proof(proof))
        root = outer.root.iloc[0]
        out = pd.DataFrame({"id": nodes.id, "leaf": leaves, "subroot": outer.subroot.iloc[0], "root": root, "proof_sha256": hashed,
                            "folded_root": folded, "verified": [x == root for x in folded]})
        return out.assign(proof=packed) if with_proofs else out
    return run


OUTER = "tree string, pos bigint, digest string, proof binary, subroot string, root string"


def _down(stage: DataFrame, outer: DataFrame, height: int, fn, schema: str) -> DataFrame:
    return stage.groupBy("tree", _block(height)).cogroup(outer.groupBy("tree", F.col("pos").alias("block"))).applyInPandas(fn, schema)


def prove(leaves: DataFrame, with_proofs: bool = False, height: int = HEIGHT) -> DataFrame:
    """Proof of every leaf.

    ``leaves``: id, source, leaf (hex digest), claim (hex digest of the row as someone
    else has it, null where it is the leaf).  Returns id, leaf, subroot, root,
    proof_sha256 (digest of the siblings from leaf to root), folded_root (from claim and
    siblings) and verified; with ``with_proofs`` also proof (see ``unpack_proof``).
    """
    kind = dict(leaves.dtypes)["id"]
    # a source's name stands behind '=', so that the tree of the null source sorts first
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("tree"),
                         "id", F.col("leaf").alias("digest"), "claim")
    rows = placed(cut(rows, "merkle-leaves"), ["id", "digest"]).withColumn("id", F.col("id").cast("string"))
    by_source = stages(rows, height)
    subroots = by_source[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    sources = placed(subroots, ["source"])
    over = stages(sources, height)
    outer = over[-1].select("tree", "pos", "digest", F.lit(b"").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for stage in over[-2::-1]:
        outer = _down(stage.select("tree", "pos", "n", "digest"), outer, height, _expand(height), OUTER)
    outer = sources.select("source", "pos").join(outer.select("pos", "digest", "proof", "root"), "pos")
    outer = outer.select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "digest", "proof", F.col("digest").alias("subroot"), "root")
    for stage in by_source[-2:0:-1]:
        outer = _down(stage.select("tree", "pos", "n", "digest"), outer, height, _expand(height), OUTER)
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = _down(rows.select("tree", "pos", "n", "digest", "id", "claim"), outer, height, _finish(height, with_proofs), schema + (", proof binary" if with_proofs else ""))
    return out.withColumn("id", F.col("id").cast(kind))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of ``documents``; every fifth document's claim has its text lower-cased."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf_digest(*(tampered if c == "text" else F.col(c) for c in FIELDS)))
    leaves = docs.select(F.col("doc_id").alias("id"), "source", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), claim.alias("claim"))
    return prove(leaves).withColumnRenamed("id", "doc_id")


def _sql(fields) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of the decimal id, bit by bit: a byte of the id is mixed in, then eight shifts follow
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([list_prepend(ascii(ch)::BIGINT, repeat([-1::BIGINT], 8))
  for ch in string_split(CAST(doc_id AS VARCHAR), '')])),
  lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT)"""

OP13_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, '=' || source AS src, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n, leaf, claim
  FROM (SELECT doc_id, source, {_sql(FIELDS)} AS leaf,
               CASE WHEN {_CRC} % 5 = 0 THEN {_sql([_LOWER if f == 'text' else f for f in FIELDS])} ELSE {_sql(FIELDS)} END AS claim
        FROM documents)),
up AS (SELECT 0 AS lvl, coalesce(src, '') AS src, pos, n, leaf AS digest FROM leaves
       UNION ALL
       SELECT lvl + 1, src, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY lvl, src, pos // 16),
subroots AS (SELECT src, digest, row_number() OVER (ORDER BY src) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, digest FROM subroots
        UNION ALL
        SELECT lvl + 1, pos // 16, (max(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16),
nodes AS (SELECT lvl, src, pos, n, digest FROM up UNION ALL SELECT lvl, NULL, pos, n, digest FROM top),
sib AS (SELECT lvl, src, pos, n,
               coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, src, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
               coalesce(string_agg(digest, '') OVER (PARTITION BY lvl, src, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
        FROM nodes WHERE n > 1),
path AS (SELECT doc_id, leaf, coalesce(src, '') AS src, pos, n, 0 AS lvl, claim AS cur, '' AS proof FROM leaves
         UNION ALL
         SELECT doc_id, leaf, p.src, p.pos // 16, (p.n + 15) // 16, p.lvl + 1, sha256(before || cur || behind), proof || before || behind
         FROM path p JOIN sib s ON s.src = p.src AND s.lvl = p.lvl AND s.pos = p.pos),
top_path AS (SELECT doc_id, leaf, p.src, s.pos, s.n, 0 AS lvl, cur, proof FROM path p JOIN subroots s USING (src) WHERE p.n = 1
             UNION ALL
             SELECT doc_id, leaf, p.src, p.pos // 16, (p.n + 15) // 16, p.lvl + 1, sha256(before || cur || behind), proof || before || behind
             FROM top_path p JOIN sib s ON s.src IS NULL AND s.lvl = p.lvl AND s.pos = p.pos)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = r.digest AS verified
FROM top_path p JOIN subroots s USING (src) JOIN (SELECT digest FROM top WHERE n = 1) r ON true
WHERE p.n = 1
"""
