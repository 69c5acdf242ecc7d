"""Links between classes of equal items: cells of bounded size, components, results per row.

Candidate groups are cut into blocks; every pair of blocks is one cell, worked on
by one task.  A cell returns one row per linked class (its number of links and the
smallest class it reaches inside the cell), never a row per pair, so output grows
with the input and not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut, tidy


def to_cells(df: DataFrame, group: str, node: str, n_blocks: Column) -> DataFrame:
    """One row per cell that a row takes part in: columns ``cell`` and ``blk`` (0 or 1: the
    cell's first or second block; -1 where both are the same block)."""
    df = df.withColumn("_nb", n_blocks.cast("int")).withColumn("_b", F.pmod(F.xxhash64(node, F.lit(3)), F.col("_nb")).cast("int"))
    df = df.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    lo, hi = F.least("_b", "_o"), F.greatest("_b", "_o")
    name = F.col(group) if dict(df.dtypes)[group] == "binary" else F.unhex(F.hex(group))
    cell = F.when(F.col("_nb") == 1, name).otherwise(
        F.concat(name, F.encode(F.format_string(",%d,%d", lo, hi), "UTF-8")))
    blk = F.when(lo == hi, -1).otherwise((F.col("_b") == hi).cast("int"))
    return df.withColumn("cell", cell).withColumn("blk", blk).drop("_nb", "_b", "_o")


def on_cells(df: DataFrame, work: Callable[[dict[str, list]], tuple | None]) -> DataFrame:
    """(node, links, root) rows that ``work`` returns for all rows of each cell.

    Cells are dealt by hash and sorted, so a task streams over them and holds one
    cell and one batch at a time.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = df.columns

    @tidy
    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[str, list] = {c: [] for c in names}
        for batch in batches:
            rows = {c: held[c] + batch.column(k).to_pylist() for k, c in enumerate(names)}
            keys = rows["cell"]
            ends = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
            yield _worked(work, rows, ends)
            held = {c: v[ends[-1] if ends else 0:] for c, v in rows.items()}
        yield _worked(work, held, [len(held["cell"])])

    return df.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "node binary, links bigint, root binary")


def _worked(work, rows: dict[str, list], ends: list[int]) -> pa.RecordBatch:
    out: tuple[list, list, list] = ([], [], [])
    at = 0
    for to in ends:
        if to - at > 1:
            got = work({c: v[at:to] for c, v in rows.items()})
            for have, more in zip(out, got or ()):
                have.extend(more)
        at = to
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                                      ["node", "links", "root"])


def pairs_of(linked: np.ndarray, blk: list) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a cell, each once: inside one block, or between its two blocks."""
    if blk[0] == -1:
        return np.nonzero(np.triu(linked, 1))
    b = np.array(blk)
    return np.nonzero(linked & (b[:, None] == 0) & (b[None, :] == 1))


def linked_rows(nodes: list, i: np.ndarray, j: np.ndarray, weight: list, counted: np.ndarray | None = None) -> tuple:
    """(nodes, links, roots) of the linked nodes: summed weight of their (counted)
    partners, smallest node that they reach over all the pairs."""
    n = len(nodes)
    order = sorted(range(n), key=nodes.__getitem__)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    root = local_roots(n, rank[i], rank[j])
    w, links = np.array(weight, np.int64), np.zeros(n, np.int64)
    a, b = (i, j) if counted is None else (i[counted], j[counted])
    np.add.at(links, a, w[b])
    np.add.at(links, b, w[a])
    on = np.unique(np.concatenate([i, j]))
    return [nodes[x] for x in on], links[on].tolist(), [nodes[order[root[rank[x]]]] for x in on]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` items reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the
    smallest node of the component.  Alternates large-star and small-star steps, each
    written to the shared folder, until the edges are stars; the number of rounds
    grows with the logarithm of the longest chain, and has no limit."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e, "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        e = cut(small.select("e.*").filter("a <> b").distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def classes(rows: DataFrame, node: str, id_col: str) -> DataFrame:
    """(node, first, copies): one row per class of equal items; null nodes stay out."""
    return rows.filter(F.col(node).isNotNull()).groupBy(node).agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("copies"))


def results(rows: DataFrame, cls: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Per row of ``rows`` (id, node): n_links and component (smallest id reached).

    ``found``: (node, links, root) rows of the cells.  ``cls``: classes.  Rows
    without a node, and rows of lone classes, reach only themselves and their copies.
    """
    found = cut(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per = cls.join(links, "node", "left").join(comp, "node", "left")
    per = cut(per.select("node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "classes")
    low = per.groupBy("root").agg(F.min("first").alias("component"))
    # a lone class is its own component, so only linked ones are joined by root
    per = per.join(low, "root").select("node", "component", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows.join(per, "node", "left").select(
        F.col(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", id_col).alias("component"),
        *[c for c in rows.columns if c not in (id_col, "node")])
