"""Embedding near-dedup by a subspace pigeonhole join.

For unit vectors, cosine >= t means squared distance <= 2 - 2t. Vectors are rotated by a fixed
random rotation and split into blocks of coordinates; if the whole squared distance is within
the budget, then at least one block is within its proportional share. Each block is
range-joined under its share: a grid over its first coordinates brings together what can be
that close. A vector sits in its own cell, and is a guest in the cell below wherever it lies
within the range of the boundary, so a pair within range meets in exactly one cell, the lower
of the two in every coordinate. A pair that several blocks bring together counts in the first.

Vectors alike in all components are one node with a count, before anything is joined. A cell
of many nodes is dealt out in pairs of bounded blocks. Tasks return counts of links and the
edges of a spanning forest, never the pairs of a group.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vectors import matrix, takes_part
from tidemark.operators.graph import connected_components
from tidemark.session import materialize

THRESHOLD = 0.98
BLOCKS = 4
CELL_ROWS = 4096
CHUNK = 1024
GRID_WIDTH = 3.0
MAX_GRID = 6
_SLACK = 1e-9


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def edges_of_blocks(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = [round(dim * b / min(blocks, dim)) for b in range(min(blocks, dim) + 1)]
    return list(itertools.pairwise(cuts))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows with a largest component from one half to one, by a power of two: no digit changes and no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(y: np.ndarray, lo: int, grid: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Own cells (rows x grid) and whether the row is within reach of each lower boundary."""
    width = GRID_WIDTH * reach
    x = y[:, lo : lo + grid]
    own = np.floor(x / width).astype(np.int64)
    return own, x - own * width <= reach * (1 + _SLACK)


def _shares(dim: int, threshold: float, blocks: int) -> list[float]:
    """The squared distance allowed in each block; the grid's reach is its root, so that both agree on every pair."""
    budget = max(0.0, 2.0 - 2.0 * threshold)
    return [budget * (hi - lo) / dim * (1 + _SLACK) + _SLACK for lo, hi in edges_of_blocks(dim, blocks)]


def _deal(nodes: DataFrame, grid: int, threshold: float, blocks: int) -> DataFrame:
    """One row per node, block and cell it sits or is a guest in."""
    keys = ["label", "dim", "rep", "mult", "embedding"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.select(*keys).schema)

    def run(batches):
        for batch in batches:
            dims = np.array(batch.column(1).to_pylist())
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                y = _unit(matrix(part.column(4))) @ rotation(dim)
                for b, (lo, hi) in enumerate(edges_of_blocks(dim, blocks)):
                    g = min(grid, hi - lo)
                    own, near = _cells(y, lo, g, math.sqrt(_shares(dim, threshold, blocks)[b]))
                    for guest in itertools.product((0, 1), repeat=g):
                        down = np.array(guest, bool)
                        rows = np.nonzero(near[:, down].all(axis=1))[0]
                        if len(rows):
                            cells = [",".join(map(str, c)) for c in (own[rows] - down).tolist()]
                            out = part.take(pa.array(rows))
                            yield pa.RecordBatch.from_arrays(
                                [*out.columns, pa.array(np.full(len(rows), b, np.int32)), pa.array(cells, pa.string())], [*keys, "block", "cell"]
                            )

    return nodes.select(*keys).mapInArrow(run, f"{schema}, block int, cell string")


def _verify(table: pa.Table, threshold: float, grid: int, blocks: int) -> pa.Table:
    """Exact links of one bounded group: (rep, null, links) and forest edges (rep, other, 0)."""
    block, dim = table.column("block")[0].as_py(), table.column("dim")[0].as_py()
    first, second = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    cell = np.array([int(c) for c in table.column("cell")[0].as_py().split(",")])
    x = _scaled(matrix(table.column("embedding")))
    norms = np.linalg.norm(x, axis=1)
    y = _unit(x) @ rotation(dim)
    spans, shares = edges_of_blocks(dim, blocks), _shares(dim, threshold, blocks)
    lo, hi = spans[block]
    own, _ = _cells(y, lo, len(cell), math.sqrt(shares[block]))
    reps, mult, part = (table.column(c).to_numpy() for c in ("rep", "mult", "own"))
    left = np.nonzero(part == first)[0]
    right = np.nonzero(part == second)[0]
    links = np.zeros(len(reps), np.int64)
    parent = list(range(len(reps)))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    edges: list[tuple[int, int]] = []

    def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)

    for at, a0 in enumerate(range(0, len(left), CHUNK)):
        a = left[a0 : a0 + CHUNK]
        for b0 in range(at * CHUNK if first == second else 0, len(right), CHUNK):
            b = right[b0 : b0 + CHUNK]
            close = squared(y[a, lo:hi], y[b, lo:hi]) <= shares[block]
            if first == second and a0 == b0:
                close &= np.triu(np.ones(close.shape, bool), 1)
            if not close.any():
                continue
            close &= (x[a] @ x[b].T) / (norms[a][:, None] * norms[b][None, :]) >= threshold
            for t in range(len(cell)):
                close &= np.minimum(own[a, t][:, None], own[b, t][None, :]) == cell[t]
            for earlier in range(block):
                l2, h2 = spans[earlier]
                if close.any():
                    close &= squared(y[a, l2:h2], y[b, l2:h2]) > shares[earlier]
            if not close.any():
                continue
            links[a] += close @ mult[b]
            links[b] += close.T @ mult[a]
            for i, j in zip(*np.nonzero(close), strict=True):
                ri, rj = root(int(a[i])), root(int(b[j]))
                if ri != rj:
                    parent[ri] = rj
                    edges.append((int(a[i]), int(b[j])))
    some = np.nonzero(links)[0]
    src = [e[0] for e in edges]
    dst = [e[1] for e in edges]
    return pa.table(
        {
            "rep": pa.array(np.concatenate([reps[some], reps[src]]) if len(some) else np.zeros(0, np.int64), pa.int64()),
            "other": pa.array([None] * len(some) + reps[dst].tolist(), pa.int64()),
            "links": pa.array(np.concatenate([links[some], np.zeros(len(src), np.int64)]), pa.int64()),
        }
    )


def link_vectors(nodes: DataFrame, threshold: float = THRESHOLD, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(rep, other, links) from nodes (label, dim, rep, mult, embedding)."""
    largest = nodes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    # Each grid coordinate leaves about half of a label's nodes together: as many as bring a cell to its bound.
    grid = min(MAX_GRID, max(1, math.ceil(math.log2(max(1, largest) / cell_rows))))
    dealt, _ = materialize(_deal(nodes, grid, threshold, blocks), "cells")
    key = ["label", "dim", "block", "cell"]
    sizes = dealt.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").withColumn("k", F.ceil(F.col("n") / cell_rows).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda o: F.struct(F.least(o, F.col("own")).alias("i"), F.greatest(o, F.col("own")).alias("j")),
    )
    groups = (
        dealt.join(sizes, key)
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
        .withColumn("p", F.explode(pairs))
        .select(*key, F.col("p.i").alias("i"), F.col("p.j").alias("j"), "own", "rep", "mult", "embedding")
    )

    def run(table: pa.Table) -> pa.Table:
        return _verify(table, threshold, grid, blocks)

    return groups.groupBy(*key, "i", "j").applyInArrow(run, "rep long, other long, links long")


def dedup_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The op4 digest per vector row: vec_id, n_links, component_id, kept.

    Only vectors of one label and one length are compared. Rows without a label, or whose
    vector takes no part, link with nothing; so do rows without a vec_id. Repeated rows count
    as vectors of their own; rows that repeat a vec_id share the links of that id. Extra columns
    are not read, and an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    linkable = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    nodes, _ = materialize(
        linkable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")).withColumn("dim", F.size("embedding")),
        "vectors",
    )
    found, _ = materialize(link_vectors(nodes, threshold), "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("other is not null"), "rep", "other")
    per_rep = (
        nodes.select("rep", "mult").groupBy("rep").agg(F.sum("mult").alias("mult"))
        .join(counts, "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rep", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    named = linkable.select("vec_id", "label", "embedding").join(nodes.select("label", "embedding", "rep"), ["label", "embedding"]).join(per_rep, "rep")
    apart = rows.where(~(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & takes_part(F.col("embedding"))))
    return (
        named.select("vec_id", "n_links", "component_id")
        .unionByName(apart.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.dst FROM reach r JOIN links l ON r.seen = l.src),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
counts AS (SELECT src, count(*) AS n FROM links GROUP BY src)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.node = e.vec_id LEFT JOIN counts c ON c.src = e.vec_id
"""
