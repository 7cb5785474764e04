"""Connected components of an edge table, by contraction in Spark tables.

At most ``FEW`` edges (their number is checked) are joined by one task, in
arrays of bounded size; the contraction brings larger tables there.

Each round hooks every node to its smallest neighbour, jumps pointers until
they rest, and contracts the edges; nodes that are local minima survive, so
the rounds are logarithmic. Nothing is collected; every table is written to
the shared folder, so that lost executors cost a re-read, not a lineage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Staged

FEW = 1 << 18


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Roots of all edges of the task: every node takes its least neighbour's root until none changes."""
    parts = list(batches)
    a, b = (np.concatenate([np.empty(0, np.int64), *(x.column(i).to_numpy() for x in parts)]) for i in (0, 1))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    if len(nodes):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _settled(e: Staged) -> DataFrame:
    return e.df().coalesce(1).mapInArrow(_joined, "node long, root long")


def components(edges: DataFrame) -> Staged | None:
    """(a, b) longs -> a table (node, root), root the smallest node; None without edges.

    Self-loops, repeated and reversed edges are allowed; nulls are dropped.
    """
    found, old = None, []
    e = Staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while left := e.rows():
        d = e.df()
        if left <= FEW:
            step = Staged(_settled(e), "parents")
            if found is None:
                found = step
            else:
                prior, up = found, step.df().select(F.col("node").alias("root"), F.col("root").alias("up"))
                found = Staged(prior.df().join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
                old += [prior, step]
            break
        both = d.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(d.select(F.col("b").alias("node"), F.col("a").alias("other")))
        p = Staged(both.groupBy("node").agg(F.min("other").alias("root")).select("node", F.least("node", "root").alias("root")), "parents")
        while True:
            q = p.df().select(F.col("node").alias("root"), F.col("root").alias("up"))
            nxt = Staged(p.df().join(q, "root").select("node", F.col("up").alias("root"), (F.col("up") < F.col("root")).alias("moved")), "parents")
            moved = not nxt.df().where("moved").isEmpty()
            p.drop()
            p = nxt
            if not moved:
                break
        step = p.df().select(F.col("node").alias("root"), F.col("root").alias("up"))
        if found is None:
            found = Staged(p.df().select("node", "root"), "roots")
        else:
            prior = found
            found = Staged(prior.df().join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
            prior.drop()
        a, b = (p.df().select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        left = d.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        nxt = Staged(left, "edges")
        old += [e, p]
        e = nxt
    for x in [*old, e]:
        x.drop()
    return found
