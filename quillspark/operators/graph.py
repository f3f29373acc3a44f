"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lineage import cut

#: A node is a hub if it has over a HUB-th of the edges: there can be 2 * HUB of them at most.
HUB = 64
#: Up to this many edges (16 MB) one task finds all roots, which takes less than the shuffles of one round.
FEW = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the edges (a, b), sorted, and the smallest node that each reaches."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = ends[: len(a)], ends[len(a) :], np.arange(len(nodes))
    while True:
        at_a, at_b = label[a], label[b]
        open_ = at_a != at_b
        if not open_.any():
            return nodes, nodes[label]
        a, b, at_a, at_b = a[open_], b[open_], at_a[open_], at_b[open_]
        np.minimum.at(label, np.maximum(at_a, at_b), np.minimum(at_a, at_b))
        while (label != label[label]).any():
            label = label[label]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes and roots of the edges in all batches."""
    held = pa.Table.from_batches(batches, pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    yield pa.RecordBatch.from_arrays(list(map(pa.array, roots(held["a"].to_numpy(), held["b"].to_numpy()))), ["node", "root"])


def _state(edges: DataFrame) -> tuple[int, int]:
    """The number of distinct edges (a > b), and of nodes that keep them from being stars around their least nodes."""
    ends = edges.selectExpr("a as node", "1 as up").unionByName(edges.selectExpr("b as node", "0 as up"))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    row = nodes.agg(F.sum("up").alias("n"), F.count_if(F.expr("up > 1 or (up = 1 and n > 1)")).alias("odd")).first()
    return row["n"] or 0, row["odd"]


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges(a, b) with m, the least b of an a. A hub's edges stay where they are: its one row goes to all tasks."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    hubs = [r["a"] for r in low.where(F.col("n") * HUB > total).select("a").collect()]
    low = low.drop("n")
    if not hubs:
        return edges.join(low, "a")
    is_hub = F.col("a").isin(hubs)
    return edges.where(is_hub).join(F.broadcast(low.where(is_hub)), "a").unionByName(edges.where(~is_hub).join(low.where(~is_hub), "a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the smallest node that it reaches.

    edges: longs a, b in any order; null ends, loops and repeated rows count for nothing. A round is two
    aggregations and two joins on a node; what a hub gathers is one minimum, never a list. Every round is
    written to the shared folder; the last is the one that leaves stars. FEW edges at most need no rounds:
    one task reads them. No edges give no rows.
    """
    pairs = cut(edges.where("a is not null and b is not null and a != b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
    if pairs.count() <= FEW:
        return cut(pairs.coalesce(1).mapInArrow(_roots, "node long, root long"))
    total, odd = _state(pairs)
    while odd:
        both = pairs.unionByName(pairs.selectExpr("b as a", "a as b"))
        large = cut(_with_least(both, total).where("b > a").selectExpr("b as a", "least(a, m) as b").distinct())
        small = _with_least(large, total)
        small = small.selectExpr("a", "m as b").unionByName(small.selectExpr("b as a", "m as b")).where("a != b").distinct()
        pairs = cut(small)
        total, odd = _state(pairs)
    return pairs.selectExpr("a as node", "b as root").unionByName(pairs.selectExpr("b as node", "b as root").distinct())
