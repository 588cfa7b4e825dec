"""Connected components of an edge table by smallest label, with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geodemand.llm.common import written

GATHERED = 1 << 20  # edges that one task labels, at 16 bytes each; more are labelled in rounds of joins


def labelled(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges, ascending, and the smallest node each can reach.

    Labels are roots: of two roots that an edge joins the larger hangs on the smaller, then all labels follow up to the root.
    """
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y, label = at[: len(x)], at[len(x) :], np.arange(len(nodes))
    while True:
        one, two = label[x], label[y]
        apart = one != two
        if not apart.any():
            return nodes, nodes[label]
        x, y, one, two = x[apart], y[apart], one[apart], two[apart]
        np.minimum.at(label, np.maximum(one, two), np.minimum(one, two))
        while (label != label[label]).any():
            label = label[label]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of `edges`, whole numbers; the component is its smallest node.

    Few edges are labelled by one task. With more, each round takes the smallest label next to each
    node, then the label of that label, so the number of rounds grows with the logarithm of the
    longest chain in practice. Minima are formed before the shuffle, so a node with very many edges
    costs no more than its partitions.
    """
    edges = written(edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x != y"), "edges")
    if edges.count() <= GATHERED:

        def work(batches):
            t = pa.Table.from_batches(list(batches), pa.schema([("x", pa.int64()), ("y", pa.int64())]))
            node, component = labelled(t.column("x").to_numpy(), t.column("y").to_numpy())
            yield pa.record_batch([pa.array(node), pa.array(component)], ["node", "component"])

        return written(edges.coalesce(1).mapInArrow(work, "node long, component long"), "labels")

    both = written(edges.union(edges.select("y", "x")).distinct(), "edges")
    labels = written(both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("c")).withColumnRenamed("x", "node"), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("c").alias("m"))
        least = labels.join(near, labels["node"] == near["x"]).select("node", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        least = written(least, "labels")
        jump = least.select(F.col("node").alias("_n"), F.col("c").alias("_c"))
        jumped = written(
            least.join(jump, least["c"] == jump["_n"], "left").select("node", "old", F.least("c", F.coalesce("_c", "c")).alias("c")), "labels"
        )
        if not jumped.where("old != c").head(1):
            return jumped.select("node", F.col("c").alias("component"))
        labels = jumped.select("node", "c")
