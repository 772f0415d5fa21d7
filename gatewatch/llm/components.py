"""Connected components by hooking and pointer jumping, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, written


def _compressed(parents: Table) -> Table:
    """Every node's root instead of its parent. Chains halve in each round."""
    while True:
        p = parents.read()
        up = p.select(F.col("node").alias("n2"), F.col("parent").alias("p2"))
        jumped = written(p.join(up, p["parent"] == up["n2"], "left").select("node", F.coalesce("p2", "parent").alias("parent"), F.col("p2").isNotNull().alias("moved")), "jump")
        moved = jumped.read().where("moved").limit(1).count()
        parents.drop()
        parents = jumped
        if not moved:
            return parents


def components(edges: DataFrame) -> Table:
    """``node, component`` for every node of the edges ``a, b``; the component is its smallest node.

    In a round every node with a smaller neighbour hooks onto the smallest one; chains are then compressed
    and the edges contracted. Each round at least halves the nodes that still have edges. Loops and repeated
    edges are harmless. No edges give an empty table.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    left = written(edges.where("a <> b").select(hi.alias("hi"), lo.alias("lo")).distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = written(nodes.select("node", F.col("node").alias("component")), "labels")
    while left.read().limit(1).count():
        e = left.read()
        roots = _compressed(written(e.groupBy("hi").agg(F.min("lo").alias("parent")).withColumnRenamed("hi", "node"), "hooks"))
        r = roots.read()
        old = labels.read()
        new = written(old.join(r.select(F.col("node").alias("n"), F.col("parent").alias("to")), old["component"] == F.col("n"), "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        a = e.join(r.select(F.col("node").alias("n1"), F.col("parent").alias("t1")), e["hi"] == F.col("n1"), "left")
        b = a.join(r.select(F.col("node").alias("n2"), F.col("parent").alias("t2")), a["lo"] == F.col("n2"), "left")
        x, y = F.coalesce("t1", "hi"), F.coalesce("t2", "lo")
        contracted = written(b.where(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges")
        for t in (left, labels, roots):
            t.drop()
        left, labels = contracted, new
    left.drop()
    return labels
