"""Connected components by hooking and shortcutting in joined tables.

Each round hooks every root onto its smallest neighbour (one aggregate over the edges
between roots), shortcuts the pointers until they are flat, and moves the edges up to the new
roots, where loops and repeats vanish. Every root that isn't the smallest of its
neighbourhood disappears in a round, so rounds stay logarithmic. The tables are cut
with checkpoint(); only counts reach the driver.

Scale: edges are undirected and distinct, aggregates combine map-side, so a node with a
third of all edges costs one partial row a task. Defined cases: loops and NULL ends are
ignored, repeated edges count once, no edges give no rows; labels are the smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for each end of an edge; root is the smallest node of its component."""
    low, high = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    live = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(low.alias("a"), high.alias("b")).distinct())
    parents = None
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        hooked = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("root"))
        flat = shortcut(cut(hooked))
        if parents is None:
            parents = flat
        else:
            up = flat.select(F.col("node").alias("root"), F.col("root").alias("top"))
            parents = cut(parents.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))
        left = flat.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = flat.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = live.join(left, "a").join(right, "b").where("ra <> rb")
        live = cut(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if parents is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return parents


def shortcut(pointers: DataFrame) -> DataFrame:
    """Pointers led to their ends: node -> root with root -> root."""
    while True:
        up = pointers.select(F.col("node").alias("root"), F.col("root").alias("top"))
        pointers = cut(pointers.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root"), (F.coalesce("top", "root") != F.col("root")).alias("moved")))
        if pointers.where("moved").isEmpty():
            return pointers.select("node", "root")
        pointers = pointers.select("node", "root")
