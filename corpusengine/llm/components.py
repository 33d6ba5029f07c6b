"""Connected components as joins: hook every node to its smallest smaller neighbour, then jump pointers.

A round hooks all nodes that have a smaller neighbour, so that only local minima stay roots, and pointer
jumping flattens the trees in a logarithmic number of joins. Edges are then renamed to their roots; rounds
end when no edge joins two roots. Every step is a checkpointed table, so hot nodes sit on the plain
side of a join, where adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs, in any direction and repeated or not, to ``(node, root)``.

    ``root`` is the smallest node that ``node`` reaches. Only nodes other than their own root are
    returned; whoever joins this treats a missing node as its own root. Edges with a null end or
    from a node to itself say nothing. No edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), (F.col("a") != F.col("b")).alias("ok"))
    e = cut(e.where("ok").select("u", "v").distinct())
    known: DataFrame | None = None
    while not e.isEmpty():
        hooks = _jumped(cut(e.groupBy("u").agg(F.min("v").alias("p"))))
        if known is None:
            known = hooks.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = known.join(hooks, known["root"] == hooks["u"], "left").select("node", F.coalesce("p", "root").alias("root"))
            known = cut(moved.unionByName(hooks.select(F.col("u").alias("node"), F.col("p").alias("root"))))
        of_v = hooks.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        renamed = e.join(hooks, "u").join(of_v, "v", "left").select(F.col("p").alias("x"), F.coalesce("pv", "v").alias("y"))
        e = cut(renamed.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    return edges.sparkSession.createDataFrame([], "node long, root long") if known is None else known


def _jumped(hooks: DataFrame) -> DataFrame:
    """Pointers ``(u, p)`` replaced by pointers to the end of their chains."""
    while True:
        to = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        far = cut(hooks.join(to, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
        hooks = far.select("u", "p")
        if far.where("moved").isEmpty():
            return hooks
