"""Connected components by contraction, on stored tables.

Each round lets every node hook onto its smallest neighbour, shortens the hooks to their roots by
pointer jumping, and rewrites the links between roots. Links inside a component vanish, so rounds
get smaller quickly. All steps are joins and grouped minima of stored tables: a node with very many
links is a skewed join key, which adaptive execution splits, and never a collected list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _roots(hooks: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) from (node, root) hooks that point to smaller nodes, each root reaching itself."""
    while True:
        to = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
        jumped = scratch.store(
            hooks.join(to, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")),
            "jump",
        )
        hooks = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return hooks


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node it reaches.

    Nodes without links, nulls and links of a node to itself do not appear.
    """
    links = scratch.store(
        links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    found = None
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("to"))
        )
        hooks = scratch.store(ends.groupBy("node").agg(F.least("node", F.min("to")).alias("root")), "hooks")
        roots = _roots(hooks, scratch)
        if found is None:
            found = roots
        else:
            step = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
            found = scratch.store(
                found.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "found"
            )
        a = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = scratch.store(
            links.join(a, "a").join(b, "b").where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "links",
        )
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
