"""Connected components that grow as links are found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.llm.common import cut
from silvergrain.operators.components import components


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp) with more links (a, b); a node without a row is a component of its own."""
    name = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    roots = components(between).select(F.col("node").alias("comp"), F.col("comp").alias("root"))
    nodes = comps.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
    return cut(nodes.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")), "components")
