"""Connected components of links between long ids, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.sources.staging import cut


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, comp): comp is the smallest id that a node reaches.

    Every round each node takes the smallest label among itself and its
    neighbours, then the label of that label; rounds grow with the logarithm of
    the longest path rather than with its length. Labels are written between
    rounds; only whether any changed reaches the driver.
    """
    edges = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("theirs")), "b").groupBy(F.col("a").alias("node")).agg(F.min("theirs").alias("least"))
        lower = cut(labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "least").alias("comp")), "lower")
        jump = lower.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        labels = cut(lower.join(jump, "comp", "left").select("node", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        changed = labels.where("comp <> old").limit(1).count()
        labels = labels.select("node", "comp")
        if not changed:
            return labels
