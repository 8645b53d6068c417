"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.storage import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each node's component, for all nodes of ``edges`` (``a, b``).

    Labels spread to neighbours and then jump to their own label's label; each round's labels are written to the shared folder.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", narrow=True)
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels", narrow=True)
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("__near"))
        near = labels.join(spread, "node").select("node", "root", F.least("root", "__near").alias("__to"))
        jump = near.join(labels.select(F.col("node").alias("__to"), F.col("root").alias("__root")), "__to").select("node", F.least("__to", "__root").alias("root"), (F.least("__to", "__root") < F.col("root")).alias("__moved"))
        moved = cut(jump, "labels", narrow=True)
        labels = moved.select("node", "root")
        if not moved.filter("__moved").limit(1).count():
            return labels
