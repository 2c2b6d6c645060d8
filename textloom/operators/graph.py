"""Connected components of pairs, for groups of linked rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.sources.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of (a, b): each node that is not itself the smallest of its component, with that smallest.

    Labels spread along the links and then to the label of the label, which halves the distance to the root each
    round. Rounds are written to the shared folder; only a count comes back.
    """
    both = stored(edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a != b").distinct())
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("r"))
        spread = labels.join(near, "node").select("node", F.least("root", "r").alias("root"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(spread.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"))
        changed = new.filter("root != was").limit(1).count()
        labels = new.select("node", "root")
        if not changed:
            return labels.filter("node != root")
